"""Plain graphs: canonical edges, adjacency, relabelling, incidence graphs.  Edges are rows (graph, u, v) with u < v."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def canonical(edges: DataFrame) -> DataFrame:
    """No loops, ends in order, no repeats."""
    e = edges.filter("u <> v").select("graph", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return e.distinct()


def relabel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, names): ids from 0 in the order in which names are first seen; ``edges`` has graph, pos, u, v, names in strings."""
    ends = edges.select("graph", F.explode(F.array(F.struct((F.col("pos") * 2).alias("p"), F.col("u").alias("label")), F.struct((F.col("pos") * 2 + 1).alias("p"), F.col("v").alias("label")))).alias("e"))
    first = ends.groupBy("graph", F.col("e.label").alias("label")).agg(F.min("e.p").alias("p"))
    names = first.select("graph", "label", (F.row_number().over(Window.partitionBy("graph").orderBy("p")) - 1).cast("long").alias("id"))
    a, b = names.select("graph", F.col("label").alias("u"), F.col("id").alias("iu")), names.select("graph", F.col("label").alias("v"), F.col("id").alias("iv"))
    out = edges.join(a, ["graph", "u"]).join(b, ["graph", "v"]).select("graph", "pos", F.col("iu").alias("u"), F.col("iv").alias("v"))
    return out, names


def label_ids(rows: DataFrame, label: str = "label") -> DataFrame:
    """graph, label, v: ids from 0 in the order of the labels."""
    names = rows.select("graph", F.col(label).alias("label")).distinct()
    return names.withColumn("v", (F.row_number().over(Window.partitionBy("graph").orderBy("label")) - 1).cast("long"))


def slots(edges: DataFrame, *columns: str) -> DataFrame:
    """Both directions (x, c) of each edge, with more columns of it."""
    one = edges.select("graph", F.col("u").alias("x"), F.col("v").alias("c"), F.col("u"), F.col("v"), *columns)
    two = edges.select("graph", F.col("v").alias("x"), F.col("u").alias("c"), F.col("u"), F.col("v"), *columns)
    return one.unionByName(two)


def adjacency(edges: DataFrame) -> DataFrame:
    """graph, v, neighbours (sorted array).  For graphs of bounded degree; plans use ``slots``."""
    return slots(edges).groupBy("graph", F.col("x").alias("v")).agg(F.array_sort(F.collect_set("c")).alias("neighbours"))


def degrees(edges: DataFrame) -> DataFrame:
    """graph, v, deg."""
    return slots(edges).groupBy("graph", F.col("x").alias("v")).agg(F.count(F.lit(1)).alias("deg"))


def oriented(edges: DataFrame, deg: DataFrame) -> DataFrame:
    """graph, x, y, dx, dy: each edge from its end that is lower by (degree, id) to the higher one.

    A vertex has few edges towards higher ones even where its degree is huge, which bounds the wedges of a triangle join.
    """
    e = edges.select("graph", "u", "v").join(deg.toDF("graph", "u", "du"), ["graph", "u"]).join(deg.toDF("graph", "v", "dv"), ["graph", "v"])
    low = F.struct("du", "u") < F.struct("dv", "v")
    pick = lambda a, b: F.when(low, F.col(a)).otherwise(F.col(b))
    return e.select("graph", pick("u", "v").alias("x"), pick("v", "u").alias("y"), pick("du", "dv").alias("dx"), pick("dv", "du").alias("dy"))


def triangles(edges: DataFrame, deg: DataFrame, base: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """graph, x, y, z, dx, dy, dz: every triangle once, x < y < z by (degree, id).  ``base``, if given, chooses the edges (x, y) over which they are listed."""
    f = oriented(edges, deg)
    g = f.select("graph", "x", F.col("y").alias("z"), F.col("dy").alias("dz"))
    wedges = (base(f) if base else f).join(g, ["graph", "x"]).filter(F.struct("dy", "y") < F.struct("dz", "z"))
    closing = f.select("graph", F.col("x").alias("y"), F.col("y").alias("z"))
    return wedges.join(closing, ["graph", "y", "z"], "left_semi").select("graph", "x", "y", "z", "dx", "dy", "dz")


def triangle_edges(tri: DataFrame) -> DataFrame:
    """graph, u, v: the three edges of each triangle."""
    pair = lambda a, b: F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    return tri.select("graph", F.explode(F.array(pair("x", "y"), pair("x", "z"), pair("y", "z"))).alias("e")).select("graph", "e.u", "e.v")


def copy_bearing_k3(edges: DataFrame) -> DataFrame:
    """graph, u, v, copies: the edges on a triangle and their number of triangles."""
    return triangle_edges(triangles(edges, degrees(edges))).groupBy("graph", "u", "v").agg(F.count(F.lit(1)).alias("copies"))


def codegrees(edges: DataFrame, most: int | None = None) -> DataFrame:
    """graph, a, b, codegree: common neighbours of each pair that has one, a < b.  With ``most``, middle vertices of higher degree are left out, so
    counts are lower bounds."""
    s = slots(edges).select("graph", "x", "c")
    if most is not None:
        low = degrees(edges).filter(F.col("deg") <= most).select("graph", F.col("v").alias("x"))
        s = s.join(low, ["graph", "x"], "left_semi")
    w = s.withColumnRenamed("c", "a").join(s.withColumnRenamed("c", "b"), ["graph", "x"]).filter("a < b")
    return w.groupBy("graph", "a", "b").agg(F.count(F.lit(1)).alias("codegree"))


def c4_total(codegree: DataFrame) -> DataFrame:
    """graph, n_c4: a four-cycle has two diagonals, so half the pairs of common neighbours."""
    return codegree.groupBy("graph").agg(F.expr("sum(codegree * (codegree - 1) div 2) div 2").alias("n_c4"))


def copy_bearing_c4(edges: DataFrame, most: int | None = None) -> DataFrame:
    """graph, u, v: the edges on a four-cycle. (u, v) is on one if another neighbour of v shares two neighbours with u."""
    heavy = codegrees(edges, most).filter("codegree >= 2")
    both = heavy.select("graph", F.col("a").alias("x"), F.col("b").alias("w")).unionByName(heavy.select("graph", F.col("b").alias("x"), F.col("a").alias("w")))
    s = slots(edges).select("graph", "x", "c")
    via = s.join(s.select("graph", F.col("x").alias("w"), "c"), ["graph", "c"]).filter("x <> w").join(both, ["graph", "x", "w"], "left_semi")
    return via.select("graph", F.least("x", "c").alias("u"), F.greatest("x", "c").alias("v")).distinct()


def floor_degree(tri: DataFrame) -> DataFrame:
    """graph, tau: the largest, over triangles, of the least degree in it."""
    return tri.groupBy("graph").agg(F.max(F.least("dx", "dy", "dz")).alias("tau"))


def incidence_graph(incidence: DataFrame) -> DataFrame:
    """Edges between ``v:`` vertices and ``e:`` hyperedges, as canonical edges over strings."""
    e = incidence.select("graph", F.concat(F.lit("v:"), F.col("v").cast("string")).alias("a"), F.concat(F.lit("e:"), F.col("hid").cast("string")).alias("b"))
    return e.select("graph", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
