"""Hypergraphs and their projection: normal form, edges with multiplicities, covered and cross triangles, four-cycles.

A ``Closure`` is a lazy bundle of DataFrames over one or more hypergraphs, told apart by the column ``graph``; Catalyst plans
whichever of them a query asks for.  Edges are named by their ends (u, v), so no global numbering is needed.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.ranks import positions
from . import graphs
from .blocks import Blocks

MAX_SIZE = 25


def normalise(incidence: DataFrame, max_size: int = MAX_SIZE) -> DataFrame:
    """graph, hid, members (sorted distinct array), size; 2 to ``max_size`` members, of equal hyperedges the one with the smallest hid.

    Sizes are counted before members are gathered, so a hyperedge that is too large is never an array.
    """
    inc = incidence.select("graph", "hid", "v").distinct()
    fit = inc.groupBy("graph", "hid").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size").between(2, max_size))
    sets = inc.join(fit, ["graph", "hid"]).groupBy("graph", "hid").agg(F.array_sort(F.collect_list("v")).alias("members"))
    return sets.groupBy("graph", "members").agg(F.min("hid").alias("hid")).select("graph", "hid", "members", F.size("members").alias("size"))


def first_hyperedges(hyperedges: DataFrame, k: int) -> DataFrame:
    """The first k hyperedges of each graph by hid."""
    return hyperedges.withColumn("_r", F.row_number().over(Window.partitionBy("graph").orderBy("hid"))).filter(F.col("_r") <= k).drop("_r")


def _pairs(members: Column) -> Column:
    """All pairs (u, v), u < v, of a sorted array."""
    n = F.size(members)
    return F.flatten(F.transform(members, lambda a, i: F.transform(F.slice(members, i + 2, n), lambda b: F.struct(a.alias("u"), b.alias("v")))))


class Closure:
    def __init__(self, hyperedges: DataFrame):
        self.hyperedges = hyperedges
        self._kept = False

    @classmethod
    def of(cls, incidence: DataFrame, max_size: int = MAX_SIZE) -> Closure:
        return cls(normalise(incidence, max_size))

    def persisted(self) -> Closure:
        """Computes the hyperedges, edges and counts once, for callers that ask many questions of one closure.  Triangles are listed where they are read."""
        if not self._kept:
            self._kept = True
            if self._numbered:
                self.__dict__["edges"] = self.edge_table.select("graph", "u", "v", "nhy", "hsum", "hmax")
                self.__dict__["degrees"] = self.blocks.degrees
            else:
                self.hyperedges = cut(self.hyperedges)
                for name in ("edges", "degrees", "covered", "cross", "edge_cross"):
                    self.__dict__[name] = cut(getattr(self, name))
        return self

    @property
    def _numbered(self) -> bool:
        """Whether vertices are whole numbers, whose triangles are listed by blocks; other names take the joins of ``graphs``."""
        return self.hyperedges.schema["members"].dataType.elementType.typeName() in ("integer", "long")

    @cached_property
    def blocks(self) -> Blocks:
        self.hyperedges = cut(self.hyperedges)
        return Blocks(self.hyperedges)

    @cached_property
    def edge_table(self) -> DataFrame:
        """The edges with nhy, hsum, hmax, t, covn, copies (triangles) and the degrees du, dv of their ends, for vertices that are whole numbers."""
        return self.blocks.table()

    @cached_property
    def incidence(self) -> DataFrame:
        return self.hyperedges.select("graph", "hid", "size", F.explode("members").alias("v"))

    @cached_property
    def edges(self) -> DataFrame:
        """graph, u, v, nhy (hyperedges that hold both), hsum (sum of their sizes less 2), hmax (largest size)."""
        p = self.hyperedges.select("graph", "size", F.explode(_pairs(F.col("members"))).alias("p")).select("graph", "size", "p.u", "p.v")
        return p.groupBy("graph", "u", "v").agg(F.count(F.lit(1)).alias("nhy"), F.sum(F.col("size") - 2).cast("long").alias("hsum"), F.max("size").cast("long").alias("hmax"))

    @cached_property
    def degrees(self) -> DataFrame:
        return graphs.degrees(self.edges)

    @cached_property
    def vertices(self) -> DataFrame:
        """graph, v, deg, n_hyper, rk (position by degree and id)."""
        n = self.incidence.groupBy("graph", "v").agg(F.count(F.lit(1)).alias("n_hyper"))
        return positions(self.degrees.join(n, ["graph", "v"]), ["graph"], ["deg", "v"], "rk")

    @cached_property
    def triangles(self) -> DataFrame:
        return self.blocks.triangles(False) if self._numbered else graphs.triangles(self.edges, self.degrees)

    @cached_property
    def triangle_count(self) -> DataFrame:
        """n, the triangles of all graphs; numbered ones are counted where they are listed."""
        if self._numbered:
            return self.blocks.census().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        return self.triangles.agg(F.count(F.lit(1)).alias("n"))

    @cached_property
    def floor_degree(self) -> DataFrame:
        """graph, tau: the largest, over triangles, of the least degree in it."""
        return self.blocks.census(True).groupBy("graph").agg(F.max("tau").alias("tau")) if self._numbered else graphs.floor_degree(self.triangles)

    @cached_property
    def covered(self) -> DataFrame:
        """graph, a, b, c (a < b < c): triples inside one hyperedge."""
        m = F.col("members")
        n = F.size(m)
        inner = lambda a, i: F.transform(_pairs(F.slice(m, i + 2, n)), lambda p: F.struct(a.alias("a"), p["u"].alias("b"), p["v"].alias("c")))
        t = self.hyperedges.filter("size >= 3").select("graph", F.explode(F.flatten(F.transform(m, inner))).alias("t"))
        return t.select("graph", "t.a", "t.b", "t.c").distinct()

    @cached_property
    def cross(self) -> DataFrame:
        """graph, x, y, z, dx, dy, dz: the triangles that no hyperedge holds, x < y < z by (degree, id)."""
        return self.blocks.triangles(True) if self._numbered else self._uncovered(self.triangles)

    def _uncovered(self, triangles: DataFrame) -> DataFrame:
        s = F.array_sort(F.array("x", "y", "z"))
        t = triangles.withColumn("a", s[0]).withColumn("b", s[1]).withColumn("c", s[2])
        return t.join(self.covered, ["graph", "a", "b", "c"], "left_anti").drop("a", "b", "c")

    @cached_property
    def edge_cross(self) -> DataFrame:
        """The edges with t, their cross triangles."""
        if self._numbered:
            return self.edge_table.select("graph", "u", "v", "nhy", "hsum", "hmax", "t")
        t = graphs.triangle_edges(self.cross).groupBy("graph", "u", "v").agg(F.count(F.lit(1)).alias("t"))
        return self.edges.join(t, ["graph", "u", "v"], "left").withColumn("t", F.coalesce("t", F.lit(0)))

    @cached_property
    def edge_difference(self) -> DataFrame:
        """``edge_cross`` by a second plan, without listing cross triangles: common neighbours less covered ones."""
        if self._numbered:
            return self.edge_table.select("graph", "u", "v", "nhy", "hsum", "hmax", "covn", (F.col("copies") - F.col("covn")).alias("t"))
        n = graphs.copy_bearing_k3(self.edges)
        t = F.coalesce("copies", F.lit(0)) - F.col("covn")
        return self.edge_t.drop("t").join(n, ["graph", "u", "v"], "left").withColumn("t", t).drop("copies")

    @cached_property
    def edge_t(self) -> DataFrame:
        """The edges with t (cross triangles) and covn (common neighbours that a hyperedge of the edge holds)."""
        if self._numbered:
            return self.edge_table.select("graph", "u", "v", "nhy", "hsum", "hmax", "t", "covn")
        c = self.covered.select("graph", F.col("a").alias("x"), F.col("b").alias("y"), F.col("c").alias("z"))
        c = graphs.triangle_edges(c).groupBy("graph", "u", "v").agg(F.count(F.lit(1)).alias("covn"))
        return self.edge_cross.join(c, ["graph", "u", "v"], "left").withColumn("covn", F.coalesce("covn", F.lit(0)))

    @cached_property
    def edge_degrees(self) -> DataFrame:
        """``edge_cross`` with the degrees of both ends."""
        if self._numbered:
            return self.edge_table.select("graph", "u", "v", "nhy", "hsum", "hmax", "t", "du", "dv")
        d = self.degrees
        return self.edge_cross.join(d.toDF("graph", "u", "du"), ["graph", "u"]).join(d.toDF("graph", "v", "dv"), ["graph", "v"])

    @cached_property
    def stats(self) -> DataFrame:
        """graph, m, n_cross, n_triangles.  Covered triples are triangles too, so both kinds are counted where they are listed."""
        if self._numbered:
            third = lambda x: F.expr(f"sum({x}) div 3")
            return self.edge_table.groupBy("graph").agg(F.count(F.lit(1)).alias("m"), third("t").alias("n_cross"), third("copies").alias("n_triangles"))
        e = self.edges.groupBy("graph").agg(F.count(F.lit(1)).alias("m"))
        n = self.cross.groupBy("graph").agg(F.count(F.lit(1)).alias("n_cross"))
        k = self.covered.groupBy("graph").agg(F.count(F.lit(1)).alias("k"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        return e.join(n, "graph", "left").join(k, "graph", "left").select("graph", "m", zero("n_cross").alias("n_cross"), (zero("n_cross") + zero("k")).alias("n_triangles"))

    @cached_property
    def copy_bearing(self) -> DataFrame:
        """graph, u, v, copies: the edges on a triangle and their number of triangles."""
        return self.edge_table.filter("copies > 0").select("graph", "u", "v", "copies") if self._numbered else graphs.copy_bearing_k3(self.edges)

    @cached_property
    def copy_edges(self) -> DataFrame:
        return self.edge_cross.filter("t > 0")

    def sampled_cross(self, max_triples: int, seed: int = 0) -> DataFrame:
        """Cross triangles whose base edge (x, y) is drawn with chance p = min(1, max_triples / #cross), with scale 1/p; the draw is a hash of the edge."""
        p = F.least(F.lit(1.0), F.lit(float(max_triples)) / F.greatest("n_cross", F.lit(1)))
        draw = F.pmod(F.xxhash64(F.lit(seed), F.least("x", "y"), F.greatest("x", "y")), F.lit(1 << 30)) / F.lit(float(1 << 30))
        chance = self.stats.select("graph", p.alias("p"))
        if self._numbered:
            return self.cross.join(chance, "graph").filter(draw < F.col("p")).withColumn("scale", 1 / F.col("p")).drop("p")
        # base edges are drawn before triangles are listed over them
        drawn = lambda base: base.join(chance, "graph").filter(draw < F.col("p")).drop("p")
        t = self._uncovered(graphs.triangles(self.edges, self.degrees, drawn))
        return t.join(chance, "graph").withColumn("scale", 1 / F.col("p")).drop("p")

    def within_guard(self, **guard) -> Closure:
        """The graphs whose four-cycles are few enough to be listed."""
        ok = self.c4_guard(**guard).filter("ok").select("graph")
        return Closure(cut(self.hyperedges.join(ok, "graph", "left_semi")))

    @cached_property
    def c4(self) -> DataFrame:
        """graph, a, b, x, y, u1, v1, u2, v2: cross four-cycles a-x-b-y, each once, with the perfect matching that holds its least edge.

        The diagonals are (a, b) and (x, y); the smaller one comes first.
        """
        s = graphs.slots(self.edges).select("graph", "x", "c")
        w = s.withColumnRenamed("c", "a").join(s.withColumnRenamed("c", "b"), ["graph", "x"]).filter("a < b")
        q = w.join(w.withColumnRenamed("x", "y"), ["graph", "a", "b"]).filter("x < y").filter(F.struct("a", "b") <= F.struct("x", "y"))
        quad = F.array_sort(F.array("a", "b", "x", "y"))
        held = self._covered_quads
        q = q.withColumn("q", quad).join(held, ["graph", "q"], "left_anti").drop("q")
        e = lambda p, r: F.struct(F.least(p, r).alias("u"), F.greatest(p, r).alias("v"))
        q = q.select("graph", "a", "b", "x", "y", e("a", "x").alias("ax"), e("b", "y").alias("by"), e("x", "b").alias("xb"), e("y", "a").alias("ya"))
        first = F.least("ax", "by") <= F.least("xb", "ya")
        one, two = F.when(first, F.col("ax")).otherwise(F.col("xb")), F.when(first, F.col("by")).otherwise(F.col("ya"))
        return q.select("graph", "a", "b", "x", "y", one.alias("e1"), two.alias("e2")).select("graph", "a", "b", "x", "y", F.col("e1.u").alias("u1"), F.col("e1.v").alias("v1"), F.col("e2.u").alias("u2"), F.col("e2.v").alias("v2"))

    @cached_property
    def _covered_quads(self) -> DataFrame:
        m = F.col("members")
        n = F.size(m)
        triples = lambda rest: F.flatten(F.transform(rest, lambda b, j: F.transform(_pairs(F.slice(rest, j + 2, F.size(rest))), lambda p: F.array(b, p["u"], p["v"]))))
        quads = F.flatten(F.transform(m, lambda a, i: F.transform(triples(F.slice(m, i + 2, n)), lambda t: F.concat(F.array(a), t))))
        return self.hyperedges.filter("size >= 4").select("graph", F.explode(quads).alias("q")).distinct()

    @cached_property
    def c4_edge_t(self) -> DataFrame:
        """The edges with t4, the cross four-cycles in whose matching they stand."""
        if self._numbered:
            # the cycles of a covered quad all count, so they are taken off again: (a, b), (c, d) stand in two of the three, (a, c), (b, d) in one
            own = self.blocks.cycles()
            off = F.explode(F.array(*[F.struct(F.col("q")[i].alias("u"), F.col("q")[j].alias("v"), F.lit(-k).cast("long").alias("t4")) for i, j, k in ((0, 1, 2), (2, 3, 2), (0, 2, 1), (1, 3, 1))]))
            off = self._covered_quads.select("graph", off.alias("e")).select("graph", "e.u", "e.v", "e.t4")
            every = self.edges.select("graph", "u", "v", F.lit(0).cast("long").alias("t4")).unionByName(own).unionByName(off)
            return every.groupBy("graph", "u", "v").agg(F.sum("t4").alias("t4"))
        ends = self.c4.select("graph", F.explode(F.array(F.struct(F.col("u1").alias("u"), F.col("v1").alias("v")), F.struct(F.col("u2").alias("u"), F.col("v2").alias("v")))).alias("e"))
        t = ends.groupBy("graph", F.col("e.u").alias("u"), F.col("e.v").alias("v")).agg(F.count(F.lit(1)).alias("t4"))
        return self.edges.select("graph", "u", "v").join(t, ["graph", "u", "v"], "left").withColumn("t4", F.coalesce("t4", F.lit(0)))

    def c4_guard(self, max_c4: int = 15_000_000, max_sumdeg2: float = 5e7, max_n: int = 3500) -> DataFrame:
        """graph, ok, reason, n_c4: whether the four-cycles are few enough to be listed.  The guards are asked in order; the first that is broken is the reason.
        Wedges are counted only in graphs that pass the guards on vertices and degrees."""
        d = self.degrees.groupBy("graph").agg(F.count(F.lit(1)).alias("n"), F.sum(F.pow("deg", F.lit(2.0))).alias("s"))
        cheap = self.edges.join(d.filter((F.col("n") <= max_n) & (F.col("s") <= max_sumdeg2)).select("graph"), "graph", "left_semi")
        total = d.join(graphs.c4_total(graphs.codegrees(cheap)), "graph", "left").withColumn("n_c4", F.coalesce("n_c4", F.lit(0)))
        reason = F.when(F.col("n") > max_n, "vertices").when(F.col("s") > max_sumdeg2, "sum of squared degrees").when(F.col("n_c4") > max_c4, "four-cycles")
        return total.select("graph", reason.isNull().alias("ok"), F.coalesce(reason, F.lit("")).alias("reason"), F.when(reason.isNull() | (reason == "four-cycles"), F.col("n_c4")).alias("n_c4"))
