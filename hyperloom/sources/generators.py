"""Synthetic families as Spark plans over ranges.  Plain graphs are (graph, u, v) with string names, hypergraphs are incidence rows (graph, hid, v)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _name(kind: str, *parts: Column | int) -> Column:
    return F.concat_ws("_", F.lit(kind), *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


def _edges(df: DataFrame, graph: str, *pairs: tuple[Column, Column]) -> DataFrame:
    e = df.select(F.explode(F.array(*[F.struct(a.alias("u"), b.alias("v")) for a, b in pairs])).alias("e"))
    return e.select(F.lit(graph).alias("graph"), "e.u", "e.v")


def friendship_and_decoy(spark: SparkSession, s: int, graph: str | None = None) -> DataFrame:
    """s triangles that share one vertex, and a complete bipartite graph with sides of ceil(sqrt(s))."""
    graph = graph or f"friendship_{s}"
    d = math.ceil(math.sqrt(s))
    i, hub = F.col("id"), F.lit("h")
    fans = _edges(spark.range(s), graph, (hub, _name("a", i)), (hub, _name("b", i)), (_name("a", i), _name("b", i)))
    decoy = _edges(spark.range(d * d), graph, (_name("L", F.floor(i / d)), _name("R", i % d)))
    return fans.unionByName(decoy)


def affine_plane(spark: SparkSession, q: int, graph: str | None = None) -> DataFrame:
    """Points and lines of the affine plane over a prime field: a dense graph without a four-cycle."""
    graph = graph or f"affine_{q}"
    i = F.col("id")
    a, b, x = F.floor(i / (q * q)), F.floor(i / q) % q, i % q
    slanted = _edges(spark.range(q**3), graph, (_name("P", x, (a * x + b) % q), _name("L", a, b)))
    upright = _edges(spark.range(q * q), graph, (_name("P", F.floor(i / q), i % q), _name("V", F.floor(i / q))))
    return slanted.unionByName(upright)


def plane_and_butterflies(spark: SparkSession, q: int, gadgets: int, r: int = 3, graph: str | None = None) -> DataFrame:
    """An affine plane and disjoint gadgets, each with two hyperedges of r vertices that share two; only the gadgets hold four-cycles."""
    graph = graph or f"affine_{q}_{gadgets}"
    g = F.col("id")
    pairs = []
    for t in range(2):
        h = _name("H", g, t)
        pairs += [(_name("G", g, 0), h), (_name("G", g, 1), h), *((_name("F", g, t, j), h) for j in range(r - 2))]
    return affine_plane(spark, q, graph).unionByName(_edges(spark.range(gadgets), graph, *pairs))


def cliques_and_cross(spark: SparkSession, cliques: int, size: int, gadgets: int, seed: int = 0, graph: str | None = None) -> DataFrame:
    """Disjoint large hyperedges, and gadgets that close cross triangles over a pair of one clique's vertices.  The pairs are NumPy's for the seed, so
    gadgets are drawn by the driver; their number is the caller's parameter."""
    graph = graph or f"cliques_{size}"
    r = np.random.default_rng(seed)
    rows = []
    for j in range(gadgets):
        first = int(r.integers(cliques)) * size
        pair = r.choice(np.arange(first, first + size), size=2, replace=False)
        apex, hid = cliques * size + j, cliques + 2 * j
        rows += [(hid, int(pair[0])), (hid, apex), (hid + 1, int(pair[1])), (hid + 1, apex)]
    base = spark.range(cliques * size).select(F.floor(F.col("id") / size).alias("hid"), F.col("id").alias("v"))
    return base.unionByName(spark.createDataFrame(rows, "hid long, v long")).select(F.lit(graph).alias("graph"), "hid", "v")


def random_uniform(spark: SparkSession, n: int, hyperedges: int, r: int, seed: int = 0, graph: str = "uniform") -> DataFrame:
    """Hyperedges of r distinct vertices of n, drawn by NumPy in small batches of rows, each from its own stream."""

    def draw(batches):
        import pandas as pd

        for b in batches:
            hid, v = [], []
            for i in b.id:
                hid += [i] * r
                v += np.random.default_rng((seed, int(i))).choice(n, size=r, replace=False).tolist()
            yield pd.DataFrame({"graph": graph, "hid": hid, "v": v})

    return spark.range(hyperedges).mapInPandas(draw, "graph string, hid long, v long")


def hubs(spark: SparkSession, r: int, d: int, graph: str | None = None) -> DataFrame:
    """A hub with 2rd leaves, of which d pairs are joined."""
    graph = graph or f"hubs_{r}_{d}"
    i = F.col("id")
    spokes = _edges(spark.range(2 * r * d), graph, (F.lit("h"), _name("leaf", i)))
    return spokes.unionByName(_edges(spark.range(d), graph, (_name("leaf", i * 2), _name("leaf", i * 2 + 1))))


def set_disjointness(spark: SparkSession, b: int, d: int, x: list[int], y: list[int], graph: str | None = None) -> DataFrame:
    """A complete bipartite graph of b and b vertices, and per index a block of d more, tied to the left side where x is 1 and to the right side where y is 1."""
    graph = graph or f"disjointness_{len(x)}_{b}"
    i = F.col("id")
    base = _edges(spark.range(b * b), graph, (_name("A", F.floor(i / b)), _name("B", i % b)))
    flags = lambda z: F.element_at(F.array(*[F.lit(int(k)) for k in z]), (F.floor(i / (b * d)) + 1).cast("int"))
    block, u, t = F.floor(i / (b * d)), F.floor(i / d) % b, i % d
    for side, z in (("A", x), ("B", y)):
        base = base.unionByName(_edges(spark.range(len(z) * b * d).filter(flags(z) == 1), graph, (_name(side, u), _name("V", block, t))))
    return base
