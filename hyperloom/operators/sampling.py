"""The estimators run for real: draws of paths, permutation nulls, bootstraps.

Draws are a hash of (seed, repetition, draw), so reruns and lost executors give the same rows.  A draw picks a base edge by its weight and
a closing neighbour by weight: both look up a cumulative sum.  The sums are cut into cells that hold bounded numbers of rows,
and draws meet their cell in an equi-join, so no table of weights is broadcast or gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import correlation
from ..functions.lineage import cut
from ..functions.ranks import positions
from . import graphs, scores
from .hypergraph import Closure


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def draws(c: Closure, weights: DataFrame, k: int, reps: int, seed: int = 0) -> DataFrame:
    """graph, rep, draw, x, y, cc, value, hit, cross, persistent: k draws for each repetition; ``value`` is one over the path's chance if it closes
    a triangle in canonical order, else 0."""
    spark = weights.sparkSession
    deg = c.degrees
    big, local = scores.totals(weights)
    w = weights.join(c.edges.select("graph", "u", "v", "nhy"), ["graph", "u", "v"])
    cells = max(1, int(w.count()) // 1024 + 1)
    # base edges: running sums over cells of a hash order, then inside a cell
    e = w.withColumn("cell", F.pmod(F.xxhash64("u", "v"), F.lit(cells))).withColumn("wp", F.col("w") + 1)
    inside = F.sum("wp").over(Window.partitionBy("graph", "cell").orderBy("u", "v").rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("top", inside)
    cell = e.groupBy("graph", "cell").agg(F.sum("wp").alias("cw"))
    cell = cell.withColumn("cto", F.sum("cw").over(Window.partitionBy("graph").orderBy("cell"))).withColumn("cfrom", F.col("cto") - F.col("cw"))
    cell = cell.join(big, "graph")
    # cells meet draws by 1/4096 parts of the unit interval
    parts = 4096
    share = cell.select("graph", "cell", "cfrom", "cto", "big_w", F.explode(F.sequence(F.floor(F.col("cfrom") / F.col("big_w") * parts), F.least(F.floor(F.col("cto") / F.col("big_w") * parts), F.lit(parts - 1)))).alias("part"))
    names = c.stats.select("graph")
    d = spark.range(reps * k).select((F.col("id") % reps).cast("int").alias("rep"), F.floor(F.col("id") / reps).alias("draw")).join(F.broadcast(names))
    d = d.withColumn("r", uniform(F.lit(seed), F.lit(1), "graph", "rep", "draw")).withColumn("part", F.floor(F.col("r") * parts))
    d = d.join(share, ["graph", "part"]).withColumn("at", F.col("r") * F.col("big_w")).filter("at >= cfrom and at < cto").withColumn("at", F.col("at") - F.col("cfrom"))
    e = e.withColumn("low", F.col("top") - F.col("wp")).select("graph", "cell", "u", "v", "low", "top", "nhy", F.col("wp").alias("w_xy"))
    b = d.join(e, ["graph", "cell"]).filter("at >= low and at < top").select("graph", "rep", "draw", "u", "v", "w_xy", "big_w", F.col("nhy").alias("n1"))
    b = b.join(deg.toDF("graph", "u", "du"), ["graph", "u"]).join(deg.toDF("graph", "v", "dv"), ["graph", "v"])
    low = F.struct("du", "u") < F.struct("dv", "v")
    b = b.select("graph", "rep", "draw", F.when(low, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("y"), F.when(low, F.col("dv")).otherwise(F.col("du")).alias("dy"), "w_xy", "big_w", "n1")
    # the closing neighbour: running sums around x in sub-cells of its neighbours
    s = graphs.slots(weights.join(c.edges.select("graph", "u", "v", "nhy"), ["graph", "u", "v"]), "w", "nhy").select("graph", "x", "c", (F.col("w") + 1).alias("w_xz"), F.col("nhy").alias("n2"))
    s = s.withColumn("sub", F.pmod(F.xxhash64("c"), F.lit(16)))
    s = s.withColumn("stop", F.sum("w_xz").over(Window.partitionBy("graph", "x", "sub").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)))
    sub = s.groupBy("graph", "x", "sub").agg(F.sum("w_xz").alias("sw"))
    sub = sub.withColumn("sto", F.sum("sw").over(Window.partitionBy("graph", "x").orderBy("sub"))).withColumn("sfrom", F.col("sto") - F.col("sw"))
    b = b.join(local.select("graph", "x", "d"), ["graph", "x"]).withColumn("at", uniform(F.lit(seed), F.lit(2), "graph", "rep", "draw") * F.col("d"))
    b = b.join(sub.select("graph", "x", "sub", "sfrom", "sto"), ["graph", "x"]).filter("at >= sfrom and at < sto").withColumn("at", F.col("at") - F.col("sfrom"))
    s = s.withColumn("slow", F.col("stop") - F.col("w_xz"))
    b = b.join(s, ["graph", "x", "sub"]).filter("at >= slow and at < stop").withColumnRenamed("c", "cc")
    b = b.join(deg.toDF("graph", "cc", "dc"), ["graph", "cc"])
    order = (F.col("cc") != F.col("y")) & (F.struct("dc", "cc") > F.struct("dy", "y"))
    third = graphs.slots(c.edges, "nhy").select("graph", F.col("x").alias("y"), F.col("c").alias("cc"), F.col("nhy").alias("n3"))
    b = b.join(third, ["graph", "y", "cc"], "left").withColumn("hit", order & F.col("n3").isNotNull())
    t = F.array_sort(F.array("x", "y", "cc"))
    cov = c.covered.select("graph", "a", "b", F.col("c").alias("c3"), F.lit(True).alias("cov"))
    b = b.withColumn("a", t[0]).withColumn("b", t[1]).withColumn("c3", t[2]).join(cov, ["graph", "a", "b", "c3"], "left")
    value = F.when(F.col("hit"), F.col("big_w") * F.col("d") / (F.col("w_xy") * F.col("w_xz"))).otherwise(0.0)
    cross = F.col("hit") & F.col("cov").isNull()
    return b.select("graph", "rep", "draw", "x", "y", "cc", value.alias("value"), "hit", cross.alias("cross"), (cross & (F.least("n1", "n2", "n3") >= 2)).alias("persistent"))


def _estimate(flag: str, k: int) -> Column:
    return F.sum(F.when(F.col(flag), F.col("value")).otherwise(0.0)) / F.lit(float(k))


def simulate_estimator(c: Closure, weights: DataFrame, k: int, reps: int = 20, seed: int = 0) -> DataFrame:
    """graph, rep, estimate of the number of cross triangles."""
    return draws(c, weights, k, reps, seed).groupBy("graph", "rep").agg(_estimate("cross", k).alias("estimate"))


def simulate_profile(c: Closure, weights: DataFrame, k: int, reps: int = 20, seed: int = 0) -> DataFrame:
    """graph, rep, triangles, cross, persistent, all from the same draws."""
    return draws(c, weights, k, reps, seed).groupBy("graph", "rep").agg(_estimate("hit", k).alias("n_triangles"), _estimate("cross", k).alias("n_cross"), _estimate("persistent", k).alias("n_persistent"))


def simulate_vertex_scores(c: Closure, weights: DataFrame, k: int, reps: int = 10, seed: int = 0) -> DataFrame:
    """graph, rep, v, score: each path found adds its value to its three vertices."""
    d = draws(c, weights, k, reps, seed).filter("cross")
    return d.select("graph", "rep", "value", F.explode(F.array("x", "y", "cc")).alias("v")).groupBy("graph", "rep", "v").agg((F.sum("value") / F.lit(float(k))).alias("score"))


def monte_carlo_check(c: Closure, weights: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """graph, hit_rate and p, the exact chance that it estimates."""
    rate = draws(c, weights, k, 1, seed).groupBy("graph").agg((F.sum(F.col("cross").cast("long")) / F.lit(float(k))).alias("hit_rate"))
    return rate.join(scores.p_succ(c, weights), "graph")


def errors(estimates: DataFrame, truth: DataFrame) -> DataFrame:
    """graph, bias and relative root mean square error of the estimates; ``truth`` has graph and n_cross."""
    d = estimates.join(truth.select("graph", "n_cross"), "graph").withColumn("d", F.try_divide("estimate", "n_cross") - 1)
    return d.groupBy("graph").agg(F.avg("d").alias("bias"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.count(F.lit(1)).alias("reps"))


def numbered_edges(c: Closure) -> DataFrame:
    """The edges with eid, their position by (u, v) in each graph, for shuffles that must repeat NumPy's."""
    return positions(c.edge_cross, ["graph"], ["u", "v"], "eid")


#: Edges and triples up to which a permutation null runs on arrays in one task per few seeds; larger graphs shuffle by joins.
ARRAY_EDGES, ARRAY_TRIPLES = 2_000_000, 4_000_000


def permutation_null(c: Closure, graph: str, n_perm: int, seed: int = 0, kind: str = "path") -> DataFrame:
    """graph, seed, perm: the score under the perfect weights shuffled over the edges by ``numpy.random.default_rng(seed + b).permutation`` in the order of (u, v).

    ``kind``: ``path`` (chance of a hit), ``wedge`` (words of the wedge estimator) or ``c4``.  Graphs within the bounds are sent as arrays, whose size is checked;
    beyond, ``permutation_null_joined`` gives the same distribution without arrays.
    """
    spark = c.hyperedges.sparkSession
    e = numbered_edges(c).filter(F.col("graph") == graph)
    if kind == "c4":
        e = e.drop("t").join(c.c4_edge_t.withColumnRenamed("t4", "t"), ["graph", "u", "v"])
    m = e.count()
    n_t = (c.c4 if kind == "c4" else c.cross).filter(F.col("graph") == graph).count()
    if m > ARRAY_EDGES or n_t > ARRAY_TRIPLES:
        return permutation_null_joined(c, n_perm, seed, kind).filter(F.col("graph") == graph)
    pdf = e.select("eid", "u", "v", "t").toPandas().sort_values("eid")
    u, v, t = pdf.u.to_numpy(), pdf.v.to_numpy(), pdf.t.to_numpy(float)
    names = np.unique(np.concatenate([u, v]))
    iu, iv = np.searchsorted(names, u), np.searchsorted(names, v)
    key = {(a, b): i for i, (a, b) in enumerate(zip(u.tolist(), v.tolist()))}
    eid = lambda a, b: np.array([key[(p, q) if p < q else (q, p)] for p, q in zip(a.tolist(), b.tolist())], np.int64)
    if kind == "c4":
        q = c.c4.filter(F.col("graph") == graph).select("u1", "v1", "u2", "v2").toPandas()
        arrays = (eid(q.u1, q.v1), eid(q.u2, q.v2))
    else:
        q = c.cross.filter(F.col("graph") == graph).select("x", "y", "z").toPandas()
        arrays = (eid(q.x, q.y), eid(q.x, q.z), eid(q.y, q.z), np.searchsorted(names, q.x.to_numpy()))
    n = len(names)
    truth = len(arrays[0])

    def score(w: np.ndarray) -> float:
        wp = w + 1
        if kind == "c4":
            return float((wp[arrays[0]] * wp[arrays[1]]).sum() / wp.sum() ** 2)
        d = np.bincount(iu, wp, n) + np.bincount(iv, wp, n)
        a, b = wp[arrays[0]], wp[arrays[1]]
        if kind == "path":
            return float((a * b / d[arrays[3]]).sum() / wp.sum())
        y = wp[arrays[2]]
        sq = np.bincount(iu, wp * wp, n) + np.bincount(iv, wp * wp, n)
        m2 = float((1 / (a * b) + 1 / (a * y) + 1 / (b * y)).sum()) * float((d * d - sq).sum()) / 18
        return max(m2 - truth**2, 0.0) / (0.1 * truth) ** 2 if truth else float("inf")

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"graph": graph, "seed": b.id, "perm": [score(np.random.default_rng(int(s)).permutation(t)) for s in b.id]})

    return spark.range(seed, seed + n_perm).mapInPandas(run, "graph string, seed long, perm double")


def permutation_null_joined(c: Closure, n_perm: int, seed: int = 0, kind: str = "path") -> DataFrame:
    """The same null for any size: edges ranked by a hash of the seed take the weights in the order of (u, v); one plan over all seeds."""
    spark = c.hyperedges.sparkSession
    e = numbered_edges(c)
    if kind == "c4":  # four-cycles are shuffled by their own counts
        e = e.drop("t").join(c.c4_edge_t.withColumnRenamed("t4", "t"), ["graph", "u", "v"])
    e = cut(e.select("graph", "u", "v", "t", "eid"))
    seeds = spark.range(seed, seed + n_perm).withColumnRenamed("id", "seed")
    shuffled = positions(e.join(F.broadcast(seeds)).withColumn("h", F.xxhash64("seed", "u", "v")), ["graph", "seed"], ["h", "u", "v"], "r")
    w = shuffled.select("graph", "seed", "u", "v", F.col("r").alias("eid")).join(e.select("graph", "eid", F.col("t").cast("double").alias("w")), ["graph", "eid"])
    # every (graph, seed) is a graph of its own to the scoring plan
    tag = F.concat_ws("#", "graph", "seed")
    w = w.select(tag.alias("graph"), "u", "v", "w")
    tagged = Closure(c.hyperedges.join(F.broadcast(seeds)).withColumn("graph", tag).drop("seed"))
    # listed once, not once a seed
    for name in ("c4",) if kind == "c4" else ("cross", "stats"):
        tagged.__dict__[name] = cut(getattr(c, name)).join(F.broadcast(seeds)).withColumn("graph", tag).drop("seed")
    if kind == "c4":
        p = scores.c4_success(tagged, w)
    elif kind == "path":
        p = scores.p_succ(tagged, w, cross=tagged.cross)
    else:
        p = scores.wedge_weighted_cost(tagged, w, cross=tagged.cross).select("graph", F.col("words").alias("p"))
    return p.select(F.substring_index("graph", "#", 1).alias("graph"), F.substring_index("graph", "#", -1).cast("long").alias("seed"), F.col("p").alias("perm"))


def bootstrap_mean(values: DataFrame, column: str, b: int = 2000, seed: int = 0) -> DataFrame:
    """mean, lo, hi: the mean of the column without NaN and null, and the 2.5 and 97.5 percentiles of resampled means.  ``values`` is a report, a row per graph or pair."""
    v = values.select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    v = v.withColumn("i", F.row_number().over(Window.orderBy("x")) - 1)
    n = v.count()
    spark = values.sparkSession
    pick = spark.range(b * n).select(F.floor(F.col("id") / max(n, 1)).alias("b"), F.floor(uniform(F.lit(seed), "id") * n).cast("int").alias("i")) if n else spark.createDataFrame([], "b long, i int")
    means = pick.join(F.broadcast(v), "i").groupBy("b").agg(F.avg("x").alias("mean"))
    return means.agg(F.percentile("mean", F.lit(0.025)).alias("lo"), F.percentile("mean", F.lit(0.975)).alias("hi")).join(v.agg(F.avg("x").alias("mean")))


def cluster_bootstrap(pairs: DataFrame, column: str, train: str = "train", test: str = "test", b: int = 4000, seed: int = 0) -> DataFrame:
    """lo, hi: graphs are resampled, and a pair weighs the product of how often its two graphs were drawn."""
    spark = pairs.sparkSession
    names = pairs.select(F.col(train).alias("g")).union(pairs.select(F.col(test).alias("g"))).distinct()
    names = names.withColumn("i", F.row_number().over(Window.orderBy("g")) - 1)
    n = names.count()
    pick = spark.range(b * n).select(F.floor(F.col("id") / n).alias("b"), F.floor(uniform(F.lit(seed), "id") * n).cast("int").alias("i"))
    cnt = pick.groupBy("b", "i").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(names), "i").select("b", "g", "k")
    p = pairs.select(F.col(train).alias("tr"), F.col(test).alias("te"), F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    w = p.join(cnt.select("b", F.col("g").alias("tr"), F.col("k").alias("k1")), "tr").join(cnt.select("b", F.col("g").alias("te"), F.col("k").alias("k2")), ["b", "te"])
    means = w.groupBy("b").agg((F.sum(F.col("x") * F.col("k1") * F.col("k2")) / F.sum(F.col("k1") * F.col("k2"))).alias("mean"))
    return means.agg(F.percentile("mean", F.lit(0.025)).alias("lo"), F.percentile("mean", F.lit(0.975)).alias("hi"))


def bootstrap_slope(rows: DataFrame, y: str, x: str, b: int = 4000, seed: int = 0) -> DataFrame:
    """slope, r and percentiles of both for a line through the rows; null with fewer than four rows; resamples without spread are left out."""
    spark = rows.sparkSession
    v = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    v = v.withColumn("i", F.row_number().over(Window.orderBy("x", "y")) - 1)
    n = v.count()
    pick = spark.range(b * max(n, 1)).select(F.floor(F.col("id") / max(n, 1)).alias("b"), F.floor(uniform(F.lit(seed), "id") * n).cast("int").alias("i"))
    per = pick.join(F.broadcast(v), "i").groupBy("b").agg(F.regr_slope("y", "x").alias("slope"), correlation("y", "x").alias("r"), F.stddev_pop("x").alias("sx")).filter("sx > 1e-9")
    q = lambda c, p: F.percentile(c, F.lit(p))
    ci = per.agg(q("slope", 0.025).alias("slope_lo"), q("slope", 0.975).alias("slope_hi"), q("r", 0.025).alias("r_lo"), q("r", 0.975).alias("r_hi"))
    fit = v.agg(F.regr_slope("y", "x").alias("slope"), correlation("y", "x").alias("r"), F.count(F.lit(1)).alias("n"))
    out = fit.join(ci)
    return out.select(*[F.when(F.col("n") >= 4, F.col(c)).alias(c) for c in ("slope", "slope_lo", "slope_hi", "r", "r_lo", "r_hi")])


def capped_rows(df: DataFrame, most: int = 200_000, seed: int = 0) -> DataFrame:
    """Up to ``most`` rows of each graph for a fit, by a hash order."""
    r = F.row_number().over(Window.partitionBy("graph").orderBy(F.xxhash64(F.lit(seed), "u", "v")))
    return df.withColumn("_r", r).filter(F.col("_r") <= most).drop("_r")


