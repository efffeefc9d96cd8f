"""Mining tasks on closures: vertex ranking, triadic profile, feature diagnosis, domain separation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import correlation, nan, ratio
from . import graphs
from .hypergraph import Closure


def vertex_scores(c: Closure) -> DataFrame:
    """graph, v, score: cross triangles at each vertex, half the sum of t around it."""
    return graphs.slots(c.edge_cross, "t").groupBy("graph", F.col("x").alias("v")).agg(F.expr("sum(t) div 2").alias("score"))


def top_share(scores: DataFrame, k: int = 100) -> DataFrame:
    """graph, share of the k highest scores in their sum; ties by vertex."""
    r = F.row_number().over(Window.partitionBy("graph").orderBy(F.col("score").desc(), "v"))
    # a filter on the rank lets each task keep its own k highest, so no group comes together whole
    top = scores.withColumn("r", r).filter(F.col("r") <= k).groupBy("graph").agg(F.sum("score").alias("top"))
    return scores.groupBy("graph").agg(F.sum("score").alias("every")).join(top, "graph").select("graph", ratio(F.col("top"), F.col("every"), F.lit(0.0)).alias("share"))


def precision_at_k(estimate: DataFrame, exact: DataFrame, k: int = 100) -> DataFrame:
    """graph, precision: the overlap of both top-k sets, k at most the number of vertices; ties by vertex."""
    top = lambda df: df.withColumn("r", F.row_number().over(Window.partitionBy("graph").orderBy(F.col("score").desc(), "v"))).filter(F.col("r") <= k)
    n = exact.groupBy("graph").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n"))
    hits = top(exact).select("graph", "v").join(top(estimate).select("graph", "v"), ["graph", "v"]).groupBy("graph").agg(F.count(F.lit(1)).alias("hits"))
    return n.join(hits, "graph", "left").select("graph", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("precision"))


def rank_correlation(estimate: DataFrame, exact: DataFrame) -> DataFrame:
    """graph, rho: Spearman's correlation over vertices with an exact score above 0, with mean ranks for ties; NaN for fewer than three."""
    both = exact.filter("score > 0").select("graph", "v", F.col("score").alias("a")).join(estimate.select("graph", "v", F.col("score").alias("b")), ["graph", "v"], "left").fillna(0, ["b"])
    for x in ("a", "b"):
        w = Window.partitionBy("graph")
        both = both.withColumn(f"r{x}", F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy("graph", x)) - 1) / 2)
    return both.groupBy("graph").agg(F.when(F.count(F.lit(1)) < 3, nan()).otherwise(correlation("ra", "rb")).alias("rho"))


def profile(c: Closure) -> DataFrame:
    """graph, n_triangles, n_cross, n_persistent, f_cross, f_persistent, f_transient.  A cross triangle persists if each of its pairs meets in two hyperedges."""
    n = c.edge_cross.filter("nhy >= 2 AND t > 0").select("graph", "u", "v", "nhy")  # few; triangles with another edge do not persist
    if c._numbered:
        t = c.blocks.weighted(n.withColumnRenamed("nhy", "w"), lambda a, b, y, d: a * 0 + 1, True)
    else:
        t = c.cross.withColumn("s", F.lit(1))
        for a, b in (("x", "y"), ("x", "z"), ("y", "z")):
            t = t.withColumn("_u", F.least(a, b)).withColumn("_v", F.greatest(a, b)).join(n.select("graph", F.col("u").alias("_u"), F.col("v").alias("_v")), ["graph", "_u", "_v"], "left_semi")
    p = t.groupBy("graph").agg(F.sum("s").cast("long").alias("n_persistent"))
    d = c.stats.join(p, "graph", "left").withColumn("n_persistent", F.coalesce("n_persistent", F.lit(0)))
    keep = ratio(F.col("n_persistent"), F.col("n_cross"), nan())
    return d.select("graph", "n_triangles", "n_cross", "n_persistent", ratio(F.col("n_cross"), F.col("n_triangles"), nan()).alias("f_cross"), keep.alias("f_persistent"), (1 - keep).alias("f_transient"))


def domain_separation(points: DataFrame, columns: list[str]) -> DataFrame:
    """accuracy of the domain of the nearest other point in standardised columns.  ``points`` has label, domain and the columns: a row per graph, so
    pairs of rows are pairs of graphs; the first label wins ties."""
    every = Window.partitionBy()
    z = points.select("label", "domain", *[((F.col(x) - F.avg(x).over(every)) / (F.stddev_pop(x).over(every) + 1e-12)).alias(x) for x in columns])
    o = z.select(F.col("label").alias("l2"), F.col("domain").alias("d2"), *[F.col(x).alias(f"{x}2") for x in columns])
    dist = sum(((F.col(x) - F.col(f"{x}2")) * (F.col(x) - F.col(f"{x}2")) for x in columns), F.lit(0.0))
    near = z.join(o, F.col("label") != F.col("l2")).groupBy("label", "domain").agg(F.min(F.struct(dist.alias("dist"), "l2", "d2")).alias("n"))
    return near.agg(F.avg((F.col("n.d2") == F.col("domain")).cast("double")).alias("accuracy"))


def gini(df: DataFrame, x: str) -> DataFrame:
    """graph, gini of the column; 0 for an empty or all-zero one.  Equal values are counted first, so ranks are sums over distinct values."""
    per = df.groupBy("graph", F.col(x).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("graph").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("ranks", F.col("k") * before + F.col("k") * (F.col("k") + 1) / 2)
    t = per.groupBy("graph").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("x")).alias("s"), F.sum(F.col("ranks") * F.col("x")).alias("rx"))
    return t.select("graph", F.when(F.col("s") == 0, 0.0).otherwise(F.try_divide(2 * F.col("rx") - (F.col("n") + 1) * F.col("s"), F.col("n") * F.col("s"))).alias("gini"))


BLOCKS = {"A": 7, "AB": 12, "ABC": 13}


def features(c: Closure, cores: DataFrame) -> DataFrame:
    """graph, u, v, f1..f13, y, t: degrees and cores (A, 7), memberships and hyperedges of the pair (AB, 12), covered neighbours (ABC, 13); y = log1p(t)."""
    lg = F.log1p
    n = c.incidence.groupBy("graph", "v").agg(F.count(F.lit(1)).alias("k"))
    e = c.edge_degrees.join(c.edge_t.select("graph", "u", "v", "covn"), ["graph", "u", "v"])
    for end in ("u", "v"):
        e = e.join(cores.select("graph", F.col("v").alias(end), F.col("core").alias(f"c{end}")), ["graph", end]).join(n.select("graph", F.col("v").alias(end), F.col("k").alias(f"k{end}")), ["graph", end])
    lo, hi = lambda x: lg(F.least(f"{x}u", f"{x}v")), lambda x: lg(F.greatest(f"{x}u", f"{x}v"))
    f = [lo("d"), hi("d"), lg("du") + lg("dv"), F.abs(lg("du") - lg("dv")), lo("c"), hi("c"), lg("cu") + lg("cv"), lo("k"), hi("k"), lg("nhy"), lg("hsum"), lg("hmax"), lg("covn")]
    return e.select("graph", "u", "v", *[x.alias(f"f{i + 1}") for i, x in enumerate(f)], lg("t").alias("y"), "t")


def gram(feats: DataFrame, block: str = "ABC") -> dict[str, tuple[np.ndarray, float]]:
    """Per graph, the sums of products of (1, features, y), from one pass over the edges; 15 x 15 numbers per graph come to the driver."""
    cols = [F.lit(1.0), *[F.col(f"f{i + 1}") for i in range(BLOCKS[block])], F.col("y")]
    k = len(cols)
    sums = [F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    out = {}
    for r in feats.groupBy("graph").agg(*sums).collect():
        g = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                g[i, j] = g[j, i] = r[f"s{i}_{j}"]
        out[r["graph"]] = (g, g[0, 0])
    return out


def moments(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, population deviations and the centred product sums of (features, y)."""
    n = g[0, 0]
    mean = g[0, 1:] / n
    centred = g[1:, 1:] - n * np.outer(mean, mean)
    return mean, np.sqrt(np.maximum(np.diag(centred) / n, 0)), centred


def in_sample_fit(g: np.ndarray) -> tuple[float, float]:
    """(best correlation of a feature with y, R squared of least squares).  Features may be collinear, so the solution is the pseudo-inverse's."""
    n = g[0, 0]
    _, sd, s = moments(g)
    corr = [abs(s[i, -1]) / (n * sd[i] * sd[-1]) if sd[i] > 1e-9 and sd[-1] > 0 else 0.0 for i in range(len(sd) - 1)]
    z = s / np.outer(sd + 1e-12, sd + 1e-12)
    beta = np.linalg.pinv(z[:-1, :-1], rcond=1e-10) @ z[:-1, -1]
    resid = (z[-1, -1] - 2 * beta @ z[:-1, -1] + beta @ z[:-1, :-1] @ beta) / n * (sd[-1] + 1e-12) ** 2
    return float(max(corr, default=0.0)), float(1 - resid / (sd[-1] ** 2 + 1e-12))


def feature_diagnosis(c: Closure, feats: DataFrame) -> DataFrame:
    """A row per graph: spread of the target, gini, and per block the best single correlation and the in-sample R squared."""
    spark = feats.sparkSession
    fits = []
    for block in BLOCKS:
        for graph, (g, _) in gram(feats, block).items():
            fits.append((graph, block, *in_sample_fit(g)))
    f = spark.createDataFrame(fits, "graph string, block string, corr double, r2 double")
    wide = f.groupBy("graph").pivot("block", list(BLOCKS)).agg(F.first("corr").alias("best_feat_corr"), F.first("r2").alias("r2_in_sample"))
    t = F.col("t").cast("double")
    base = feats.groupBy("graph").agg(
        F.count(F.lit(1)).alias("m"), F.avg((F.col("t") == 0).cast("double")).alias("frac_zero"), F.avg(t).alias("t_mean"), F.stddev_pop(t).alias("t_std"),
        ratio(F.stddev_pop(t), F.avg(t), nan()).alias("t_cv"), F.stddev_pop("y").alias("y_std"),
    )
    n = c.degrees.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    big = c.hyperedges.groupBy("graph").agg(F.max("size").alias("max_hyperedge"))
    return base.join(n, "graph").join(big, "graph").join(gini(feats, "t"), "graph").join(wide, "graph")
