"""Weightings, success probabilities and costs of sampling estimators, all as joins and sums.

A weighting is a DataFrame (graph, u, v, w); samplers draw by w + 1.  Results have a row per graph.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.ranks import before
from ..functions.scalar import correlation, inf, nan, ratio, samples_for_error
from . import graphs
from .hypergraph import Closure

EPS = 0.1


def weighting(c: Closure, name: str) -> DataFrame:
    """perfect: t; uniform: 0; mindeg: the smaller degree of the two ends.  Their edges come with t."""
    w = {"perfect": F.col("t"), "uniform": F.lit(0), "mindeg": F.least("du", "dv")}[name]
    source = c.edge_degrees if name == "mindeg" else c.edge_cross
    return source.select("graph", "u", "v", w.cast("double").alias("w"), "t")


def totals(weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph, big_w) with the sum of w+1, and (graph, x, d, q) with the sums of w+1 and of its square around each vertex."""
    big = weights.groupBy("graph").agg(F.sum(F.col("w") + 1).alias("big_w"))
    local = graphs.slots(weights, "w").groupBy("graph", "x").agg(F.sum(F.col("w") + 1).alias("d"), F.sum((F.col("w") + 1) * (F.col("w") + 1)).alias("q"))
    return big, local


def weighted_cross(cross: DataFrame, weights: DataFrame, third: bool = False) -> DataFrame:
    """Cross triangles with the w+1 of base (x, y), of closing edge (x, z) and, if asked for, of (y, z)."""
    out = cross
    if "t" in weights.columns:  # an edge without cross triangles meets none
        weights = weights.filter("t > 0")
    for a, b, name in (("x", "y", "w_xy"), ("x", "z", "w_xz"), ("y", "z", "w_yz"))[: 3 if third else 2]:
        w = weights.select("graph", F.col("u").alias("_u"), F.col("v").alias("_v"), (F.col("w") + 1).alias(name))
        out = out.withColumn("_u", F.least(a, b)).withColumn("_v", F.greatest(a, b)).join(w, ["graph", "_u", "_v"]).drop("_u", "_v")
    return out


def _weighed(c: Closure, weights: DataFrame, cross: DataFrame | None, third: bool = False) -> DataFrame:
    """``weighted_cross`` of the triangles given or else of all; the latter get the weights of (x, y) and (x, z) where they are listed, if vertices are numbers."""
    if cross is not None or not c._numbered:
        return weighted_cross(c.cross if cross is None else cross, weights, third)
    some = weights.filter("t > 0") if "t" in weights.columns else weights
    t = c.blocks.weighted(some.select("graph", "u", "v", (F.col("w") + 1).alias("w")))
    if third:
        w = some.select("graph", F.col("u").alias("_u"), F.col("v").alias("_v"), (F.col("w") + 1).alias("w_yz"))
        t = t.withColumn("_u", F.least("y", "z")).withColumn("_v", F.greatest("y", "z")).join(w, ["graph", "_u", "_v"]).drop("_u", "_v")
    return t


def _scale(cross: DataFrame) -> Column:
    return F.col("scale") if "scale" in cross.columns else F.lit(1.0)


def _sums(c: Closure, weights: DataFrame, cross: DataFrame | None, of: Callable, third: bool = False) -> DataFrame:
    """graph, x, s: parts of the sums of ``of(w_xy, w_xz, w_yz, dx)`` over the cross triangles of each x; of all, summed where they are listed if vertices are numbers."""
    if cross is not None or not c._numbered:
        t = _weighed(c, weights, cross, third)
        return t.select("graph", "x", (of(F.col("w_xy"), F.col("w_xz"), F.col("w_yz") if third else None, F.col("dx")) * _scale(t)).alias("s"))
    some = weights.filter("t > 0") if "t" in weights.columns else weights
    return c.blocks.weighted(some.select("graph", "u", "v", (F.col("w") + 1).alias("w")), of, third)


def p_succ(c: Closure, weights: DataFrame, first_edge_only: bool = False, cross: DataFrame | None = None) -> DataFrame:
    """graph, p: the chance that one draw of a base edge and of a closing edge finds a cross triangle."""
    big, local = totals(weights)
    if first_edge_only:
        s = _sums(c, weights, cross, lambda a, b, y, d: a / d).groupBy("graph").agg(F.sum("s").alias("s"))
    else:  # triangles are summed at x before its normalizer comes
        s = _sums(c, weights, cross, lambda a, b, y, d: a * b).groupBy("graph", "x").agg(F.sum("s").alias("s"))
        s = s.join(local.select("graph", "x", "d"), ["graph", "x"]).groupBy("graph").agg(F.sum(F.col("s") / F.col("d")).alias("s"))
    return big.join(s, "graph", "left").select("graph", (F.coalesce("s", F.lit(0.0)) / F.col("big_w")).alias("p"))


def p_base(c: Closure) -> DataFrame:
    return c.stats.select("graph", ratio(F.col("n_cross"), F.pow(2.0 * F.col("m"), F.lit(1.5)), F.lit(0.0)).alias("p"))


def second_moment(c: Closure, weights: DataFrame, cross: DataFrame | None = None) -> DataFrame:
    """graph, m2: the sum of one over the chance of each cross triangle."""
    big, local = totals(weights)
    s = _sums(c, weights, cross, lambda a, b, y, d: 1 / (a * b)).groupBy("graph", "x").agg(F.sum("s").alias("s"))
    s = s.join(local.select("graph", "x", "d"), ["graph", "x"]).groupBy("graph").agg(F.sum(F.col("s") * F.col("d")).alias("s"))
    return big.join(s, "graph", "left").select("graph", F.coalesce(F.col("s") * F.col("big_w"), F.lit(0.0)).alias("m2"))


def _cost(df: DataFrame, var: Column, eps: float, *more: Column) -> DataFrame:
    k = samples_for_error(F.col("var"), F.col("n_cross"), eps)
    return df.withColumn("var", var).select("graph", *more, "var", k.alias("samples"), k.alias("words"))


def weighted_cost(c: Closure, weights: DataFrame, eps: float = EPS, cross: DataFrame | None = None) -> DataFrame:
    df = second_moment(c, weights, cross).join(c.stats, "graph")
    return _cost(df, F.greatest(F.col("m2") - F.col("n_cross").cast("double") * F.col("n_cross"), F.lit(0.0)), eps, F.col("m2").alias("second_moment"))


def baseline_cost(c: Closure, eps: float = EPS) -> DataFrame:
    n = F.col("n_cross").cast("double")
    return _cost(c.stats, F.greatest(n * F.pow(2.0 * F.col("m"), F.lit(1.5)) - n * n, F.lit(0.0)), eps)


def wedge_totals(c: Closure) -> DataFrame:
    return c.degrees.groupBy("graph").agg(F.expr("sum(deg * (deg - 1) div 2)").alias("wedges"))


def wedge_cost(c: Closure, eps: float = EPS) -> DataFrame:
    """Uniform wedges: p is the chance that one closes into a cross triangle."""
    df = c.stats.join(wedge_totals(c), "graph")
    none = (F.col("n_cross") <= 0) | (F.col("wedges") <= 0)
    p = F.when(none, 0.0).otherwise(F.try_divide(3.0 * F.col("n_cross"), F.col("wedges")))
    df = df.withColumn("p", p)
    var = F.when(none, inf()).otherwise(F.pow(F.col("wedges") / 3.0, F.lit(2.0)) * F.col("p") * (1 - F.col("p")))
    return _cost(df, var, eps, F.col("wedges"), F.col("p"))


def edge_local_cost(c: Closure, eps: float = EPS) -> DataFrame:
    """Uniform edges with exact local counts, whose state is both neighbourhoods."""
    e = c.edge_degrees.groupBy("graph").agg(F.var_pop("t").alias("var"), F.avg(F.col("du") + F.col("dv")).alias("local"))
    df = e.join(c.stats.select("graph", "m", "n_cross"), "graph").withColumn("var", F.col("var") * F.pow(F.col("m") / 3.0, F.lit(2.0)))
    k = samples_for_error(F.col("var"), F.col("n_cross"), eps)
    return df.select("graph", "var", k.alias("samples"), (k * F.col("local")).alias("words"))


def heavy_storage_cost(c: Closure, eps: float = EPS, points: int = 25) -> DataFrame:
    """graph, words, tau: the tau heaviest edges are stored and the rest is sampled; the best of a geometric sweep of tau.

    Edges are ranked by t and name, those of one t and first end at once: most such groups lie between two taus whole, and only the edges of those that
    a tau cuts get ranks of their own.  Sums over the intervals above a tau give the variance and the state of what is left.
    """
    st = c.stats.select("graph", "m", "n_cross")
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    grid = st.select("graph", "m", i.alias("i"))
    raw = F.rint(F.exp(F.log(F.greatest(F.col("m"), F.lit(2)).cast("double")) * F.col("i") / F.lit(points - 1)))
    grid = grid.select("graph", F.least(F.greatest(raw.cast("long"), F.lit(1)), F.col("m")).alias("tau")).distinct()
    taus = cut(grid.groupBy("graph").agg(F.array_sort(F.collect_list("tau")).alias("taus")))
    edges = c.edge_degrees.select("graph", "u", "v", "t", (F.col("du") + F.col("dv")).alias("loc"))
    groups = edges.groupBy("graph", "t", "u").agg(F.count(F.lit(1)).alias("n"), F.sum("loc").alias("loc"))
    groups = cut(before(groups, ["graph"], [F.col("t").desc(), "u"], "n", "r0").join(F.broadcast(taus), "graph"))
    # edges that are still there after the first b taus have been stored
    stored = lambda r: F.size(F.filter("taus", lambda x: x < r))
    whole = stored(F.col("r0") + 1) == stored(F.col("r0") + F.col("n"))
    split = groups.filter(~whole).select("graph", "t", "u", "r0", "taus")  # as many as taus at most
    inside = F.row_number().over(Window.partitionBy("graph", "t", "u").orderBy("v"))
    ranked = edges.join(F.broadcast(split), ["graph", "t", "u"]).withColumn("r", F.col("r0") + inside)
    parts = ranked.select("graph", stored(F.col("r")).alias("b"), "t", F.lit(1).cast("long").alias("n"), "loc").unionByName(groups.filter(whole).select("graph", stored(F.col("r0") + 1).alias("b"), "t", "n", "loc"))
    t = F.col("t").cast("double")
    per = parts.groupBy("graph", "b").agg(F.sum("n").alias("n"), F.sum(t * F.col("n")).alias("s1"), F.sum(t * t * F.col("n")).alias("s2"), F.sum("loc").alias("loc"))
    above = per.select("graph", F.col("b").alias("b2"), "n", "s1", "s2", "loc")
    steps = taus.select("graph", F.posexplode("taus").alias("k", "tau"))
    rest = steps.join(above, (steps["graph"] == above["graph"]) & (F.col("b2") > F.col("k")), "left").groupBy(steps["graph"], "tau").agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("double").alias(x) for x in ("n", "s1", "s2", "loc")])
    rest = rest.join(st.select("graph", "n_cross"), "graph")
    mean = F.try_divide(F.col("s1"), F.col("n"))
    var = F.greatest(F.try_divide(F.col("s2"), F.col("n")) - mean * mean, F.lit(0.0)) * F.pow(F.col("n") / 3.0, F.lit(2.0))
    k = samples_for_error(var, F.col("n_cross"), eps)
    total = F.when(F.col("n") == 0, F.col("tau").cast("double")).otherwise(F.col("tau") + k * F.try_divide(F.col("loc"), F.col("n")))
    rest = rest.withColumn("words", total)
    return rest.groupBy("graph").agg(F.min(F.struct("words", "tau")).alias("b")).select("graph", "b.words", "b.tau")


def wedge_weighted_cost(c: Closure, weights: DataFrame, eps: float = EPS, cross: DataFrame | None = None) -> DataFrame:
    """Wedges drawn by the product of their edges' w+1."""
    _, local = totals(weights)
    big_t = local.groupBy("graph").agg(F.sum(F.col("d") * F.col("d") - F.col("q")).alias("big_t"))
    s = _sums(c, weights, cross, lambda a, b, y, d: 1 / (a * b) + 1 / (a * y) + 1 / (b * y), True).groupBy("graph").agg(F.sum("s").alias("s"))
    df = big_t.join(s, "graph", "left").join(c.stats, "graph").withColumn("m2", F.coalesce("s", F.lit(0.0)) * F.col("big_t") / 18.0)
    return _cost(df, F.greatest(F.col("m2") - F.col("n_cross").cast("double") * F.col("n_cross"), F.lit(0.0)), eps, F.col("big_t"), F.col("m2").alias("second_moment"))


def normalizer_inflation(c: Closure, eps: float = EPS, gains: bool = True) -> DataFrame:
    """How much a skewed weighting of mean 1 inflates the normalizers: global W, local D, quadratic T; and, if asked for, the gains of the two estimators."""
    c = c.persisted()
    w = weighting(c, "perfect")
    x, one = F.col("w") + 1, weighting(c, "uniform")
    # sums scale with the mean, so edges are summed as they are and divided afterwards
    cv = w.groupBy("graph").agg(F.avg(x).alias("mean"), (F.stddev_pop(x) / F.avg(x)).alias("weight_cv"), (F.sum(x) / F.avg(x) / F.count(F.lit(1))).alias("w_inflation"), F.count(F.lit(1)).alias("m"))
    d = graphs.slots(w, "w").groupBy("graph", "x").agg(F.sum(x).alias("d"), F.sum(x * x).alias("q"), F.count(F.lit(1)).cast("double").alias("d0"))
    of = F.col("d") / F.col("d0")
    d = d.groupBy("graph").agg(F.avg(of).alias("d_mean_inflation"), F.max(of).alias("d_max_inflation"), (F.sum(F.col("d") * F.col("d") - F.col("q")) / F.sum(F.col("d0") * F.col("d0") - F.col("d0"))).alias("t_inflation"))
    d = d.join(cv.select("graph", "mean"), "graph").select("graph", *[(F.col(k) / F.pow("mean", F.lit(p))).alias(k) for k, p in (("d_mean_inflation", 1.0), ("d_max_inflation", 1.0), ("t_inflation", 2.0))])
    cv = cv.drop("mean")
    if not gains:
        return cv.join(d, "graph")
    gain = lambda cost, name: cost(c, one, eps).select("graph", F.col("words").alias("a")).join(cost(c, w, eps).select("graph", F.col("words").alias("b")), "graph").select("graph", F.try_divide("a", "b").alias(name))
    return cv.join(d, "graph").join(gain(weighted_cost, "weighted_gain"), "graph").join(gain(wedge_weighted_cost, "wedge_gain"), "graph")


def comparison(c: Closure, eps: float = EPS) -> DataFrame:
    """Words of state per method, and the cheapest one (the first in this order on ties)."""
    c = c.persisted()
    parts = {
        "baseline": baseline_cost(c, eps), "wedge": wedge_cost(c, eps), "localized": weighted_cost(c, weighting(c, "uniform"), eps),
        "weighted": weighted_cost(c, weighting(c, "perfect"), eps), "edge_local": edge_local_cost(c, eps), "heavy": heavy_storage_cost(c, eps),
    }
    out = c.stats.select("graph", "m", "n_cross")
    for name, df in parts.items():
        out = out.join(df.select("graph", F.col("words").alias(name)), "graph")
    best = F.least(*[F.struct(F.col(n).alias("words"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(parts)])
    return out.withColumn("best", best["name"])


def c4_success(c: Closure, weights: DataFrame, first_edge_only: bool = False) -> DataFrame:
    """graph, p for cross four-cycles, both of whose matching's edges are drawn from all edges."""
    big = weights.groupBy("graph").agg(F.sum(F.col("w") + 1).alias("big_w"), F.count(F.lit(1)).alias("m"))
    t = c.c4
    for i in (1, 2):
        t = t.join(weights.select("graph", F.col("u").alias(f"u{i}"), F.col("v").alias(f"v{i}"), (F.col("w") + 1).alias(f"w{i}")), ["graph", f"u{i}", f"v{i}"])
    s = t.groupBy("graph").agg(F.sum("w1").alias("s1"), F.sum(F.col("w1") * F.col("w2")).alias("s2"))
    p = F.col("s1") / (F.col("big_w") * F.col("m")) if first_edge_only else F.col("s2") / (F.col("big_w") * F.col("big_w"))
    return big.join(s, "graph", "left").select("graph", F.coalesce(p, F.lit(0.0)).alias("p"))


def split_report(points: DataFrame, nulls: DataFrame, base: str) -> DataFrame:
    """The gain of a predictor against its permutation null: ``points`` has graph, unif, perf, mind and first; ``nulls`` graph and perm, a row per shuffle.

    Columns: perfect_over_<base>, permuted mean and 2.5 and 97.5 percentiles, mindeg, structural share (of the gain that the shuffles do not
    reproduce; NaN if there is no gain) and the one-sided p-value.  Ratios are null where there is nothing to find.
    """
    n = nulls.join(points, "graph").withColumn("s_perm", F.try_divide("perm", "unif")).withColumn("s_perf", F.try_divide("perf", "unif"))
    gain = F.col("s_perf") - 1
    n = n.withColumn("share", F.when(F.abs(gain) > 1e-12, (F.col("s_perf") - F.col("s_perm")) / gain).otherwise(nan()))
    q = lambda x, p: F.percentile(x, F.lit(p))
    return n.groupBy("graph").agg(
        F.first("s_perf").alias(f"perfect_over_{base}"), F.avg("s_perm").alias(f"permuted_over_{base}_mean"), q("s_perm", 0.025).alias(f"permuted_over_{base}_lo"),
        q("s_perm", 0.975).alias(f"permuted_over_{base}_hi"), F.first(F.try_divide("mind", "unif")).alias(f"mindeg_over_{base}"), F.avg("share").alias("structural_share"),
        q("share", 0.025).alias("structural_share_lo"), q("share", 0.975).alias("structural_share_hi"),
        ((F.sum((F.col("s_perm") >= F.col("s_perf")).cast("long")) + 1) / (F.count(F.lit(1)) + 1)).alias("perm_pvalue"), F.count(F.lit(1)).alias("n_perm"),
    )


def geometric_slope(df: DataFrame, y: str, x: str) -> DataFrame:
    """slope, intercept, r of log y on log x over all rows where both are positive."""
    ly, lx = F.log(F.col(y).cast("double")), F.log(F.col(x).cast("double"))
    d = df.filter((F.col(y) > 0) & (F.col(x) > 0)).select(ly.alias("ly"), lx.alias("lx"))
    return d.agg(F.regr_slope("ly", "lx").alias("slope"), F.regr_intercept("ly", "lx").alias("intercept"), correlation("ly", "lx").alias("r"))


def geometric_grid(lo: float, hi: float, points: int) -> list[float]:
    return [math.exp(math.log(lo) + (math.log(hi) - math.log(lo)) * i / (points - 1)) for i in range(points)]
