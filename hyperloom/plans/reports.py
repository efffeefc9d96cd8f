"""Report queries: each is one plan over all graphs of a closure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cores, learning, mining, sampling, scores
from ..operators.hypergraph import Closure, first_hyperedges
from ..sources import generators
from ..functions.scalar import nan_mean, ratio


def diagnostic(c: Closure, exact: bool = True) -> DataFrame:
    """Width against degeneracy for cross triangles."""
    c = c.persisted()
    copies = c.stats.select("graph", F.col("n_cross").alias("n_copies"))
    return cores.diagnostic(c.edges.select("graph", "u", "v"), c.copy_edges.select("graph", "u", "v"), copies, exact)


def points(c: Closure, kind: str = "path") -> DataFrame:
    """graph, unif, perf, mind, first: the scores that a split report compares."""
    if kind == "c4":
        t = c.c4_edge_t
        d = c.degrees
        mind = c.edges.select("graph", "u", "v").join(d.toDF("graph", "u", "du"), ["graph", "u"]).join(d.toDF("graph", "v", "dv"), ["graph", "v"]).select("graph", "u", "v", F.least("du", "dv").cast("double").alias("w"))
        perf = t.select("graph", "u", "v", F.col("t4").cast("double").alias("w"))
        uni = t.select("graph", "u", "v", F.lit(0.0).alias("w"))
        p = {"unif": scores.c4_success(c, uni), "perf": scores.c4_success(c, perf), "mind": scores.c4_success(c, mind), "first": scores.c4_success(c, perf, True)}
    else:
        w = {k: scores.weighting(c, k) for k in ("uniform", "perfect", "mindeg")}
        p = {"unif": scores.p_succ(c, w["uniform"]), "perf": scores.p_succ(c, w["perfect"]), "mind": scores.p_succ(c, w["mindeg"]), "first": scores.p_succ(c, w["perfect"], True)}
    out = None
    for k, df in p.items():
        df = df.select("graph", F.col("p").alias(k))
        out = df if out is None else out.join(df, "graph")
    return out


def evaluate(c: Closure, graph_names: list[str], n_perm: int = 50, seed: int = 0) -> DataFrame:
    """Localization, perfect predictor, shuffled predictor and cheap heuristic per graph."""
    c = c.persisted()
    pts = points(c)
    nulls = None
    for g in graph_names:
        n = sampling.permutation_null(c, g, n_perm, seed)
        nulls = n if nulls is None else nulls.unionByName(n)
    split = scores.split_report(pts, nulls, "loc")
    base = scores.p_base(c).select("graph", F.col("p").alias("p_base"))
    d = pts.join(base, "graph").join(c.stats, "graph").join(split, "graph")
    gain = F.col("perfect_over_loc") - 1
    return d.select(
        "graph", "m", "n_cross", (F.col("n_cross") / F.greatest("m", F.lit(1))).alias("copy_density"), ratio(F.col("unif"), F.col("p_base")).alias("loc_x"), ratio(F.col("perf"), F.col("p_base")).alias("perfect_x"), ratio(F.col("first"), F.col("p_base")).alias("firstedge_x"),
        F.when(F.abs(gain) > 1e-12, (F.col("mindeg_over_loc") - 1) / gain).otherwise(F.lit(float("nan"))).alias("mindeg_capture"), *[x for x in split.columns if x != "graph"],
    )


def gains(c: Closure) -> DataFrame:
    """The columns of ``evaluate`` that need no shuffle: graph, n, m, n_cross, copy_density, and the three scores and ratios."""
    c = c.persisted()
    n = c.degrees.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    d = points(c).join(scores.p_base(c).select("graph", F.col("p").alias("p_base")), "graph").join(c.stats, "graph").join(n, "graph")
    perfect, mindeg = ratio(F.col("perf"), F.col("unif")), ratio(F.col("mind"), F.col("unif"))
    return d.select(
        "graph", "n", "m", "n_cross", (F.col("n_cross") / F.greatest("m", F.lit(1))).alias("copy_density"), ratio(F.col("unif"), F.col("p_base")).alias("loc_x"), ratio(F.col("perf"), F.col("p_base")).alias("perfect_x"),
        ratio(F.col("first"), F.col("p_base")).alias("firstedge_x"), perfect.alias("perfect_over_loc"), mindeg.alias("mindeg_over_loc"), F.when(F.abs(perfect - 1) > 1e-12, (mindeg - 1) / (perfect - 1)).otherwise(F.lit(float("nan"))).alias("mindeg_capture"),
    )


def summary(report: DataFrame, domains: DataFrame, columns: list[str]) -> DataFrame:
    """domain, graphs, and the least, largest and mean value and the standard deviation of each column of a report with a row per graph; ``domains``
    has graph and domain."""
    per = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))]
    return report.join(domains.select("graph", "domain"), "graph").groupBy("domain").agg(F.count(F.lit(1)).alias("graphs"), *per)


def wins(comparison: DataFrame) -> DataFrame:
    """best, graphs: how many graphs each method is the cheapest for."""
    return comparison.groupBy("best").agg(F.count(F.lit(1)).alias("graphs"))


def evaluate_c4(c: Closure, graph_names: list[str], n_perm: int = 50, seed: int = 0) -> DataFrame:
    """The split of the gain for four-cycles, for the graphs that pass the guard; no four-cycle of another graph is listed."""
    c = c.within_guard().persisted()
    pts = points(c, "c4")
    nulls = None
    for g in graph_names:
        n = sampling.permutation_null(c, g, n_perm, seed, "c4")
        nulls = n if nulls is None else nulls.unionByName(n)
    n_cross = c.c4.groupBy("graph").agg(F.count(F.lit(1)).alias("n_cross"))
    m = c.edges.groupBy("graph").agg(F.count(F.lit(1)).alias("m"))
    split = scores.split_report(pts, nulls, "unif").join(n_cross, "graph").join(m, "graph").withColumn("copy_density", F.col("n_cross") / F.col("m")).join(c.c4_guard(), "graph")
    return split.join(pts.select("graph", F.try_divide("first", "unif").alias("firstedge_over_unif")), "graph")


def wedge_report(c: Closure, graph_names: list[str], n_perm: int = 50, seed: int = 0) -> DataFrame:
    """The same question for the wedge estimator; a gain is a ratio of costs, so costs enter as their inverses."""
    c = c.persisted()
    cost = lambda k, name: scores.wedge_weighted_cost(c, scores.weighting(c, k)).select("graph", F.try_divide(F.lit(1.0), "words").alias(name))
    pts = cost("uniform", "unif").join(cost("perfect", "perf"), "graph").join(cost("mindeg", "mind"), "graph")
    nulls = None
    for g in graph_names:
        n = sampling.permutation_null(c, g, n_perm, seed, "wedge").withColumn("perm", F.try_divide(F.lit(1.0), "perm"))
        nulls = n if nulls is None else nulls.unionByName(n)
    return scores.split_report(pts, nulls, "unif")


def cap_sensitivity(hyperedges: DataFrame, caps: list[int]) -> DataFrame:
    """graph, cap, m, n_cross, loc_x with only the first hyperedges."""
    out = None
    for k in caps:
        c = Closure(first_hyperedges(hyperedges, k))
        p = scores.p_succ(c, scores.weighting(c, "uniform")).join(scores.p_base(c).withColumnRenamed("p", "b"), "graph").join(c.stats, "graph")
        row = p.select("graph", F.lit(k).alias("cap"), "m", "n_cross", ratio(F.col("p"), F.col("b")).alias("loc_x"))
        out = row if out is None else out.unionByName(row)
    return out


def triple_sensitivity(c: Closure, caps: list[int], seed: int = 0) -> DataFrame:
    """graph, cap, ratio of the perfect to the uniform success on a sample of triples."""
    out = None
    for k in caps:
        t = c.sampled_cross(k, seed)
        a = scores.p_succ(c, scores.weighting(c, "perfect"), cross=t).select("graph", F.col("p").alias("a"))
        b = scores.p_succ(c, scores.weighting(c, "uniform"), cross=t).select("graph", F.col("p").alias("b"))
        row = a.join(b, "graph").select("graph", F.lit(k).alias("cap"), F.try_divide("a", "b").alias("perfect_over_loc"))
        out = row if out is None else out.unionByName(row)
    return out


def density_rule(report: DataFrame) -> DataFrame:
    """The line of log(gain - 1) on log(copies per edge)."""
    return scores.geometric_slope(report.withColumn("g", F.col("perfect_over_loc") - 1).withColumn("d", F.col("n_cross") / F.col("m")), "g", "d")


def simulation(c: Closure, ks: list[int], reps: int = 20, seed: int = 0) -> DataFrame:
    """Bias and error of the estimator run for real, next to the error that its variance predicts."""
    c = c.persisted()
    out = None
    for name in ("uniform", "perfect"):
        w = scores.weighting(c, name)
        var = scores.weighted_cost(c, w).select("graph", "var").join(c.stats.select("graph", "n_cross"), "graph")
        for k in ks:
            e = sampling.errors(sampling.simulate_estimator(c, w, k, reps, seed), c.stats)
            row = e.join(var, "graph").select("graph", F.lit(name).alias("weights"), F.lit(k).alias("k"), "bias", "rmse", F.try_divide(F.sqrt(F.col("var") / k), "n_cross").alias("predicted"))
            out = row if out is None else out.unionByName(row)
    return out


def ranking(c: Closure, ks: list[int], reps: int = 5, seed: int = 0, top: int = 100) -> DataFrame:
    """Precision at ``top`` and rank correlation of simulated vertex scores, mean over repetitions."""
    c = c.persisted()
    exact = mining.vertex_scores(c)
    out = None
    for k in ks:
        s = sampling.simulate_vertex_scores(c, scores.weighting(c, "perfect"), k, reps, seed)
        tag = F.concat_ws("#", "graph", F.col("rep").cast("string"))
        est = s.select(tag.alias("graph"), "v", "score")
        ex = exact.join(c.hyperedges.sparkSession.range(reps).select(F.col("id").alias("rep"))).select(tag.alias("graph"), "v", F.col("score").cast("double").alias("score"))
        row = mining.precision_at_k(est, ex, top).join(mining.rank_correlation(est, ex), "graph").groupBy(F.substring_index("graph", "#", 1).alias("graph")).agg(F.avg("precision").alias("precision"), F.avg("rho").alias("rho")).withColumn("k", F.lit(k))
        out = row if out is None else out.unionByName(row)
    return out


def smallest_k(report: DataFrame, measure: str, target: float) -> DataFrame:
    """graph, k: the fewest draws that reach the target."""
    return report.filter(F.col(measure) >= target).groupBy("graph").agg(F.min("k").alias("k"))


def hard_instances(spark: SparkSession, small: bool = True) -> DataFrame:
    """The instance report over hubs, friendship graphs and set-disjointness instances."""
    parts = [generators.hubs(spark, r, d) for r, d in ((1, 64), (1, 256), (4, 64), (8, 64))]
    parts += [generators.friendship_and_decoy(spark, s) for s in (64, 256, *(() if small else (1024,)))]
    for n in (6, 9, *(() if small else (12, 16, 20))):
        b, d = round(n**1.5), round(n**0.5)
        x, y = [1] + [i % 2 for i in range(1, n)], [1] + [1 - i % 2 for i in range(1, n)]
        parts.append(generators.set_disjointness(spark, b, d, x, y))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return cores.instance_report(df)


def object_scan(spark: SparkSession, qs: tuple[int, ...] = (7, 11)) -> DataFrame:
    """The four-cycle diagnostic of affine planes with and without gadgets."""
    df = None
    for q in qs:
        for e in (generators.affine_plane(spark, q), generators.plane_and_butterflies(spark, q, 8 * q * q // 3)):
            df = e if df is None else df.unionByName(e)
    return cores.diagnose(df, "C4")


def synthetic(spark: SparkSession, sizes: tuple[int, ...] = (20, 30), n_perm: int = 15) -> DataFrame:
    """The separable family: localization grows with the square root of the edges."""
    inc = None
    for r in sizes:
        e = generators.cliques_and_cross(spark, 6, r, 6 * r, seed=1)
        inc = e if inc is None else inc.unionByName(e)
    c = Closure.of(inc, 200)
    return evaluate(c, [f"cliques_{r}" for r in sizes], n_perm)


def transfer_summary(c: Closure, blocks=("A", "ABC"), lams=(0.1, 1.0), learner: str = "ridge", **kw) -> DataFrame:
    """block, lam, mean capture over ordered pairs."""
    c = c.persisted()
    feats = mining.features(c, cores.core_numbers(c.edges.select("graph", "u", "v")))
    pairs = learning.transfer(c, feats, blocks, lams, learner, **kw)
    return pairs.groupBy("block", "lam").agg(nan_mean(F.col("capture")).alias("mean_capture"), F.count(F.lit(1)).alias("pairs"))


