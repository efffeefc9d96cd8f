"""Learned edge weights: ridge from one pass of sums, gradient-boosted trees from MLlib, and transfer between graphs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import correlation, nan
from . import mining, scores
from .hypergraph import Closure
from .sampling import capped_rows


@dataclass(frozen=True)
class Ridge:
    """A linear model of standardised features, the last coefficient being the intercept."""

    block: str
    beta: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    y_mean: float
    y_scale: float

    def predicted(self) -> Column:
        """The prediction of y = log1p(t) as a column expression over f1, f2, ..."""
        z = F.lit(self.beta[-1])
        for i, (b, m, s) in enumerate(zip(self.beta[:-1], self.mean, self.scale)):
            z = z + F.lit(b) * ((F.col(f"f{i + 1}") - F.lit(m)) / F.lit(s))
        return z * F.lit(self.y_scale) + F.lit(self.y_mean)


def as_weight(y: Column) -> Column:
    """A predicted log1p count as a weight: cut to [0, 30], raised, and not below 0."""
    return F.greatest(F.expm1(F.least(F.greatest(y, F.lit(0.0)), F.lit(30.0))), F.lit(0.0))


def ridge_from_gram(g: np.ndarray, block: str, lam: float = 1.0) -> Ridge:
    """Ridge on standardised features and target; the sums of products are all it needs, and the intercept is not penalised."""
    mean, sd, centred = mining.moments(g)
    sd = sd + 1e-12
    z = centred / np.outer(sd, sd)
    k = len(sd) - 1
    beta = np.linalg.solve(z[:k, :k] + lam * np.eye(k), z[:k, k])
    return Ridge(block, (*map(float, beta), 0.0), tuple(map(float, mean[:-1])), tuple(map(float, sd[:-1])), float(mean[-1]), float(sd[-1]))


def ridge_fit(feats: DataFrame, block: str = "ABC", lam: float = 1.0) -> dict[str, Ridge]:
    """A model per graph of the features."""
    return {graph: ridge_from_gram(g, block, lam) for graph, (g, _) in mining.gram(feats, block).items()}


def ridge_weights(model: Ridge, feats: DataFrame) -> DataFrame:
    return feats.select("graph", "u", "v", as_weight(model.predicted()).alias("w"))


@dataclass(frozen=True)
class Trees:
    block: str
    model: object
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    y_mean: float
    y_scale: float


def _assembled(feats: DataFrame, block: str, mean, scale) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    cols = [f"f{i + 1}" for i in range(mining.BLOCKS[block])]
    std = feats.select("graph", "u", "v", "y", *[((F.col(c) - F.lit(m)) / F.lit(s)).alias(c) for c, m, s in zip(cols, mean, scale)])
    return VectorAssembler(inputCols=cols, outputCol="features").transform(std)


def trees_fit(feats: DataFrame, block: str = "ABC", rounds: int = 200, rate: float = 0.1, depth: int = 5, seed: int = 0) -> dict[str, Trees]:
    """Boosted trees per graph on the standardised features and target."""
    from pyspark.ml.regression import GBTRegressor

    out = {}
    for graph, (g, _) in mining.gram(feats, block).items():
        mean, sd, _ = mining.moments(g)
        sd = sd + 1e-12
        rows = _assembled(feats.filter(F.col("graph") == graph), block, mean[:-1].tolist(), sd[:-1].tolist()).withColumn("label", (F.col("y") - F.lit(float(mean[-1]))) / F.lit(float(sd[-1])))
        model = GBTRegressor(maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed).fit(capped_rows(rows).select("features", "label"))
        out[graph] = Trees(block, model, tuple(map(float, mean[:-1])), tuple(map(float, sd[:-1])), float(mean[-1]), float(sd[-1]))
    return out


def trees_weights(t: Trees, feats: DataFrame) -> DataFrame:
    rows = t.model.transform(_assembled(feats, t.block, t.mean, t.scale))
    return rows.select("graph", "u", "v", as_weight(F.col("prediction") * F.lit(t.y_scale) + F.lit(t.y_mean)).alias("w"))


def transfer(c: Closure, feats: DataFrame, blocks: tuple[str, ...] = ("A", "AB", "ABC"), lams: tuple[float, ...] = (1.0,), learner: str = "ridge", **kw) -> DataFrame:
    """train, test, block, lam, capture, pred_corr for every ordered pair of graphs.  capture = (s - 1) / (s_perfect - 1), s being the gain over
    uniform weights.  Each model scores all graphs in one pass; models are a few numbers and go along as literals."""
    c = c.persisted()
    uni = scores.p_succ(c, scores.weighting(c, "uniform")).select(F.col("graph").alias("test"), F.col("p").alias("p_u"))
    perf = scores.p_succ(c, scores.weighting(c, "perfect")).select(F.col("graph").alias("test"), F.col("p").alias("p_p"))
    points = uni.join(perf, "test")
    out = None
    for block in blocks:
        for lam in lams if learner == "ridge" else (0.0,):
            models = ridge_fit(feats, block, lam) if learner == "ridge" else trees_fit(feats, block, **kw)
            for train, model in models.items():
                w = (ridge_weights if learner == "ridge" else trees_weights)(model, feats.filter(F.col("graph") != train))
                p = scores.p_succ(c, w).select(F.col("graph").alias("test"), "p")
                t = c.edge_cross.select("graph", "u", "v", "t").join(w, ["graph", "u", "v"]).groupBy(F.col("graph").alias("test")).agg(correlation(F.log1p("t"), F.log1p("w")).alias("pred_corr"))
                gain = F.col("p_p") / F.col("p_u") - 1
                row = points.join(p, "test").join(t, "test").select(
                    F.lit(train).alias("train"), "test", F.lit(block).alias("block"), F.lit(float(lam)).alias("lam"),
                    F.when(F.abs(gain) > 1e-12, (F.col("p") / F.col("p_u") - 1) / gain).otherwise(nan()).alias("capture"), "pred_corr",
                )
                out = row if out is None else out.unionByName(row)
    return out


def best_setting(pairs: DataFrame) -> DataFrame:
    """block, lam and the mean capture of the best setting per block."""
    per = pairs.groupBy("block", "lam").agg(F.avg(F.nanvl("capture", F.lit(None).cast("double"))).alias("mean_capture"))
    return per.groupBy("block").agg(F.max_by("lam", "mean_capture").alias("lam"), F.max("mean_capture").alias("mean_capture"))


def block_difference(pairs: DataFrame, high: str = "ABC", low: str = "A") -> DataFrame:
    """train, test and the capture gained from one block to another, by a pivot."""
    wide = pairs.groupBy("train", "test").pivot("block", [high, low]).agg(F.avg("capture"))
    return wide.select("train", "test", (F.col(high) - F.col(low)).alias("difference"))
