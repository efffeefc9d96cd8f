"""Packing into length buckets whose bounds a dynamic program chooses over the global histogram of lengths.

A row is padded to the upper bound of its bucket.  The program minimises the padding over all rows for a given number of buckets;
the histogram has a bounded number of bins, so it is all that the driver sees.  Bins up to ``EXACT_LENGTHS`` tokens are single lengths; a longer
bin counts as its longest row, so a bound is always the length of a row, and is at most 1/256 off the best one.  Inside a bucket, rows in the
order of a hash fill batches of a token budget.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._rank import running_sum, told_apart
from ._scratch import written
from .token_files import token_lengths

#: Lengths up to this have a bin each; above, a bin spans 1/256 of its length, so all lengths below 2**40 make under 8,000 bins.
EXACT_LENGTHS, FINENESS = 2048, 256
BUCKETS, TOKEN_BUDGET = 16, 65_536


def bin_top(length: Column) -> Column:
    """The upper end of a length's bin: the length itself up to EXACT_LENGTHS, then the next power of 1 + 1/FINENESS."""
    step = math.log1p(1 / FINENESS)
    k = F.ceil(F.log(length / F.lit(float(EXACT_LENGTHS))) / F.lit(step) - F.lit(1e-9))
    top = F.greatest(F.ceil(F.exp(k * F.lit(step)) * F.lit(float(EXACT_LENGTHS))), length)
    return F.when(length <= EXACT_LENGTHS, length).otherwise(top).cast("long")


def choose_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The upper bounds, ascending, of at most ``buckets`` buckets over ascending lengths, so that sum of count times (bound - length) is least."""
    n = len(lengths)
    if not n:
        return []
    k = min(buckets, n)
    x, c = np.asarray(lengths, float), np.concatenate(([0.0], np.cumsum(np.asarray(counts, float))))
    # cost of a bucket over bins i..j-1 is x[j-1] * (c[j] - c[i]), less a constant; best[j]: least cost of the first j bins
    best = np.concatenate(([0.0], x * c[1:]))
    back = np.zeros((k, n + 1), np.int64)
    for b in range(1, k):
        new = best.copy()
        for j in range(b + 1, n + 1):
            cost = best[b:j] + x[j - 1] * (c[j] - c[b:j])
            i = int(np.argmin(cost))
            if cost[i] < new[j]:
                new[j], back[b, j] = cost[i], i + b
            else:
                back[b, j] = -1
        best = new
    bounds, j, b = [], n, k - 1
    while j > 0:
        bounds.append(int(lengths[j - 1]))
        while b > 0 and back[b, j] == -1:
            b -= 1
        j, b = (int(back[b, j]), b - 1) if b > 0 else (0, 0)
    return bounds[::-1]


def pack(docs: DataFrame, length: Column, key: tuple[str, ...], buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """Every row with n_tokens, bucket (from 0), bucket_tokens (padded length), batch (from 0 in the bucket) and slot (from 0 in the batch).

    A batch holds at most ``budget`` padded tokens, or one row where a row alone has more.  Empty texts have length 0 and go to the first
    bucket; a null ``length`` counts as 0.  ``key`` names the columns whose hash orders a bucket; equal rows get slots of their own.
    An empty table gives an empty result.  Columns of ``docs`` that bear an output's name are replaced.
    """
    own = ["n_tokens", "bucket", "bucket_tokens", "batch", "slot"]
    n_in = len(docs.columns)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_p{i}") for i, c in enumerate(docs.columns)], F.coalesce(length, F.lit(0)).cast("long").alias("_len"), F.xxhash64(*[F.col(f"`{k}`") for k in key]).alias("_order"))
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "pack-rows")
    hist = rows.groupBy(bin_top(F.col("_len")).alias("bin")).agg(F.max("_len").alias("top"), F.count(F.lit(1)).alias("n")).collect()
    hist = sorted((int(r["top"]), int(r["n"])) for r in hist)
    bounds = choose_bounds([t for t, _ in hist], [c for _, c in hist], buckets) or [0]
    at = F.lit(len(bounds) - 1)
    top = F.lit(bounds[-1])
    for i in range(len(bounds) - 2, -1, -1):
        at = F.when(F.col("_len") <= bounds[i], F.lit(i)).otherwise(at)
        top = F.when(F.col("_len") <= bounds[i], F.lit(bounds[i])).otherwise(top)
    rows = rows.withColumn("_bucket", at.cast("int")).withColumn("_top", top.cast("long"))
    n_rows = sum(c for _, c in hist)
    rows = running_sum(told_apart(rows, "_order", "_row", n_rows), ["_bucket"], F.col("_order"), F.lit(1), "_place", n_rows)
    room = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("_top"), F.lit(1))), F.lit(1)).cast("long")
    rows = rows.withColumn("_room", room)
    passed = [F.col(f"_p{i}").alias(c) for i, c in enumerate(docs.columns[:n_in]) if c not in own]
    return rows.select(*passed, F.col("_len").alias("n_tokens"), F.col("_bucket").alias("bucket"), F.col("_top").alias("bucket_tokens"), F.floor(F.col("_place") / F.col("_room")).alias("batch"), (F.col("_place") % F.col("_room")).alias("slot"))


def pack_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", **how) -> DataFrame:
    """``pack`` by the number of tokens of each whole text, as the library counts them for a vocabulary file.  Columns other than the text pass
    through; by a hash of them and the number of tokens rows are ordered, and only these narrow rows are shuffled."""
    sized = token_lengths(docs, tokenizer_path, text, "_tokens")
    return pack(sized, F.col("_tokens"), tuple(sized.columns), **how).drop("_tokens")
