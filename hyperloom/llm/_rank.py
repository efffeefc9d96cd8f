"""Positions and running sums inside groups that may hold most of the rows, without a window over a whole group.

Rows of a group are spread over buckets by a prefix of their order key.  Totals per bucket are small; their
running sums give each bucket's base, and a window inside a bucket does the rest.  No task holds more than a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows aimed at in a bucket.
BUCKET_ROWS = 8192


def running_sum(df: DataFrame, keys: list[str], order: Column, amount: Column, out: str, n_rows: int, tie: Column | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the rows of the same keys that come before in the order of the long ``order``.

    ``order`` must be spread evenly over all longs (a hash).  Ties are ordered by ``tie``, and equal rows arbitrarily
    but without overlap.
    """
    buckets = max(1, n_rows // BUCKET_ROWS)
    rows = df.withColumn("_o", order).withColumn("_a", amount.cast("long"))
    # the upper 31 bits, as a number from 0, scaled to the number of buckets
    rows = rows.withColumn("_b", F.floor((F.shiftright("_o", 33) + F.lit(1 << 30)) * F.lit(buckets) / F.lit(1 << 31)).cast("long"))
    names = [f"_k{i}" for i in range(len(keys))]
    totals = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_b").alias("_tb")).agg(F.sum("_a").alias("_t"))
    before = Window.partitionBy(*names).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*names, "_tb", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_o", *([tie] if tie is not None else [])).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_a").over(inside), F.lit(0)))
    same = F.col("_b") == F.col("_tb")
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return rows.join(bases, same, "left").withColumn(out, F.col("_in") + F.col("_base")).drop("_o", "_a", "_b", "_tb", "_base", "_in", *names)


def told_apart(df: DataFrame, order: str, row: str, n_rows: int) -> DataFrame:
    """``order``, a long hash of a row's content, made different for rows that share it: the hash of it and of a number among them.

    Such rows are equal, so it does not matter which gets which number; the numbers are 0, 1, 2... whatever the partitions, so reruns agree.
    ``row`` is a long that no two rows share; by it equal rows are spread over buckets to be numbered.
    """
    if not df.groupBy(order).count().filter("count > 1").limit(1).count():
        return df
    numbered = running_sum(df, [order], F.xxhash64(row), F.lit(1), "_nth", n_rows)
    return numbered.withColumn(order, F.when(F.col("_nth") > 0, F.xxhash64(order, "_nth")).otherwise(F.col(order))).drop("_nth")


#: Keys that hold more than one HOT-th of all rows are fewer than HOT, so a table of them is small enough to broadcast.
HOT, HOT_ROWS = 10_000, 1000


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], count: str, n_rows: int) -> DataFrame:
    """An inner join of ``rows`` with a table of one row per key, whose ``count`` tells how many of the ``n_rows`` rows have the key.

    Rows of frequent keys stay where they are and meet a broadcast of at most ``HOT`` table rows; the others are joined as usual.
    """
    hot = F.col(count) > max(n_rows // HOT, HOT_ROWS)
    often, seldom = F.broadcast(table.filter(hot)), table.filter(~hot)
    return rows.join(often, keys).unionByName(rows.join(F.broadcast(table.filter(hot).select(*keys)), keys, "left_anti").join(seldom, keys))
