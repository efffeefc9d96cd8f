"""Positions of rows in groups that may hold most of the rows, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def positions(df: DataFrame, keys: list[str], order: list[Column | str], out: str) -> DataFrame:
    """Adds ``out``: the row's place, from 0, among the rows of its keys.

    Rows are sorted by ranges of (keys, order); counts per range give each one's base, and rows are counted inside their range.  ``order``
    should tell rows apart, since ranges are cut between different values.
    """
    return before(df, keys, order, None, out)


def before(df: DataFrame, keys: list[str], order: list[Column | str], amount: str | None, out: str) -> DataFrame:
    """As ``positions``, with the sum of the column ``amount`` over the rows that come before."""
    of = F.lit(1) if amount is None else F.col(amount)
    df = cut(df)  # the ranges are drawn from a sample, so rows are asked for twice
    by = [F.col(k) if isinstance(k, str) else k for k in (*keys, *order)]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = cut(rows.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()))
    counts = rows.groupBy(*keys, "_part").agg(F.sum(of).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    rank = Window.partitionBy("_part", *keys).orderBy("_seq")
    inside = F.row_number().over(rank) - 1 if amount is None else F.coalesce(F.sum(of).over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_in", inside).join(base, [*keys, "_part"]).withColumn(out, (F.col("_in") + F.col("_base")).cast("long")).drop("_part", "_seq", "_in", "_base")
