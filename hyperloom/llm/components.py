"""Connected components of a table of links, by alternating large and small stars.

Each step hangs neighbours on the smallest node they know of; the depth of a component shrinks by a constant factor per round.  Smallest
neighbours are found with partial aggregates, and the neighbours of a hub meet its smallest one by a broadcast of the few hubs, so a hub is in
no single task.  Each round is written to the shared folder, which cuts its lineage; the round before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rank import join_hot
from ._scratch import forget, written


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node with a link to another node.  Repeated, reversed and self links and links with a
    null end change nothing; no links give an empty table."""
    u, v = F.greatest(a, b).cast("long"), F.least(a, b).cast("long")
    e = written(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct(), "links")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = written(join_hot(both.filter("v > u"), least, ["u"], "n", 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = join_hot(large, least, ["u"], "n", state[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        forget(old, large)
        before, state = state, _state(e)
        if before == state:
            break
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))
