"""Structured Streaming over timestamped hyperedges: pair multiplicities and sizes per event-time window, with a watermark for late rows.

The batch operators need whole windows: a window's hyperedges are kept as state until the watermark passes its end; then ``closures`` hands
them over, once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.hypergraph import Closure, _pairs


def hyperedge_stream(rows: DataFrame, late: str = "10 minutes", length: str = "1 hour", slide: str | None = None, max_size: int = 25) -> DataFrame:
    """Rows (ts, hid, members) of a stream in normal form, with their window as ``graph``.  Members are sorted and distinct; sizes out of range go."""
    m = F.array_sort(F.array_distinct("members"))
    win = F.window("ts", length, slide) if slide else F.window("ts", length)
    s = rows.withWatermark("ts", late).select("ts", "hid", m.alias("members"), F.size(m).alias("size"), win.alias("win")).filter(F.col("size").between(2, max_size))
    return s.select("ts", "win", F.date_format("win.start", "yyyy-MM-dd HH:mm:ss").alias("graph"), "hid", "members", "size")


def window_pairs(stream: DataFrame) -> DataFrame:
    """win, u, v, nhy: how many hyperedges of each window hold each pair; finished windows are appended once the watermark passes."""
    p = stream.select("win", F.explode(_pairs(F.col("members"))).alias("p"))
    return p.groupBy("win", F.col("p.u").alias("u"), F.col("p.v").alias("v")).agg(F.count(F.lit(1)).alias("nhy"))


def window_sizes(stream: DataFrame) -> DataFrame:
    """win, hyperedges, members."""
    return stream.groupBy("win").agg(F.count(F.lit(1)).alias("hyperedges"), F.sum("size").alias("members"))


def closures(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``sink(statistics, batch)`` on the closure statistics (graph, m, n_cross, n_triangles) of the windows that a micro-batch has finished.

    Windows that the watermark has not passed when the stream stops stay in the checkpoint's state for the next run.
    """

    def batch(df: DataFrame, n: int) -> None:
        rows = df.select("graph", F.inline("held"))
        sink(Closure(rows.groupBy("graph", "members", "size").agg(F.min("hid").alias("hid"))).stats, n)

    whole = stream.groupBy("win", "graph").agg(F.collect_list(F.struct("hid", "members", "size")).alias("held"))
    return whole.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
