"""Cutting the lineage of tables that many plans build on."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Removes an execution's shuffle files at its end; a table that is cut is executed once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed now and kept as Parquet in the folder of ``spark.checkpoint.dir``, which executors share; plans over them stay short,
    read the columns they need, and a lost executor loses nothing.  On a cluster the setting must be there; where all of Spark is one local process,
    a temporary folder serves."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not folder and not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="hyperloom-"))
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/cut-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
