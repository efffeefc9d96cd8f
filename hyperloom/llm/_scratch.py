"""Tables written between the steps of an operator, in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Removes an execution's shuffle files at its end; what is written here is executed once, so nothing asks for them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open: list[Scope] = []


class Scope:
    """The tables written while it is open."""

    def __init__(self):
        self.paths: list[tuple[SparkSession, str]] = []

    def remove(self) -> None:
        """Deletes the tables, and lets Spark delete the shuffle files of frames that nobody holds any more."""
        for spark, path in self.paths:
            _remove(spark, path)
        if self.paths:
            gc.collect()
            with contextlib.suppress(Exception):  # the session may have ended before
                self.paths[-1][0].sparkContext._jvm.System.gc()
        self.paths.clear()


@contextlib.contextmanager
def scope() -> Iterator[Scope]:
    s = Scope()
    _open.append(s)
    try:
        yield s
    finally:
        _open.remove(s)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  On a cluster it must be set; where all of Spark is one local process, a temporary folder serves."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        folder = tempfile.mkdtemp(prefix="hyperloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what stands there is removed with the open scopes, or when the driver's Python ends."""
    path = f"{shared_folder(spark)}/hyperloom/{name}-{uuid.uuid4().hex[:12]}"
    for s in _open:
        s.paths.append((spark, path))
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: computed once, and no executor's loss undoes it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``written``, in one file for each hash of ``key``: joins by the key read the table as it stands and do not shuffle its rows.

    The catalog holds the table's name only until it is read back; files go with the open scopes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(table)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave and that nothing reads any more."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            _remove(t.sparkSession, path)
