"""Readers of hypergraph and graph files.  All are Spark scans, so gzip files and whole folders work too.

Every reader adds the column ``graph`` and declares its schema; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

INCIDENCE = "graph string, hid bigint, v bigint"
REPORT = T.StructType([T.StructField("label", T.StringType()), T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without comments and blanks."""
    value = F.col("value")
    return spark.read.text(path).filter(~value.startswith("#") & (F.trim(F.regexp_replace(value, r"\s+", " ")) != ""))


def _before(df: DataFrame, order: list[str], amount: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the groups of rows that come before, for a small table of one row per group."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(amount).over(w), F.lit(0)))


def _numbered(df: DataFrame) -> DataFrame:
    """Adds ``pos``, the line number from 0, over all files in the order of their paths.  Blocks of a file are numbered each for itself; their
    counts, one row per block, give the bases."""
    df = df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_block", F.col("_metadata.file_block_start")).withColumn("_seq", F.monotonically_increasing_id())
    counts = df.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    base = _before(counts, ["_file", "_block"], "_n", "_base").drop("_n")
    inside = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_seq")) - 1
    return df.withColumn("_in", inside).join(base, ["_file", "_block"]).withColumn("pos", F.col("_in") + F.col("_base")).drop("_file", "_block", "_seq", "_in", "_base")


#: Lines whose amounts are summed up in one window.
_LINES = 65536


def _starts(lines: DataFrame, amount: str) -> DataFrame:
    """Adds ``start``: the sum of ``amount`` over the lines before, by blocks of lines."""
    lines = lines.withColumn("_b", F.floor(F.col("pos") / _LINES))
    base = _before(lines.groupBy("_b").agg(F.sum(amount).alias("_n")), ["_b"], "_n", "_base").drop("_n")
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy("_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("_in", inside).join(base, "_b").withColumn("start", F.col("_in") + F.col("_base")).drop("_b", "_in", "_base")


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    """pos, n: the whole numbers of a file, white space between them, on however many lines; pos counts from 0."""
    text = _numbered(spark.read.text(path).filter(F.trim(F.regexp_replace("value", r"\s+", " ")) != ""))
    text = text.select("pos", F.array_remove(F.split("value", r"\s+"), "").alias("t")).withColumn("k", F.size("t"))
    return _starts(text, "k").select("start", F.posexplode("t").alias("i", "token")).select((F.col("start") + F.col("i")).alias("pos"), F.col("token").cast("bigint").alias("n"))


def read_simplices(spark: SparkSession, sizes_path: str, ids_path: str, graph: str) -> DataFrame:
    """Incidence rows of a collection in two files: hyperedge sizes, and all vertex ids one after the other; any white space stands between numbers.

    A hyperedge's positions are a sequence that starts where its predecessors' sizes end; ids meet them in an equi-join.
    """
    sizes = _starts(_numbers(spark, sizes_path), "n").filter("n > 0")
    at = sizes.select(F.col("pos").alias("hid"), F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos"))
    ids = _numbers(spark, ids_path).select("pos", F.col("n").alias("v"))
    return at.join(ids, "pos").select(F.lit(graph).alias("graph"), "hid", "v")


def read_hyperedge_lines(spark: SparkSession, path: str, graph: str) -> DataFrame:
    """One hyperedge per line, members separated by white space or commas; member names are strings.  graph, hid, label."""
    rows = _numbered(_lines(spark, path))
    members = F.array_remove(F.split(F.regexp_replace("value", ",", " "), r"\s+"), "")
    return rows.select(F.lit(graph).alias("graph"), F.col("pos").alias("hid"), F.explode(members).alias("label"))


def read_edge_list(spark: SparkSession, path: str, graph: str) -> DataFrame:
    """graph, pos, u, v (strings): the first two tokens of each line."""
    t = F.array_remove(F.split("value", r"\s+"), "")
    return _numbered(_lines(spark, path)).select(F.lit(graph).alias("graph"), "pos", t[0].alias("u"), t[1].alias("v"))


def read_temporal(spark: SparkSession, path: str, graph: str) -> DataFrame:
    """graph, ts, u, v from lines ``u v t``, t in epoch seconds, sorted by (t, u, v); lines with fewer tokens go."""
    t = F.array_remove(F.split("value", r"\s+"), "")
    rows = _lines(spark, path).select(t.alias("t")).filter(F.size("t") >= 3)
    return rows.select(F.lit(graph).alias("graph"), F.col("t")[2].cast("bigint").alias("ts"), F.col("t")[0].cast("bigint").alias("u"), F.col("t")[1].cast("bigint").alias("v")).orderBy("ts", "u", "v")


def read_hif(spark: SparkSession, path: str, graph: str) -> DataFrame:
    """graph, edge, label from JSON with a list ``incidences`` of {edge, node} or a map ``edge-dict`` from edges to nodes; anything else fails."""
    schema = "incidences array<struct<edge:string,node:string>>, `edge-dict` map<string,array<string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    pair = "array<struct<edge:string,label:string>>"
    mapped = F.flatten(F.transform(F.map_entries("edge-dict"), lambda e: F.transform(e["value"], lambda n: F.struct(e["key"].alias("edge"), n.alias("label")))))
    pairs = F.when(F.col("incidences").isNotNull(), F.col("incidences").cast(pair)).when(F.col("edge-dict").isNotNull(), mapped.cast(pair)).otherwise(F.raise_error(F.lit("neither incidences nor edge-dict")).cast(pair))
    return rows.select(F.explode(pairs).alias("i")).select(F.lit(graph).alias("graph"), "i.edge", "i.label")


def entry_url(url: Column, href: Column, link: Column) -> Column:
    """The address in an index entry, whichever key has it."""
    return F.coalesce(url, href, link)


def union_graphs(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def domains(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """The dimension of graphs: label and domain."""
    return spark.createDataFrame(rows, "label string, domain string")


def read_report(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_report(df: DataFrame, path: str) -> None:
    """A report as CSV with a header; reports have a row per graph, so one file holds them."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_graphs(hyperedges: DataFrame, path: str) -> None:
    """Normalised hyperedges, partitioned by graph, so that a query on a graph reads its folder alone."""
    hyperedges.write.mode("overwrite").partitionBy("graph").parquet(path)


def load_graphs(spark: SparkSession, path: str, labels: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if labels is None else df.filter(F.col("graph").isin(labels))


def latex_rows(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """One LaTeX table row per row, as column ``line``."""
    kinds = dict(df.dtypes)
    cells = [F.format_string(f"%.{digits}f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string") for c in columns]
    return df.select(F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\")).alias("line"))
