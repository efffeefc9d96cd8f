"""Hypergraphs and temporal graphs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hypergraph import Closure


def orders_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyperedges are orders, members the parts on them."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lit("order_part").alias("graph"), F.col("l_orderkey").alias("hid"), F.col("l_partkey").alias("v"))


def minutes_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyperedges are minutes, members the users with an event in them."""
    ts = F.date_trunc("minute", "ts")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("minute_user").alias("graph"), F.floor(F.unix_timestamp(ts) / 60).alias("hid"), F.col("user_id").alias("v"))


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph, ts, u, v: customers and parts of orders, at the order's second."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.lit("cust_part").alias("graph"), "ts", (F.col("o_custkey") * 2).alias("u"), (F.col("l_partkey") * 2 + 1).alias("v"))


def closure(spark: SparkSession, sf_dir: str, view: str = "orders", max_size: int = 25) -> Closure:
    return Closure.of((orders_of_parts if view == "orders" else minutes_of_users)(spark, sf_dir), max_size)


def minutes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hypergraph per event type: hyperedges are minutes, members the users with such an event in them."""
    ts = F.date_trunc("minute", "ts")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("graph"), F.floor(F.unix_timestamp(ts) / 60).alias("hid"), F.col("user_id").alias("v"))


def event_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph, domain: event types by their first letter, as a dimension that reports are joined with."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("graph")).distinct().withColumn("domain", F.substring("graph", 1, 1))
