"""Observation series made from the relational test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def total(column: str) -> Column:
    """Sum of an amount as a double. It is summed as a decimal, so the order of rows doesn't matter."""
    return F.sum(F.col(column).cast("decimal(18,4)")).cast("double")


def lineitem_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price per unit and units of each shipping day."""
    df = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("ts"))
    q = total("l_quantity")
    return df.agg((total("l_extendedprice") / q).alias("close"), q.alias("volume")).select(F.lit("lineitem").alias("series_id"), "ts", "close", "volume")


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("ts"))
    return df.agg(total("o_totalprice").alias("close"), F.count("*").cast("double").alias("volume")).select(F.lit("orders").alias("series_id"), "ts", "close", "volume")


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"))
    return df.agg((total("value") / F.count("value")).alias("close"), F.count("*").cast("double").alias("volume")).select(F.lit("events").alias("series_id"), "ts", "close", "volume")


def segment_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series for each market segment: order value and orders of each day."""
    customers = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    df = joined.groupBy(F.col("c_mktsegment").alias("series_id"), F.col("o_orderdate").cast("date").alias("ts"))
    return df.agg(total("o_totalprice").alias("close"), F.count("*").cast("double").alias("volume"))
