"""Grids and points made from the driver's tables. Sums are of whole cents, so their order doesn't matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import Grid, grid


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _summed(rows: DataFrame, value: str) -> Grid:
    cents = F.sum(F.floor(F.col(value) * 100 + 0.5)).cast("double") / 100
    return grid(rows.groupBy("i", "j", "k").agg(cents.alias("value")))


def cube(spark: SparkSession, sf_dir: str) -> Grid:
    """Line items by quantity, discount and tax: their price."""
    t = read(spark, sf_dir, "lineitem")
    return _summed(t.select(F.floor("l_quantity").cast("int").alias("i"), F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("j"), F.floor(F.col("l_tax") * 100 + 0.5).cast("int").alias("k"), F.col("l_extendedprice").alias("v")), "v")


def by_flag(spark: SparkSession, sf_dir: str, flag: str) -> Grid:
    """Line items of a return flag by quantity, price class and part class: their price."""
    t = read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    return _summed(t.select(F.floor("l_quantity").cast("int").alias("i"), F.floor(F.col("l_extendedprice") / 2500).cast("int").alias("j"), (F.col("l_partkey") % 50).cast("int").alias("k"), F.col("l_extendedprice").alias("v")), "v")


def events(spark: SparkSession, sf_dir: str, kind: str | None = None) -> Grid:
    """Events by user, day and hour: the sum of their values."""
    t = read(spark, sf_dir, "events")
    t = t if kind is None else t.where(F.col("event_type") == kind)
    return _summed(t.select(F.col("user_id").cast("int").alias("i"), F.dayofmonth("ts").alias("j"), F.hour("ts").alias("k"), F.col("value").alias("v")), "v")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points: their first three components times 100."""
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[(e[n].cast("double") * 100).alias(p) for n, p in enumerate(("px", "py", "pz"))], "label")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points: quantity, price in thousands, part in forties."""
    t = read(spark, sf_dir, "lineitem")
    return t.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("px"), (F.col("l_extendedprice") / 1000).alias("py"), (F.col("l_partkey") / 40.0).alias("pz"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
