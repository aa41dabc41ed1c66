"""Event streams as grids: voxel counts in time windows, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(start, i, k, n, value): events by window, user and hour; works on streams and on tables."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if stream.isStreaming else stream
    per = timed.groupBy(F.window("ts", window), F.col("user_id").cast("int").alias("i"), F.hour("ts").alias("k")).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.floor(F.col("value") * 100 + 0.5)) / 100.0).alias("value"))
    return per.select(F.col("window.start").alias("start"), "i", "k", "n", "value")
