"""What Python workers need: this package on their path, and batches that their memory holds."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> None:
    """Let workers import this package where it isn't installed."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows while a table of large rows is written."""
    before = spark.conf.get(_RECORDS)
    spark.conf.set(_RECORDS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_RECORDS, before)
