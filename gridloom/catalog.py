"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans import bands, constrained, dense, ellipsoids, fracture, further, meshing, motion, packing, poisson, sweeping, tracking  # noqa: F401  register their queries
from gridloom.plans import queries as plans


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.SQL)
