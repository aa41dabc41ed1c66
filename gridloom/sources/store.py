"""Grids at rest: Parquet sorted by leaf, so that a box reads few row groups; dense arrays; text meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.model import IJK, Grid, leaf_key
from gridloom.operators.combine import clip_box


def write(g: Grid, path: str, files: int = 8) -> None:
    """Voxels ranged and sorted by leaf; the background goes to a one-row table beside them."""
    g.df.withColumn("leaf", leaf_key()).repartitionByRange(files, "leaf").sortWithinPartitions("leaf").write.mode("overwrite").parquet(f"{path}/voxels")
    g.df.sparkSession.range(1).select(F.lit(float(g.background)).alias("background")).write.mode("overwrite").parquet(f"{path}/meta")


def read(spark: SparkSession, path: str, low: tuple[int, int, int] | None = None, high: tuple[int, int, int] | None = None) -> Grid:
    """A stored grid, or the part of it in a box: filters on i, j and k reach the scan."""
    background = spark.read.parquet(f"{path}/meta").first()["background"]
    g = Grid(spark.read.parquet(f"{path}/voxels").select(*IJK, "value", "active"), background)
    return g if low is None or high is None else clip_box(g, low, high)


def from_dense(rows: DataFrame, shape: tuple[int, int, int], background: float, tolerance: float = 0.0) -> Grid:
    """Arrays (origin i, j, k; values in order of i, then j, then k) as voxels; those near the background are left out."""
    _, b, c = shape
    cells = rows.select(*IJK, F.posexplode("values").alias("at", "value"))
    at = F.col("at")
    out = cells.select((F.col("i") + F.floor(at / (b * c))).cast("int").alias("i"), (F.col("j") + F.floor(at / c) % b).cast("int").alias("j"), (F.col("k") + at % c).cast("int").alias("k"), "value")
    return Grid(out.where(F.abs(F.col("value") - background) > tolerance).withColumn("active", F.lit(True)), background)


def to_dense(g: Grid, side: int = 8) -> DataFrame:
    """(ni, nj, nk, values): one array of side cubed values for each node that has a voxel."""
    names = [f"n{c}" for c in IJK]
    origin = [(F.floor(F.col(c) / side) * side).cast("int").alias(n) for c, n in zip(IJK, names)]
    cells = g.df.select(*origin, *IJK, "value")
    at = ((F.col("i") - F.col("ni")) * side + F.col("j") - F.col("nj")) * side + F.col("k") - F.col("nk")
    # A group is one node, so its map has at most side cubed entries.
    held = cells.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("at"), "value"))).alias("m"))
    return held.select(*names, F.transform(F.sequence(F.lit(0), F.lit(side**3 - 1)), lambda n: F.coalesce(F.try_element_at("m", n), F.lit(g.background))).alias("values"))


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """Points of a text file with three numbers a line."""
    parts = F.split(F.trim("value"), r"[\s,]+")
    return spark.read.text(path).select(*[F.try_element_at(parts, F.lit(n + 1)).try_cast("double").alias(p) for n, p in enumerate(("px", "py", "pz"))]).where("px is not null and py is not null and pz is not null")


def read_obj(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of an OBJ text file."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.col("value").startswith("v ")).select(*[parts[n + 1].cast("double").alias(p) for n, p in enumerate(("px", "py", "pz"))])
