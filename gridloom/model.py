"""Sparse grids and points as DataFrames.

A grid is a relation (i, j, k) -> (value, active) with a background value for every coordinate that has no row; such a
coordinate is inactive. Rows are unique by coordinate. Points are rows (id, px, py, pz, attributes); the voxel of a
point is the floor of its position plus one half on each axis.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IJK = ("i", "j", "k")
LEAF, LOWER, UPPER = 3, 7, 12  # log2 of the edges of nodes: 8, 128 and 4096 voxels


@dataclass(frozen=True)
class Grid:
    """Voxels (i, j, k, value, active) and what stands everywhere else."""

    df: DataFrame
    background: float = 0.0

    def with_df(self, df: DataFrame) -> Grid:
        return replace(self, df=df.select(*IJK, "value", "active"))

    def map(self, value: Column, where: Column | None = None) -> Grid:
        """New values of active voxels, or of those that ``where`` names."""
        return self.with_df(self.df.withColumn("value", F.when(F.col("active") if where is None else where, value).otherwise(F.col("value"))))

    @property
    def on(self) -> DataFrame:
        return self.df.where("active")


def grid(df: DataFrame, background: float = 0.0) -> Grid:
    """A grid of rows (i, j, k, value[, active])."""
    active = F.col("active") if "active" in df.columns else F.lit(True)
    return Grid(df.select(*[F.col(c).cast("int").alias(c) for c in IJK], "value", active.alias("active")), background)


def cell(position: Column) -> Column:
    """The voxel of a position: floor(x + 1/2), also below zero."""
    return F.floor(position + 0.5).cast("int")


def node(bits: int) -> list[Column]:
    """Origin of the node of a voxel; the shift keeps negative coordinates right."""
    return [F.shiftleft(F.shiftright(c, bits), bits).alias(f"n{c}") for c in IJK]


def leaf_key() -> Column:
    """Leaf of a voxel as one number; grids partitioned or sorted by it keep neighbours together."""
    part = [F.shiftright(c, LEAF).cast("long").bitwiseAND(0x1FFFFF) for c in IJK]
    return F.shiftleft(part[0], 42).bitwiseOR(F.shiftleft(part[1], 21)).bitwiseOR(part[2])
