"""Rays through grids, runs along an axis, and affine moves of grids."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.model import IJK, Grid, cell
from gridloom.operators.sample import trilinear

AXES = ("x", "y", "z")


def crossed(rays: DataFrame, length: float) -> DataFrame:
    """(id, i, j, k, enter, leave): the voxels that each ray (id, ox, oy, oz, dx, dy, dz) passes, up to time ``length``.

    A ray changes its voxel where it crosses a plane between voxels; the times of all crossings, sorted, are the ends of
    its spans. Null parts give no voxels; a zero direction stays in one.
    """

    def times(a: str) -> Column:
        o, d = F.col(f"o{a}"), F.col(f"d{a}")
        first, last = cell(F.least(o, o + d * length)) + 1, cell(F.greatest(o, o + d * length))
        planes = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(planes, lambda n: F.try_divide(n - F.lit(0.5) - o, d))

    at = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(float(length))), *map(times, AXES)))
    timed = rays.withColumn("_t", F.filter(at, lambda t: (t >= 0) & (t <= length)))
    spans = F.transform(F.sequence(F.lit(1), F.size("_t") - 1), lambda n: F.struct(F.get("_t", n - 1).alias("enter"), F.get("_t", n).alias("leave")))
    rows = timed.where(F.size("_t") > 1).select("id", *[f"{p}{a}" for p in "od" for a in AXES], F.inline(spans)).where("leave > enter")
    middle = (F.col("enter") + F.col("leave")) / 2
    return rows.select("id", *[cell(F.col(f"o{a}") + F.col(f"d{a}") * middle).alias(c) for a, c in zip(AXES, IJK)], "enter", "leave")


def hits(g: Grid, rays: DataFrame, length: float) -> DataFrame:
    """(id, enter, i, j, k, value): the first active voxel on each ray; rays without one have no row."""
    met = crossed(rays, length).join(g.on.select(*IJK, "value"), list(IJK))
    first = met.groupBy("id").agg(F.min(F.struct("enter", *IJK, "value")).alias("f"))
    return first.select("id", "f.*")


def through(g: Grid, rays: DataFrame, length: float) -> DataFrame:
    """(id, n, total): active voxels on each ray, and their values weighed by the time spent in them."""
    met = crossed(rays, length).join(g.on.select(*IJK, "value"), list(IJK))
    return met.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * (F.col("leave") - F.col("enter"))).alias("total"))


def runs(g: Grid, along: int = 2) -> DataFrame:
    """Unbroken runs of active voxels along an axis: the other two coordinates, first, last and number of voxels."""
    c = IJK[along]
    rest = [x for x in IJK if x != c]
    line = Window.partitionBy(*rest).orderBy(c)
    island = g.on.select(*IJK, (F.col(c) - F.row_number().over(line)).alias("_r"))
    return island.groupBy(*rest, "_r").agg(F.min(c).alias("first"), F.max(c).alias("last"), F.count(F.lit(1)).alias("n")).drop("_r")


def transformed(g: Grid, matrix: list[list[float]], shift: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> Grid:
    """A grid moved by position -> matrix * position + shift; each new voxel is the sample where it came from.

    Asked are the voxels in the image of an active voxel's surroundings; those with an active corner stay.
    """
    m = np.asarray(matrix, float)
    back = np.linalg.inv(m)
    rows = g.on.select(*IJK)
    for n, c in enumerate(IJK):
        to = reduce(Column.__add__, [F.col(o) * float(m[n, x]) for x, o in enumerate(IJK)]) + shift[n]
        reach = float(np.abs(m[n]).sum())
        rows = rows.withColumn(f"t{c}", F.sequence(F.ceil(to - reach).cast("int"), F.floor(to + reach).cast("int")))
    for c in IJK:
        rows = rows.withColumn(f"t{c}", F.explode(f"t{c}"))
    new = rows.select(*[F.col(f"t{c}").alias(c) for c in IJK]).distinct()
    asked = new.select(F.struct(*IJK).alias("id"), *[reduce(Column.__add__, [(F.col(o) - shift[x]) * float(back[n, x]) for x, o in enumerate(IJK)]).alias(a) for n, a in enumerate(AXES)])
    found = trilinear(g, asked).where("active")
    return Grid(found.select(*[F.col("id")[c].alias(c) for c in IJK], "value", "active"), g.background)
