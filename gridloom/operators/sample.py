"""Values between voxels: nearest, trilinear, quadratic and staggered samples, and resampling.

Each sample asks for the few voxels around it, one join on coordinates brings their values, and one aggregation by
sample weighs them. Missing voxels are the background.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.model import IJK, Grid, cell

AXES = ("x", "y", "z")


def nearest(g: Grid, at: DataFrame) -> DataFrame:
    """(id, value, active) of the voxel nearest to each (id, x, y, z)."""
    asked = at.select("id", *[cell(F.col(a)).alias(c) for a, c in zip(AXES, IJK)])
    return asked.join(g.df, list(IJK), "left").select("id", F.coalesce("value", F.lit(g.background)).alias("value"), F.coalesce("active", F.lit(False)).alias("active"))


def _weighted(g: Grid, corners: DataFrame) -> DataFrame:
    """Sums of corners (id, i, j, k, w)."""
    met = corners.join(g.df, list(IJK), "left")
    return met.groupBy("id").agg(F.sum(F.col("w") * F.coalesce("value", F.lit(g.background))).alias("value"), F.coalesce(F.max("active"), F.lit(False)).alias("active"))


def trilinear(g: Grid, at: DataFrame) -> DataFrame:
    """(id, value, active): weights of the eight corners; active if any corner is."""
    low = [F.floor(a).cast("int").alias(f"l{a}") for a in AXES]
    part = at.select("id", *AXES, *low)

    def corner(o: tuple[int, ...]) -> Column:
        w = F.lit(1.0)
        for a, d in zip(AXES, o):
            t = F.col(a) - F.col(f"l{a}")
            w = w * (t if d else F.lit(1.0) - t)
        return F.struct(*[(F.col(f"l{a}") + d).alias(c) for a, c, d in zip(AXES, IJK, o)], w.alias("w"))

    return _weighted(g, part.select("id", F.inline(F.array(*map(corner, product((0, 1), repeat=3))))))


def quadratic(g: Grid, at: DataFrame) -> DataFrame:
    """(id, value, active): a parabola through three voxels on each axis, around the floor of the position."""
    part = at.select("id", *AXES, *[F.floor(a).cast("int").alias(f"l{a}") for a in AXES])

    def weight(t: Column, d: int) -> Column:
        return t * (t - 1.0) / 2 if d < 0 else F.lit(1.0) - t * t if not d else t * (t + 1.0) / 2

    def corner(o: tuple[int, ...]) -> Column:
        w = F.lit(1.0)
        for a, d in zip(AXES, o):
            w = w * weight(F.col(a) - F.col(f"l{a}"), d)
        return F.struct(*[(F.col(f"l{a}") + d).alias(c) for a, c, d in zip(AXES, IJK, o)], w.alias("w"))

    return _weighted(g, part.select("id", F.inline(F.array(*map(corner, product((-1, 0, 1), repeat=3))))))


def staggered(parts: dict[str, Grid], at: DataFrame) -> DataFrame:
    """(id, vx, vy, vz) of a velocity whose parts stand on the faces of voxels: each is shifted by a half."""
    out = at.select("id")
    for n, (axis, g) in enumerate(zip(AXES, (parts["x"], parts["y"], parts["z"]))):
        moved = at.select("id", *[(F.col(a) + (0.5 if m == n else 0.0)).alias(a) for m, a in enumerate(AXES)])
        out = out.join(trilinear(g, moved).select("id", F.col("value").alias(f"v{axis}")), "id")
    return out


def resample(g: Grid, factor: int) -> Grid:
    """A grid of voxels ``factor`` times as large, each the trilinear sample at its origin."""
    coarse = g.on.select(*[F.floor(F.col(c) / factor).cast("int").alias(f"c{c}") for c in IJK]).distinct()
    asked = coarse.select(F.struct(*[f"c{c}" for c in IJK]).alias("id"), *[(F.col(f"c{c}") * float(factor)).alias(a) for c, a in zip(IJK, AXES)])
    found = trilinear(g, asked)
    return Grid(found.select(*[F.col("id")[f"c{c}"].alias(c) for c in IJK], "value", "active"), g.background)
