"""Points that a field carries along a surface: in turns, they move and are put back where the surface is closest.

The closest places of a level set's voxels are one table (i, j, k, x, y, z), made once; a projection is its trilinear
sample at the point. All three coordinates come in one join and one aggregation, in which corners are weighed before the
shuffle, too.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.model import IJK, Grid
from gridloom.operators.points import P, advected
from gridloom.operators.stencil import closest_point
from gridloom.operators.tree import _written

XYZ = ("x", "y", "z")


def closest_places(g: Grid) -> DataFrame:
    """(i, j, k, x, y, z): where the surface is closest to a voxel, for voxels whose six neighbours have a row."""
    return closest_point(Grid(g.on, None)).where("x is not null and y is not null and z is not null")


def put_back(points: DataFrame, places: DataFrame, times: int = 1) -> DataFrame:
    """Points (id, px, py, pz) moved to the trilinear sample of their closest places, ``times`` times.

    A point with a voxel around it that has no place (it is too far from the surface), and one with a null coordinate, stays.
    """
    for _ in range(times):
        low = [F.floor(p).cast("int").alias(f"l{p}") for p in P]

        def corner(o: tuple[int, ...]) -> Column:
            w = F.lit(1.0)
            for p, d in zip(P, o):
                t = F.col(p) - F.col(f"l{p}")
                w = w * (t if d else F.lit(1.0) - t)
            return F.struct(*[(F.col(f"l{p}") + d).alias(c) for p, c, d in zip(P, IJK, o)], w.alias("w"))

        corners = points.select("id", *P, *low).select("id", *P, F.inline(F.array(*map(corner, product((0, 1), repeat=3))))).where("w > 0 or w is null")
        met = corners.join(places, list(IJK), "left").groupBy("id", *P)
        sums = met.agg((F.count("x") == F.count(F.lit(1))).alias("_all"), *[F.sum(F.col("w") * F.col(a)).alias(f"_{a}") for a in XYZ])
        points = sums.select("id", *[F.when(F.col("_all"), F.col(f"_{a}")).otherwise(F.col(p)).alias(p) for a, p in zip(XYZ, P)])
    return points


def carried_along(points: DataFrame, g: Grid, velocity, step: float, steps: int = 1, projections: int = 1, order: int = 4) -> DataFrame:
    """Points (id, px, py, pz, attributes) that a field moves along a level set's surface; ids are unique.

    ``velocity`` gives columns of a position's. A step is one of the first or fourth order, or none with order 0, followed
    by the projections. Steps are written, so that plans don't grow with them.
    """
    if order not in (0, 1, 4):
        raise ValueError("the order is 0, 1 or 4")
    places = _written(closest_places(g))
    at = points.select("id", *[F.col(p).cast("double").alias(p) for p in P])
    for n in range(steps if order else 1):
        if order == 4:
            at = advected(at, velocity, step)
        elif order == 1:
            at = at.withColumns({p: F.col(p) + v * step for p, v in zip(P, velocity(*[F.col(p) for p in P]))})
        at = put_back(at, places, projections)
        if n + 1 < steps and order:
            at = _written(at)
    return points.drop(*P).join(at, "id").select(points.columns)
