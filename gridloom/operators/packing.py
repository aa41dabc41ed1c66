"""Solids filled with spheres, and the closest place of a surface.

The spheres are those of a greedy choice: always the largest that is left, ties by coordinates; then each candidate
shrinks to what its distance from the new sphere leaves. A candidate of which nothing larger is in reach would be chosen
unchanged whatever else is chosen before it, so a round chooses all such candidates at once and the spheres equal those
chosen one by one. They are found through the largest candidate of each bucket, so a round takes one aggregation of the
candidates and messages between buckets only, never pairs of candidates.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from gridloom.model import IJK, Grid
from gridloom.operators.surface import vertices
from gridloom.operators.tiles import TILES, chunked, finite, matrix, tiled
from gridloom.operators.tree import _forget, _written
from gridloom.workers import small_batches

XYZ = ("x", "y", "z")
#: Spheres reach at most two buckets far, as a bucket is as long as the largest radius.
AROUND = list(product(range(-2, 3), repeat=3))
#: Radii below this are none.
LEAST = 1e-6
#: Voxels of a bucket that one task has; larger buckets are shared out.
SHARE = 1 << 16


def _length(parts: list[Column]) -> Column:
    return F.sqrt(reduce(Column.__add__, [p * p for p in parts]))


def _nearest(batches):
    """The closest place to each point of a chunk among those of its tiles that came one after another."""
    schema, chunk, ids, best = None, None, None, None

    def told():
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), a) for a in (ids, *map(pa.array, best.T))], names=["id", "distance", *XYZ])

    for batch in batches:
        for row in range(batch.num_rows):
            number = batch.column("chunk")[row].as_py()
            points, places = matrix(batch, [f"p{a}" for a in XYZ], row), matrix(batch, list(XYZ), row)
            if number != chunk:
                if chunk is not None:
                    yield told()
                chunk, ids, best = number, batch.column("id")[row].values, np.full((len(points), 4), np.inf)
            away = np.sqrt(sum((points[:, n, None] - places[None, :, n]) ** 2 for n in range(3)))
            at = away.argmin(1)  # places of a chunk are sorted, so ties go to the first
            new = np.column_stack([away[np.arange(len(points)), at], places[at]])
            equal = new[:, 0] == best[:, 0]
            nearer = new[:, 0] < best[:, 0]
            for n in np.flatnonzero(equal):
                nearer[n] = tuple(new[n]) < tuple(best[n])
            best[nearer] = new[nearer]
    if chunk is not None:
        yield told()


def closest_surface(places: DataFrame, points: DataFrame, radius: float = 2.0) -> DataFrame:
    """(id, distance, x, y, z): the closest of ``places`` (x, y, z) to each point (id, px, py, pz), however far; ties by coordinates.

    A round looks into buckets four times as long as its radius, which doubles for points that have found nothing within a
    bucket's length. Chunks of points and places meet as matrices, so what is shuffled and written grows with points and
    places, not with their pairs. Places and points with a null or non-finite coordinate count as none; points are dropped if
    there is no place at all.
    """
    spark = points.sparkSession
    asked = [f"p{a}" for a in XYZ]
    places = places.select(*[F.col(a).cast("double").alias(a) for a in XYZ])
    places = _written(places.where(finite(list(XYZ))))
    waiting = points.select("id", *[F.col(p).cast("double").alias(p) for p in asked])
    waiting = _written(waiting.where(finite(asked)))
    ends = places.unionByName(waiting.select(*[F.col(p).alias(a) for p, a in zip(asked, XYZ)])).agg(*[(F.max(a) - F.min(a)).alias(a) for a in XYZ]).first()
    reach = sum((e or 0.0) ** 2 for e in ends) ** 0.5
    side, parts = radius * 4, []
    lists = StructType([StructField("id", ArrayType(waiting.schema["id"].dataType)), *[StructField(c, ArrayType(DoubleType())) for c in ("distance", *XYZ)]])
    if places.isEmpty():
        reach, waiting = 0.0, waiting.limit(0)
    while True:
        left = chunked(waiting, asked, side, [F.xxhash64("id")])
        right = chunked(places, list(XYZ), side, [F.col(a) for a in XYZ])
        with small_batches(spark, TILES):
            met = _written(tiled(left, right).mapInArrow(_nearest, lists))
        each = met.select(F.inline(F.arrays_zip("id", "distance", *XYZ))).where(F.col("distance") <= side)
        found = _written(each.groupBy("id").agg(F.min(F.struct("distance", *XYZ)).alias("best")).select("id", "best.*"))
        for table in (left, right, met):
            _forget(table)
        parts.append(found)
        if side > reach:
            break
        before, waiting = waiting, _written(waiting.join(found.hint("merge"), "id", "left_anti"))
        _forget(before)
        if waiting.isEmpty():
            break
        side *= 2
    return reduce(DataFrame.unionByName, parts)


def candidates(g: Grid, iso: float = 0.0) -> DataFrame:
    """(i, j, k, r): each voxel inside the surface with its distance from the closest vertex of the surface's mesh."""
    inside = g.df.where(F.col("value") < iso).select(F.struct(*IJK).alias("id"), *[F.col(c).cast("double").alias(f"p{a}") for c, a in zip(IJK, XYZ)])
    return closest_surface(vertices(g, iso), inside).select("id.*", F.col("distance").alias("r"))


def packed(spheres: DataFrame, least: int = 0, most: int | None = None, min_radius: float = 1.0, max_radius: float | None = None, overlapping: bool = False) -> DataFrame:
    """(i, j, k, r): the spheres of the greedy choice among candidates (i, j, k, r), which are unique by voxel.

    A chosen sphere removes candidates whose centre it holds; if spheres may not overlap, others shrink until they touch
    it. Spheres are at least ``min_radius`` large, but ``least`` of them are given where there are so many smaller ones; of
    more than ``most`` the largest stay. Candidates with a null radius, or none above 0, are no spheres.
    """
    floor = max(min_radius, LEAST)
    r = F.col("r").cast("double")
    state = _written(spheres.select(*IJK, (r if max_radius is None else F.least(r, F.lit(float(max_radius)))).alias("r")).where(F.col("r") >= floor))
    chosen: list[DataFrame] = []
    settled = 0
    while (top := state.agg(F.max("r")).first()[0]) is not None:
        if most is not None and chosen:
            settled = sum(c.where(F.col("r") > top).count() for c in chosen)
            if settled >= most:
                break
        state, picked = _round(state, max(top, 1.0), floor, overlapping)
        chosen.append(picked)
    _forget(state)
    out = reduce(DataFrame.unionByName, chosen) if chosen else spheres.select(*IJK, r.alias("r")).limit(0)
    if most is not None:
        out = out.orderBy(F.desc("r"), *IJK).limit(most)
    if floor > LEAST and least and out.count() < least:
        return packed(spheres, 0, least, LEAST, max_radius, overlapping)
    return out


def _round(state: DataFrame, side: float, floor: float, overlapping: bool) -> tuple[DataFrame, DataFrame]:
    """Candidates after a round and the spheres that it chooses; ``side`` is at least the largest radius.

    Tables of buckets are shuffled, however small their files are, so the driver sees no rows.
    """
    keys = [f"b{c}" for c in IJK]
    bucketed = state.withColumns({f"b{c}": F.floor(F.col(c) / side) for c in IJK})
    best = _written(bucketed.groupBy(*keys).agg(F.max(F.struct("r", *[(-F.col(c)).alias(c) for c in IJK])).alias("best")))
    steps = F.inline(F.array(*[F.struct(*[F.lit(x).alias(f"d{c}") for c, x in zip(IJK, o)]) for o in AROUND if any(o)]))
    told = best.select(*keys, F.col("best").alias("other"), steps)
    told = told.select(*[(F.col(f"b{c}") + F.col(f"d{c}")).alias(f"b{c}") for c in IJK], *[F.col(f"b{c}").alias(f"o{c}") for c in IJK], "other")
    gaps = []
    for c in IJK:
        at, low = -F.col(f"best.{c}"), F.col(f"o{c}") * side
        gaps.append(F.greatest(low - at, at - (low + side), F.lit(0.0)))
    grasp = F.col("other.r") + (F.lit(0.0) if overlapping else F.col("best.r"))
    # The margin keeps roundings of bucket edges on the safe side: a candidate that waits in vain is chosen a round later.
    held = told.join(best.hint("merge"), keys).where((F.col("other") > F.col("best")) & (_length(gaps) <= grasp + 1e-6)).select(*keys).distinct()
    free = best.join(held.hint("merge"), keys, "left_anti")
    picked = _written(free.select(*[(-F.col(f"best.{c}")).alias(c) for c in IJK], F.col("best.r").alias("r")))
    _forget(best)
    # Spheres that don't hold each other's centres: a bucket hears of a bounded number of them.
    every = F.inline(F.array(*[F.struct(*[F.lit(x).alias(f"d{c}") for c, x in zip(IJK, o)]) for o in AROUND]))
    heard = picked.select(*[F.floor(F.col(c) / side).alias(f"n{c}") for c in IJK], F.struct(*IJK, "r").alias("sphere"), every)
    heard = heard.groupBy(*[(F.col(f"n{c}") + F.col(f"d{c}")).alias(f"b{c}") for c in IJK]).agg(F.collect_list("sphere").alias("near"))
    away = lambda s: _length([(F.col(c) - s[c]).cast("double") for c in IJK]) - s["r"]
    shares = max(1, int(side) ** 3 // SHARE)
    heard = heard.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    shared = bucketed.withColumn("share", F.pmod(F.hash(*IJK), F.lit(shares)))
    left = shared.join(heard.hint("merge"), [*keys, "share"], "left").withColumn("room", F.coalesce(F.array_min(F.transform("near", away)), F.lit(float("inf"))))
    kept = left.where("room >= 0") if overlapping else left.withColumn("r", F.least("r", "room"))
    after = _written(kept.where(F.col("r") >= floor).select(*IJK, "r"))
    _forget(state)
    return after, picked


def filled(g: Grid, iso: float = 0.0, **settings) -> DataFrame:
    """Spheres inside a level set or a fog, whose rows must reach through the solid; settings are those of :func:`packed`."""
    return packed(candidates(g, iso), **settings)
