"""Values of grids: backgrounds, points of writing, tests of activity, vectors, pruning and topology counts."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.model import IJK, LEAF, Grid, node
from gridloom.operators.stencil import FACES, dealt, tasks_for


def change_background(g: Grid, background: float) -> Grid:
    """Another background; inactive voxels that held the old one, or its negative, follow."""
    v, old = F.col("value"), g.background
    new = F.when(F.col("active"), v).when(v == old, background).when(v == -old, -background).otherwise(v)
    return Grid(g.df.withColumn("value", new), background)


def change_level_set_background(g: Grid, outside: float, inside: float | None = None) -> Grid:
    """Another background; inactive voxels take its value outside, and its negative (or ``inside``) where they were negative."""
    within = -outside if inside is None else inside
    new = F.when(F.col("active"), F.col("value")).when(F.col("value") < 0, within).otherwise(outside)
    return Grid(g.df.withColumn("value", new), outside)


#: How a written value meets the one that stands.
MEET: dict[str, Callable[[Column, Column], Column]] = {"min": F.least, "max": F.greatest, "sum": lambda a, b: a + b, "mult": lambda a, b: a * b}


def set_on(g: Grid, written: DataFrame, how: str) -> Grid:
    """Voxels (i, j, k, value) written over a grid: they meet the value there, or the background, and become active."""
    new = written.select(*IJK, F.col("value").alias("new"))
    met = g.df.join(new, list(IJK), "full")
    here = F.coalesce("value", F.lit(g.background))
    value = F.when(F.col("new").isNull(), here).otherwise(MEET[how](here, F.col("new")))
    return g.with_df(met.select(*IJK, value.alias("value"), (F.col("new").isNotNull() | F.coalesce("active", F.lit(False))).alias("active")))


def active_in(g: Grid, boxes: DataFrame) -> DataFrame:
    """(box, n, any_active, all_active): active voxels of each box (box, li, lj, lk, hi, hj, hk), both ends included.

    Boxes meet leaves by an equality join, so a box costs the leaves that it covers.
    """
    spread = boxes
    for c in IJK:
        spread = spread.withColumn(f"n{c}", F.explode(F.sequence(F.shiftright(f"l{c}", LEAF), F.shiftright(f"h{c}", LEAF))))
    own = g.on.select(*IJK, *[F.shiftright(c, LEAF).alias(f"n{c}") for c in IJK])
    inside = [F.col(c).between(F.col(f"l{c}"), F.col(f"h{c}")) for c in IJK]
    met = spread.join(own, [f"n{c}" for c in IJK]).where(inside[0] & inside[1] & inside[2]).groupBy("box").agg(F.count(F.lit(1)).alias("n"))
    size = (F.col("hi") - F.col("li") + 1).cast("long") * (F.col("hj") - F.col("lj") + 1) * (F.col("hk") - F.col("lk") + 1)
    n = F.coalesce("n", F.lit(0).cast("long"))
    return boxes.join(met, "box", "left").select("box", n.alias("n"), (n > 0).alias("any_active"), (n == size).alias("all_active"))


def tile_counts(g: Grid, bits: int = LEAF) -> DataFrame:
    """Nodes with an active voxel, those that are full, and those that are full of one value."""
    per = g.on.groupBy(*node(bits)).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("a"), F.max("value").alias("b"))
    full = F.col("n") == 1 << 3 * bits
    return per.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(full).alias("full"), F.count_if(full & (F.col("a") == F.col("b"))).alias("constant"))


def transform_vectors(df: DataFrame, matrix: list[float], names: tuple[str, str, str] = ("gx", "gy", "gz"), shift: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Vector columns by a 3 x 3 matrix (rows one after another) and a shift, which positions take and directions don't."""
    v = [F.col(n) for n in names]
    moved = {n: v[0] * matrix[3 * m] + v[1] * matrix[3 * m + 1] + v[2] * matrix[3 * m + 2] + shift[m] for m, n in enumerate(names)}
    return df.withColumns(moved)


def prune_inactive(g: Grid, bits: int = LEAF) -> Grid:
    """Without the nodes that have no active voxel: these are background again."""
    keyed = g.df.select(*IJK, "value", "active", *node(bits))
    names = [f"n{c}" for c in IJK]
    return g.with_df(keyed.join(keyed.where("active").select(*names).distinct(), names, "left_semi"))


def prune_level_set(g: Grid, outside: float, inside: float, bits: int = LEAF) -> DataFrame:
    """(i, j, k, level, value, active): nodes without an active voxel become a tile by the sign of their first voxel."""
    names = [f"n{c}" for c in IJK]
    keyed = g.df.select(*IJK, "value", "active", *node(bits))
    told = keyed.groupBy(*names).agg(F.max("active").alias("on"), F.min_by("value", F.struct(*IJK)).alias("first"))
    tiles = told.where("not on").select(*[F.col(n).alias(c) for n, c in zip(names, IJK)], F.lit(1).alias("level"), F.when(F.col("first") < 0, inside).otherwise(outside).alias("value"), F.lit(False).alias("active"))
    rest = keyed.join(told.where("on").select(*names), names)
    return rest.select(*IJK, F.lit(0).alias("level"), "value", "active").unionByName(tiles)


def euler(g: Grid) -> DataFrame:
    """(vertices, edges, faces, cubes, euler, genus) of the solid of active voxels; genus of its surface if it is one piece
    without cavities."""
    parts = []
    for kind, odd in (("vertices", 0), ("edges", 1), ("faces", 2), ("cubes", 3)):
        # In doubled coordinates, relative to the voxel's centre, a cell is even on as many axes as it has extents.
        steps = [o for o in product((-1, 0, 1), repeat=3) if o.count(0) == odd]
        sent = F.inline(F.array(*[F.struct(*[F.lit(x).alias(f"d{c}") for c, x in zip(IJK, o)]) for o in steps]))
        cells = g.on.select(*IJK, sent).select(*[(F.col(c) * 2 + F.col(f"d{c}")).alias(c) for c in IJK]).distinct()
        parts.append(cells.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n"))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    found = every.groupBy().agg(*[F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in ("vertices", "edges", "faces", "cubes")])
    chi = F.col("vertices") - F.col("edges") + F.col("faces") - F.col("cubes")
    return found.withColumn("euler", chi).withColumn("genus", 1 - F.col("euler"))


def enclosed(g: Grid, reached: DataFrame) -> Grid:
    """Mask of voxels of g that aren't among the reached ones."""
    return Grid(g.df.join(reached.select(*IJK), list(IJK), "left_anti").select(*IJK, F.lit(1.0).alias("value"), F.lit(True).alias("active")), 0.0)


def skin(g: Grid, tasks: int | None = None) -> DataFrame:
    """(i, j, k, inner): active voxels with an inactive face neighbour, and those neighbours; dealt out over ``tasks``."""
    on = g.on.select(*IJK)
    tasks = tasks or tasks_for(on, on.count() * len(FACES))
    on = dealt(on, tasks)
    sent = F.inline(F.array(*[F.struct(*[F.lit(x).alias(f"d{c}") for c, x in zip(IJK, o)]) for o in FACES]))
    beside = on.select(*[F.col(c).alias(f"o{c}") for c in IJK], sent).select(*[(F.col(f"o{c}") + F.col(f"d{c}")).alias(c) for c in IJK], *[f"o{c}" for c in IJK])
    out = dealt(beside, tasks).join(on, list(IJK), "left_anti")
    inner = dealt(out.select(*[F.col(f"o{c}").alias(c) for c in IJK]), tasks).distinct().withColumn("inner", F.lit(True))
    return inner.unionByName(out.select(*IJK).distinct().withColumn("inner", F.lit(False)))
