"""Level sets of triangles that need not be closed nor look the same way, and regions that walls enclose.

Distances don't depend on which way triangles look; signs come from a flood from outside. Voxels within half a voxel's
diagonal of a triangle are a wall without gaps, also over holes smaller than a voxel. Leaves that the wall or its band
meets are spelt out as voxels, all others of the box around them are one node each. Both are joined into parts, parts
that touch across leaf faces are linked, and the flood runs over parts: a few rounds over short tables, however large the
parts are. What stands for empty space is one row for 512 voxels of the box.

A voxel of the wall is outside if a neighbour is that the flood has reached and that lies on the same side of the nearest
point of the triangles. Each has one on its own side, as a step along some diagonal leaves the wall.

Defined results: where a hole is larger than a voxel the flood goes in, and both sides of its triangles are outside; a
voxel on a triangle has distance 0; triangles without area count as their edges; without triangles there are no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.model import IJK, LEAF, Grid
from gridloom.operators.stencil import CUBE
from gridloom.operators.surface import nearest
from gridloom.operators.tree import _forget, _written, segments

#: Half the diagonal of a voxel.
WALL = 3**0.5 / 2


def exterior(cells: DataFrame) -> DataFrame:
    """(i, j, k): voxels without a wall that can be reached from outside, among all in the leaves of (i, j, k, wall).

    Voxels of these leaves that have no row are open, and so are all other leaves.
    """
    leaf = [F.shiftright(c, LEAF).alias(c) for c in IJK]
    leaves = _written(cells.select(*leaf).distinct())
    if leaves.isEmpty():
        return cells.select(*IJK).where("false")
    every = leaves
    for c in IJK:
        every = every.withColumn(c, F.explode(F.sequence(F.shiftleft(c, LEAF), F.shiftleft(c, LEAF) + ((1 << LEAF) - 1))))
    open_ = every.join(cells.where("wall").select(*IJK), list(IJK), "left_anti")
    voxels = _written(segments(Grid(open_.select(*IJK, F.lit(1.0).alias("value"), F.lit(True).alias("active")))).select(*IJK, F.struct("si", "sj", "sk").alias("part")))
    # The box of the leaves and a layer more, which is one part: the outside.
    ends = leaves.agg(*[f(c).alias(f"{n}{c}") for c in IJK for n, f in (("l", F.min), ("h", F.max))])
    box = ends
    for c in IJK:
        box = box.withColumn(c, F.explode(F.sequence(F.col(f"l{c}") - 1, F.col(f"h{c}") + 1)))
    empty = box.select(*IJK).join(leaves, list(IJK), "left_anti")
    nodes = _written(segments(Grid(empty.select(*IJK, F.lit(1.0).alias("value"), F.lit(True).alias("active")))).select(*IJK, F.struct("si", "sj", "sk").alias("node")))
    # Open voxels at a leaf's face look into the next leaf.
    last = (1 << LEAF) - 1
    looks = F.explode(F.array(*[F.when(F.col(c).bitwiseAND(last) == edge, F.struct(*[(F.shiftright(x, LEAF) + (step if x == c else 0)).alias(f"t{x}") for x in IJK])) for c in IJK for edge, step in ((0, -1), (last, 1))]))
    seen = voxels.select("part", looks.alias("to")).where("to is not null").select("part", *[F.col(f"to.t{c}").alias(c) for c in IJK])
    links = _written(seen.join(nodes, list(IJK)).select("part", "node").distinct())
    first = ends.select(*[(F.col(f"l{c}") - 1).alias(c) for c in IJK])
    reached = _written(first.join(nodes, list(IJK)).select("node"))
    parts = _written(links.join(reached, "node", "left_semi").select("part").distinct())
    while True:
        more = _written(links.join(parts, "part", "left_semi").select("node").distinct())
        wider = _written(links.join(more, "node", "left_semi").select("part").distinct())
        grown = wider.count() > parts.count()
        _forget(more)
        _forget(parts)
        parts = wider
        if not grown:
            break
    return voxels.join(parts, "part", "left_semi").select(*IJK)


def level_set(triangles: DataFrame, half: float = 3.0) -> Grid:
    """Narrow band of triangles (ax ... ez, cx, cy, cz), negative where the outside doesn't reach."""
    band = _written(nearest(triangles, max(half, WALL)))
    wall = band.where(F.col("d") < WALL)
    # Leaves of the wall's neighbours are spelt out, too: a leaf around a voxel holds one of its corners.
    around = F.inline(F.array(*[F.struct(*[(F.col(c) + x).alias(f"n{c}") for c, x in zip(IJK, o)]) for o in product((-1, 1), repeat=3)]))
    beside = wall.select(around).select(*[F.col(f"n{c}").alias(c) for c in IJK], F.lit(False).alias("wall"))
    outside = _written(exterior(band.select(*IJK, (F.col("d") < WALL).alias("wall")).unionByName(beside)))
    # Voxels of the wall ask their neighbours.
    sent = F.inline(F.array(*[F.struct(*[F.lit(x).alias(f"d{c}") for c, x in zip(IJK, o)]) for o in CUBE]))
    asked = wall.select(F.struct(*IJK).alias("own"), "fx", "fy", "fz", *IJK, sent)
    ahead = reduce(Column.__add__, [(F.col(c) + F.col(f"d{c}") - F.col(f"f{x}")) * (F.col(c) - F.col(f"f{x}")) for c, x in zip(IJK, "xyz")])
    same = asked.where(ahead > 0).select("own", *[(F.col(c) + F.col(f"d{c}")).alias(c) for c in IJK]).join(outside, list(IJK), "left_semi").select("own.*").distinct()
    free = outside.join(band.where(F.col("d") >= WALL).select(*IJK), list(IJK), "left_semi")
    out = free.unionByName(same).withColumn("out", F.lit(True))
    signed = band.join(out, list(IJK), "left").select(*IJK, F.when(F.col("out") | (F.col("d") == 0), F.col("d")).otherwise(-F.col("d")).alias("value"), F.lit(True).alias("active"))
    return Grid(signed.where(F.abs("value") < half), half)


def enclosed_region(g: Grid, iso: float = 0.0) -> Grid:
    """Mask of active voxels at or above ``iso`` that lower ones shut off from the outside: the cavities of solids."""
    cells = _written(g.on.select(*IJK, (F.col("value") < iso).alias("wall")))
    found = cells.where("not wall").select(*IJK).join(exterior(cells), list(IJK), "left_anti")
    return Grid(found.select(*IJK, F.lit(1.0).alias("value"), F.lit(True).alias("active")), 0.0)


def flooded_signs(g: Grid) -> Grid:
    """Inactive voxels take the sign of the side of the active ones' surface that they are on: outside is what the flood
    from outside reaches without crossing an active voxel below 0, or another inactive voxel shut in by such."""
    cells = _written(g.df.select(*IJK, "value", "active", (F.col("active") & (F.col("value") < 0)).alias("wall")))
    out = exterior(cells.select(*IJK, "wall")).withColumn("out", F.lit(True))
    value = F.when(F.col("active"), F.col("value")).otherwise(F.when(F.col("out"), F.abs("value")).otherwise(-F.abs("value")))
    return g.with_df(cells.join(out, list(IJK), "left").withColumn("value", value))
