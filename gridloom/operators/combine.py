"""Two grids into one: full outer joins on coordinates in which a missing voxel is the background.

The result's background is the same combination of the two backgrounds. A result voxel is active if either is.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.model import IJK, Grid


def paired(a: Grid, b: Grid, how: str = "full_outer") -> DataFrame:
    """(i, j, k, a, b, on_a, on_b, has_a, has_b)."""
    left = a.df.select(*IJK, F.col("value").alias("a"), F.col("active").alias("on_a"), F.lit(True).alias("has_a"))
    right = b.df.select(*IJK, F.col("value").alias("b"), F.col("active").alias("on_b"), F.lit(True).alias("has_b"))
    met = left.join(right, list(IJK), how)
    no = F.lit(False)
    return met.select(*IJK, F.coalesce("a", F.lit(a.background)).alias("a"), F.coalesce("b", F.lit(b.background)).alias("b"), *[F.coalesce(c, no).alias(c) for c in ("on_a", "on_b", "has_a", "has_b")])


def combine(a: Grid, b: Grid, f: Callable[[Column, Column], Column], background: float, active: Column | None = None) -> Grid:
    """f of the two values wherever either grid has a voxel."""
    state = F.col("on_a") | F.col("on_b") if active is None else active
    return Grid(paired(a, b).select(*IJK, f(F.col("a"), F.col("b")).alias("value"), state.alias("active")), background)


def minimum(a: Grid, b: Grid) -> Grid:
    return combine(a, b, F.least, min(a.background, b.background))


def maximum(a: Grid, b: Grid) -> Grid:
    return combine(a, b, F.greatest, max(a.background, b.background))


def add(a: Grid, b: Grid) -> Grid:
    return combine(a, b, lambda x, y: x + y, a.background + b.background)


def multiply(a: Grid, b: Grid) -> Grid:
    return combine(a, b, lambda x, y: x * y, a.background * b.background)


def divide(a: Grid, b: Grid) -> Grid:
    """IEEE division: x/0 is infinite, 0/0 is no number."""
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    by_zero = lambda x: F.when(x > 0, inf).when(x < 0, -inf).otherwise(nan)
    bg = a.background / b.background if b.background else float("nan") if not a.background else float("inf") * (1 if a.background > 0 else -1)
    return combine(a, b, lambda x, y: F.when(y == 0, by_zero(x)).otherwise(F.try_divide(x, y)), bg)


def over(a: Grid, b: Grid) -> Grid:
    """b's active values replace a's."""
    met = paired(a, b)
    return Grid(met.select(*IJK, F.when(F.col("on_b"), F.col("b")).otherwise(F.col("a")).alias("value"), (F.col("on_a") | F.col("on_b")).alias("active")), a.background)


def union(a: Grid, b: Grid) -> Grid:
    """Level sets: inside either."""
    chosen = F.when(F.col("a") <= F.col("b"), F.col("on_a")).otherwise(F.col("on_b"))
    return combine(a, b, F.least, min(a.background, b.background), chosen)


def intersection(a: Grid, b: Grid) -> Grid:
    """Level sets: inside both."""
    chosen = F.when(F.col("a") >= F.col("b"), F.col("on_a")).otherwise(F.col("on_b"))
    return combine(a, b, F.greatest, max(a.background, b.background), chosen)


def difference(a: Grid, b: Grid) -> Grid:
    """Level sets: inside a, outside b."""
    chosen = F.when(F.col("a") >= -F.col("b"), F.col("on_a")).otherwise(F.col("on_b"))
    return combine(a, b, lambda x, y: F.greatest(x, -y), a.background, chosen)


def topology(a: Grid, b: Grid, kind: str) -> Grid:
    """a with states by b's: union, intersection or difference. Values of a stay."""
    state = {"union": F.col("on_a") | F.col("on_b"), "intersection": F.col("on_a") & F.col("on_b"), "difference": F.col("on_a") & ~F.col("on_b")}[kind]
    met = paired(a, b, "full_outer" if kind == "union" else "left")
    return Grid(met.where(F.col("has_a") | F.col("on_b")).select(*IJK, F.col("a").alias("value"), state.alias("active")), a.background)


def merge(grids: list[Grid], how: str = "sum") -> Grid:
    """Many grids at once, by one aggregation instead of a chain of joins: sum, min, max, count or first.

    Only stored values take part, so backgrounds should be neutral for ``how``. first: the earliest grid with an
    active voxel wins.
    """
    rows = reduce(DataFrame.unionByName, [g.df.withColumn("n", F.lit(n)) for n, g in enumerate(grids)])
    of = {"sum": F.sum("value"), "min": F.min("value"), "max": F.max("value"), "count": F.sum(F.col("active").cast("int")).cast("double"), "first": F.min_by("value", F.struct(~F.col("active"), "n"))}
    return Grid(rows.groupBy(*IJK).agg(of[how].alias("value"), F.max("active").alias("active")), grids[0].background)


def clip_box(g: Grid, low: tuple[int, int, int], high: tuple[int, int, int], keep_inside: bool = True) -> Grid:
    """Voxels inside (or outside) a box whose ends count; on a scan it is a pushed filter."""
    inside = reduce(Column.__and__, [F.col(c).between(a, b) for c, a, b in zip(IJK, low, high)])
    return g.with_df(g.df.where(inside if keep_inside else ~inside))


def clip_mask(g: Grid, mask: Grid, keep_inside: bool = True) -> Grid:
    """Voxels where the mask is active (or isn't)."""
    return g.with_df(g.df.join(mask.on.select(*IJK), list(IJK), "left_semi" if keep_inside else "left_anti"))


def fill(g: Grid, low: tuple[int, int, int], high: tuple[int, int, int], value: float, active: bool = True) -> Grid:
    """A box of one value; a later row replaces an earlier one."""
    sides = [h - a + 1 for a, h in zip(low, high)]
    n = g.df.sparkSession.range(sides[0] * sides[1] * sides[2])
    i, j, k = F.expr(f"id div {sides[1] * sides[2]}"), F.expr(f"(id div {sides[2]}) % {sides[1]}"), F.expr(f"id % {sides[2]}")
    box = n.select((i + low[0]).cast("int").alias("i"), (j + low[1]).cast("int").alias("j"), (k + low[2]).cast("int").alias("k"), F.lit(float(value)).alias("value"), F.lit(active).alias("active"))
    return g.with_df(clip_box(g, low, high, False).df.unionByName(box))


def activate(g: Grid, value: float, tolerance: float = 0.0) -> Grid:
    """Inactive voxels with the value become active."""
    return g.with_df(g.df.withColumn("active", F.col("active") | (F.abs(F.col("value") - value) <= tolerance)))


def deactivate(g: Grid, value: float, tolerance: float = 0.0) -> Grid:
    """Active voxels with the value become inactive."""
    return g.with_df(g.df.withColumn("active", F.col("active") & (F.abs(F.col("value") - value) > tolerance)))


def mask(g: Grid) -> Grid:
    """Active voxels, each with value 1."""
    return Grid(g.on.select(*IJK, F.lit(1.0).alias("value"), F.lit(True).alias("active")), 0.0)


def merge_csg(grids: list[Grid], kind: str = "union") -> Grid:
    """Union, intersection or difference (the first less all others) of many level sets by one aggregation.

    A grid without a row at a coordinate counts with its background there, inactive. Active where the grid that wins
    is, or one of those that do.
    """
    flip = [-1.0 if kind == "difference" and n else 1.0 for n in range(len(grids))]
    ends = [g.background * s for g, s in zip(grids, flip)]
    union = kind == "union"
    state = F.col("active") != F.lit(union)
    rows = reduce(DataFrame.unionByName, [g.df.select(*IJK, (F.col("value") * s).alias("value"), state.alias("state"), F.lit(n).alias("n")) for n, (g, s) in enumerate(zip(grids, flip))])
    own = [F.coalesce(F.max(F.when(F.col("n") == n, F.struct("value", "state"))), F.struct(F.lit(e).alias("value"), F.lit(union).alias("state"))) for n, e in enumerate(ends)]
    best = rows.groupBy(*IJK).agg((F.array_min if union else F.array_max)(F.array(*own)).alias("best"))
    return Grid(best.select(*IJK, "best.value", (F.col("best.state") != F.lit(union)).alias("active")), (min if union else max)(ends))
