"""Reductions: counts, boxes, extremes, moments, histograms, roll-ups over nodes, diagnostics and measures.

All are aggregations with partial sums before the shuffle; only their few results meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.model import IJK, LEAF, LOWER, UPPER, Grid, node
from gridloom.operators.stencil import FACES, axis, gather, name


def count(g: Grid) -> DataFrame:
    """Active and inactive voxels, and leaves with an active one."""
    return g.df.agg(F.count_if("active").alias("active"), F.count_if(~F.col("active")).alias("inactive"), F.count_distinct(F.when(F.col("active"), F.struct(*node(LEAF)))).alias("leaves"))


def bounds(g: Grid) -> DataFrame:
    """The box of active voxels, both ends included; nulls if there are none."""
    return g.on.agg(*[F.min(c).alias(f"min_{c}") for c in IJK], *[F.max(c).alias(f"max_{c}") for c in IJK])


def min_max(g: Grid) -> DataFrame:
    return g.on.agg(F.min("value").alias("least"), F.max("value").alias("most"))


def statistics(g: Grid) -> DataFrame:
    """Count, extremes, mean, population variance and deviation of active values."""
    return g.on.agg(F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.stddev_pop("value").alias("deviation"))


def histogram(g: Grid, low: float, high: float, bins: int) -> DataFrame:
    """Active values in equal bins of [low, high]; the last bin has its upper end, values outside are left out."""
    at = F.least(F.floor((F.col("value") - low) * bins / (high - low)), F.lit(bins - 1))
    return g.on.where(F.col("value").between(low, high)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def nodes(g: Grid) -> DataFrame:
    """Count, extremes and sum for each leaf, for the two levels of nodes above it, and for all."""
    active = g.on.select("value", *[F.shiftright(c, bits).alias(f"{c}{bits}") for bits in (LEAF, LOWER, UPPER) for c in IJK])
    # Leaves first; the levels above sum up leaves.
    leaf = active.groupBy(*[f"{c}{b}" for b in (UPPER, LOWER, LEAF) for c in IJK]).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.sum("value").alias("total"))
    levels = []
    for level, bits in ((1, LEAF), (2, LOWER), (3, UPPER)):
        keys = [F.shiftleft(f"{c}{bits}", bits).alias(f"n{c}") for c in IJK]
        levels.append(leaf.groupBy(F.lit(level).alias("level"), *keys).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total")))
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def diagnose(g: Grid, low: float, high: float) -> DataFrame:
    """Counts of values that aren't numbers, infinite, equal to the background while active, or out of range."""
    v = F.col("value")
    infinite = F.abs(v) == float("inf")
    return g.df.agg(F.count_if(F.isnan(v)).alias("n_nan"), F.count_if(infinite).alias("n_infinite"), F.count_if(F.col("active") & (v == g.background)).alias("n_background"), F.count_if(F.col("active") & ~F.isnan(v) & ~v.between(low, high)).alias("n_outside"))


def inactive_values(g: Grid, most: int = 100) -> DataFrame:
    """Distinct values of inactive voxels, the smallest ``most`` of them."""
    return g.df.where("not active").select("value").distinct().orderBy("value").limit(most)


def extrema(g: Grid) -> DataFrame:
    """Count, least and most of active values, and the first voxel in order where each stands."""
    at = F.struct(*IJK)
    least, most = F.min(F.struct("value", at.alias("at"))), F.min(F.struct((-F.col("value")).alias("value"), at.alias("at")))
    found = g.on.agg(F.count(F.lit(1)).alias("n"), least.alias("a"), most.alias("b"))
    return found.select("n", F.col("a.value").alias("least"), (-F.col("b.value")).alias("most"), *[F.col(f"{x}.at.{c}").alias(f"{w}_{c}") for x, w in (("a", "least"), ("b", "most")) for c in IJK])


def largest(g: Grid, n: int = 10) -> DataFrame:
    """The n active voxels of largest value; ties by coordinate."""
    return g.on.select(*IJK, "value").orderBy(F.desc("value"), *IJK).limit(n)


def measure(g: Grid, size: float = 1.0) -> DataFrame:
    """Area and volume of a level set by a smoothed Dirac of half-width 1.5 voxels and the divergence theorem."""
    d = gather(g, FACES)
    half = 1.5
    x = F.col("value") / size
    dirac = F.when(F.abs(x) < half, (F.lit(1.0) + F.cos(x * (3.141592653589793 / half))) / (2 * half)).otherwise(0.0)
    grad = [(F.col(name(axis(n))) - F.col(name(axis(n, -1)))) / (2 * size) for n in range(3)]
    length = F.sqrt(grad[0] * grad[0] + grad[1] * grad[1] + grad[2] * grad[2])
    flux = sum((F.col(c) * grad[n] for n, c in enumerate(IJK)), F.lit(0.0))
    return d.agg((F.sum(dirac * length) * size**2).alias("area"), (F.sum(dirac * flux) * (size**3 / 3)).alias("volume"))


def check_level_set(g: Grid, slack: float = 0.25) -> DataFrame:
    """One row of counts of what a level set must not have: values that are no number, active ones at or beyond the
    background, inactive ones off it, and slopes off 1 by more than ``slack`` where all face neighbours are active."""
    v = F.col("value")
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    flat = g.df.agg(F.count_if(bad).alias("n_not_finite"), F.count_if(F.col("active") & (F.abs(v) >= g.background)).alias("n_beyond"), F.count_if(~F.col("active") & (F.abs(v) != g.background)).alias("n_off_background"))
    outside = Grid(g.on, float("nan"))
    steep = F.sqrt(sum(((F.col(name(axis(n))) - F.col(name(axis(n, -1)))) * (F.col(name(axis(n))) - F.col(name(axis(n, -1)))) for n in range(3)), F.lit(0.0))) / 2
    slopes = gather(outside, FACES).agg(F.count_if(~F.isnan(steep) & (F.abs(steep - 1.0) > slack)).alias("n_slope"))
    # One row each.
    return flat.join(F.broadcast(slopes), F.lit(True))


def check_fog(g: Grid) -> DataFrame:
    """One row of counts: values that are no number, outside 0 to 1, and inactive ones that aren't 0."""
    v = F.col("value")
    return g.df.agg(F.count_if(F.isnan(v) | (F.abs(v) == float("inf"))).alias("n_not_finite"), F.count_if((v < 0) | (v > 1)).alias("n_outside"), F.count_if(~F.col("active") & (v != 0)).alias("n_off_background"))
