"""Dense arrays in chunks, next to sparse grids.

A dense array is rows (ni, nj, nk, values), one for each cubic chunk of ``side`` voxels a side at its origin; values are in
order of i, then j, then k. Sparse voxels meet a chunk as one row that holds at most all its places, so no array is
copied for each voxel, and what only changes values needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.model import IJK, Grid

CHUNK = [f"n{c}" for c in IJK]
Box = tuple[tuple[int, int, int], tuple[int, int, int]]


def _chunked(df: DataFrame, side: int, *columns: str) -> DataFrame:
    """(ni, nj, nk, held): voxels' columns by their place in their chunk."""
    origin = [(F.floor(F.col(c) / side) * side).cast("int").alias(n) for c, n in zip(IJK, CHUNK)]
    rows = df.select(*origin, *IJK, *columns)
    at = ((F.col("i") - F.col("ni")) * side + F.col("j") - F.col("nj")) * side + F.col("k") - F.col("nk")
    return rows.groupBy(*CHUNK).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("at"), F.struct(*columns).alias("row")))).alias("held"))


def dense(g: Grid, box: Box, side: int = 8) -> DataFrame:
    """A grid as a dense array of all chunks that meet a box; inactive voxels keep their values, missing ones are the background."""
    low, high = box
    chunks = g.df.sparkSession.range(low[0] // side, high[0] // side + 1).select((F.col("id") * side).cast("int").alias("ni"))
    for n, c in ((1, "nj"), (2, "nk")):
        ends = F.sequence(F.lit(low[n] // side), F.lit(high[n] // side))
        chunks = chunks.withColumn(c, F.explode(F.transform(ends, lambda x: (x * side).cast("int"))))
    met = chunks.join(_chunked(g.df, side, "value"), CHUNK, "left")
    value = lambda n: F.coalesce(F.try_element_at("held", n)["value"], F.lit(float(g.background)))
    return met.select(*CHUNK, F.transform(F.sequence(F.lit(0), F.lit(side**3 - 1)), value).alias("values"))


def _place(at: Column, side: int) -> list[Column]:
    return [(F.col("ni") + F.floor(at / (side * side))).cast("int"), (F.col("nj") + F.floor(at / side) % side).cast("int"), (F.col("nk") + at % side).cast("int")]


def extracted(rows: DataFrame, where: Callable[[Column], Column], value: Callable[[Column], Column] = lambda v: v, background: float = 0.0, side: int = 8) -> Grid:
    """The sparse grid of the values of a dense array that meet a condition, or of a function of them."""
    cells = rows.select(*CHUNK, F.posexplode("values").alias("at", "v")).where(where(F.col("v")))
    return Grid(cells.select(*[p.alias(c) for p, c in zip(_place(F.col("at"), side), IJK)], value(F.col("v")).alias("value"), F.lit(True).alias("active")), background)


def extracted_with_mask(rows: DataFrame, mask: Grid, background: float = 0.0, side: int = 8) -> Grid:
    """The sparse grid of a dense array's values at active voxels of a mask; those outside the array give none."""
    met = rows.join(_chunked(mask.on, side, "active"), CHUNK)
    cells = met.select(*CHUNK, F.explode(F.transform(F.map_keys("held"), lambda n: F.struct(n.alias("at"), F.get("values", n).alias("value")))).alias("c"))
    return Grid(cells.select(*[p.alias(c) for p, c in zip(_place(F.col("c.at"), side), IJK)], F.col("c.value").alias("value"), F.lit(True).alias("active")), background)


def transformed(rows: DataFrame, box: Box, value: Callable[[Column], Column], side: int = 8) -> DataFrame:
    """A dense array with a function of its values in a box, ends included."""

    def one(v: Column, n: Column) -> Column:
        inside = F.lit(True)
        for p, low, high in zip(_place(n, side), *box):
            inside = inside & (p >= low) & (p <= high)
        return F.when(inside, value(v)).otherwise(v)

    return rows.select(*CHUNK, F.transform("values", one).alias("values"))


#: New value from the array's u, alpha times strength a, and the source's v, scaled.
WAYS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "over": lambda u, a, v: u + a * (v - u),
    "add": lambda u, a, v: u + a * v,
    "sub": lambda u, a, v: u - a * v,
    "min": lambda u, a, v: (F.lit(1.0) - a) * u + a * F.least(u, v),
    "max": lambda u, a, v: (F.lit(1.0) - a) * u + a * F.greatest(u, v),
    "mult": lambda u, a, v: (a * (v - 1.0) + 1.0) * u,
}


def composited(rows: DataFrame, source: Grid, alpha: Grid, how: str, beta: float = 1.0, strength: float = 1.0, side: int = 8) -> DataFrame:
    """A dense array under a sparse source, by an opacity grid: values change where alpha is active.

    ``strength`` scales alpha and ``beta`` the source, whose missing voxels are its background. ``max`` takes the larger value.
    """
    seen = source.df.select(*IJK, F.col("value").alias("v"))
    both = alpha.on.select(*IJK, F.col("value").alias("a")).join(seen, list(IJK), "left").withColumn("v", F.coalesce("v", F.lit(float(source.background))))
    met = rows.join(_chunked(both, side, "a", "v"), CHUNK, "left")

    def one(u: Column, n: Column) -> Column:
        row = F.try_element_at("held", n)
        return F.coalesce(WAYS[how](u, row["a"] * strength, row["v"] * beta), u)

    return met.select(*CHUNK, F.transform("values", one).alias("values"))
