"""Messages between voxels: their tasks grow with them, and results stay."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.model import Grid
from gridloom.operators import stencil, surface


@pytest.fixture(scope="module")
def spots():
    random.seed(3)
    return {(random.randrange(40), random.randrange(12), random.randrange(12)) for _ in range(500)}


@pytest.fixture
def grid(spark, spots):
    return Grid(spark.createDataFrame([(*s, 1.0, True) for s in spots], "i int, j int, k int, value double, active boolean"))


def moved(at, offsets):
    return {(at[0] + i, at[1] + j, at[2] + k) for i, j, k in offsets}


def rows_of_tasks(df):
    return [x["n"] for x in df.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]


@pytest.mark.parametrize("near", [6, 26])
def test_closing_in_many_tasks(spark, grid, spots, near, monkeypatch):
    monkeypatch.setattr(stencil, "SENT", 1000, raising=False)
    found = stencil.closed(grid, near).df
    around = [(0, 0, 0), *stencil.NEAR[near]]
    grown = set().union(*(moved(s, around) for s in spots))
    assert {tuple(x)[:3]: tuple(x)[3:] for x in found.collect()} == {s: (1.0 if s in spots else 0.0, moved(s, around) <= grown) for s in grown}
    sizes = rows_of_tasks(found)
    assert len(sizes) > 20 and max(sizes) * 8 < sum(sizes)
    opened = {tuple(x)[:3] for x in stencil.opened(Grid(found.where("active")), near).on.collect()}
    kept = {tuple(x)[:3] for x in found.where("active").collect()}
    assert opened == set().union(*(moved(s, around) for s in kept if moved(s, around) <= kept))


def test_level_set_of_a_mask_in_many_tasks(spark, grid, spots, monkeypatch):
    monkeypatch.setattr(stencil, "SENT", 10000, raising=False)
    found = surface.of_mask(grid, 2).df
    ball = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if i * i + j * j + k * k <= 4]
    asked = {}
    for s in set().union(*(moved(s, ball) for s in spots)):
        away = [sum(x * x for x in o) ** 0.5 for o in ball if (tuple(map(sum, zip(s, o))) in spots) != (s in spots)]
        if away:
            asked[s] = 0.5 - min(away) if s in spots else min(away) - 0.5
    assert {tuple(x)[:3]: x["value"] for x in found.collect()} == pytest.approx(asked)
    assert len(rows_of_tasks(found)) > 10


def test_nothing_to_grow(spark, grid):
    empty = Grid(grid.df.limit(0))
    assert stencil.closed(empty).df.count() == stencil.dilate(empty).df.count() == stencil.erode(empty).df.count() == surface.of_mask(empty).df.count() == 0
