"""Dense arrays in chunks next to numpy's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.model import Grid
from gridloom.operators import dense

LOW, HIGH, SIDE = (-4, -8, 0), (7, 3, 3), 4


@pytest.fixture(scope="module")
def world(spark):
    draw = np.random.default_rng(8)
    a = np.full([h - l + 1 for l, h in zip(LOW, HIGH)], 2.0)
    at = np.argwhere(draw.random(a.shape) < 0.3)
    rows = []
    for x in at:
        a[tuple(x)] = draw.integers(-50, 50) / 4
        rows.append((*map(int, x + LOW), float(a[tuple(x)]), bool(draw.random() < 0.5)))
    g = Grid(spark.createDataFrame(rows, "i int, j int, k int, value double, active boolean"), 2.0)
    return a, g, dense.dense(g, (LOW, HIGH), SIDE)


def whole(rows):
    g = dense.extracted(rows, lambda v: F.lit(True), side=SIDE)
    out = np.full([h - l + 1 for l, h in zip(LOW, HIGH)], np.nan)
    for x in g.df.collect():
        out[tuple(np.subtract((x["i"], x["j"], x["k"]), LOW))] = x["value"]
    return out


def test_round_trip_and_box(world):
    a, _, rows = world
    assert np.array_equal(whole(rows), a)
    got = whole(dense.transformed(rows, ((-1, -3, 1), (2, 0, 2)), lambda v: v * 3, SIDE))
    want = a.copy()
    want[3:7, 5:9, 1:3] *= 3
    assert np.array_equal(got, want)


def test_masked_and_by_condition(spark, world):
    a, g, rows = world
    outside = spark.createDataFrame([(99, 0, 0, 1.0, True)], g.df.schema)
    found = dense.extracted_with_mask(rows, Grid(g.df.unionByName(outside), 0.0), side=SIDE).df.collect()
    assert sorted((x["i"], x["j"], x["k"], x["value"]) for x in found) == sorted((x["i"], x["j"], x["k"], x["value"]) for x in g.on.collect())
    assert dense.extracted(rows, lambda v: v > 5, lambda v: v * 2, side=SIDE).df.agg(F.sum("value")).first()[0] == 2 * a[a > 5].sum()


@pytest.mark.parametrize("how", list(dense.WAYS))
def test_composites(spark, world, how):
    a, g, rows = world
    draw = np.random.default_rng(9)
    source = [(int(i), int(j), int(k), float(draw.integers(0, 9))) for i in range(-6, 8) for j in range(-8, 4) for k in range(4) if draw.random() < 0.5]
    alpha = [(int(i), int(j), int(k), float(draw.integers(0, 5)) / 4, bool(draw.random() < 0.7)) for i in range(-6, 8) for j in range(-8, 4) for k in range(4) if draw.random() < 0.5]
    s = Grid(spark.createDataFrame(source, "i int, j int, k int, value double").selectExpr("*", "true as active"), 1.0)
    o = Grid(spark.createDataFrame(alpha, "i int, j int, k int, value double, active boolean"), 0.0)
    got = whole(dense.composited(rows, s, o, how, 1.5, 0.5, SIDE))
    seen = {x[:3]: x[3] for x in source}
    want = a.copy()
    for i, j, k, w, on in alpha:
        x = tuple(np.subtract((i, j, k), LOW))
        if on and min(x) >= 0:
            u, v, w = a[x], 1.5 * seen.get((i, j, k), 1.0), 0.5 * w
            want[x] = {"over": u + w * (v - u), "add": u + w * v, "sub": u - w * v, "min": (1 - w) * u + w * min(u, v), "max": (1 - w) * u + w * max(u, v), "mult": (1 + w * (v - 1)) * u}[how]
    assert np.allclose(got, want, atol=1e-12)
