"""Spheres in solids next to a choice one by one, and closest places next to a plain search."""

import math
import random

import numpy as np
import pytest

from gridloom.model import Grid
from gridloom.operators import packing


def one_by_one(rows, most=None, floor=1.0, overlapping=False):
    at = np.array([r[:3] for r in rows], dtype=float)
    r = np.array([x[3] for x in rows], dtype=float)
    order = np.lexsort((at[:, 2], at[:, 1], at[:, 0]))
    at, r, out = at[order], r[order].copy(), []
    while (r >= floor).any() and (most is None or len(out) < most):
        n = int(np.argmax(r))
        out.append((*map(int, at[n]), r[n]))
        room = np.sqrt(((at - at[n]) ** 2).sum(axis=1)) - r[n]
        r = np.where(room < 0, -1.0, r) if overlapping else np.minimum(r, room)
    return out


@pytest.fixture(scope="module")
def cloud():
    draw = np.random.default_rng(5)
    at = np.unique(draw.integers(-14, 15, (3000, 3)), axis=0)
    r = np.round(draw.gamma(1.2, 1.1, len(at)), 1)  # many ties
    return [(*map(int, a), float(x)) for a, x in zip(at, r)]


@pytest.mark.parametrize("overlapping", [False, True])
@pytest.mark.parametrize("most", [None, 7])
def test_the_spheres_are_those_of_a_choice_one_by_one(spark, cloud, overlapping, most):
    df = spark.createDataFrame(cloud, "i int, j int, k int, r double")
    ours = [tuple(x) for x in packing.packed(df, most=most, overlapping=overlapping).collect()]
    assert sorted(ours) == sorted(one_by_one(cloud, most, 1.0, overlapping))


def test_spheres_fill_a_ball_without_overlap(spark):
    n = range(-9, 10)
    rows = [(i, j, k, float(np.sqrt(i * i + j * j + k * k) - 7.3)) for i in n for j in n for k in n]
    g = Grid(spark.createDataFrame(rows, "i int, j int, k int, value double").selectExpr("*", "true as active"), 3.0)
    found = sorted((tuple(x) for x in packing.filled(g).collect()), key=lambda x: -x[3])
    assert found[0][:3] == (0, 0, 0) and abs(found[0][3] - 7.3) < 0.2
    for a in range(len(found)):
        assert found[a][3] >= 1.0
        for b in range(a):
            assert np.linalg.norm(np.subtract(found[a][:3], found[b][:3])) >= found[a][3] + found[b][3] - 1e-9


def test_bounds(spark):
    rows = [(0, 0, 0, 5.0), (20, 0, 0, 0.5), (40, 0, 0, 0.25), (60, 0, 0, None), (80, 0, 0, -1.0)]
    df = spark.createDataFrame(rows, "i int, j int, k int, r double")
    assert packing.packed(df).count() == 1
    assert sorted(x["i"] for x in packing.packed(df, least=2).collect()) == [0, 20]
    assert packing.packed(df, least=9).count() == 3
    assert packing.packed(df, max_radius=2.0).first()["r"] == 2.0
    assert packing.packed(df.limit(0)).count() == 0
    assert packing.packed(df.where("r < 0")).count() == 0


def test_closest_places(spark):
    draw = np.random.default_rng(6)
    places, points = draw.normal(0, 30, (200, 3)), draw.normal(0, 90, (300, 3))
    p = spark.createDataFrame([(n, *map(float, x)) for n, x in enumerate(points)], "id int, px double, py double, pz double")
    s = spark.createDataFrame([tuple(map(float, x)) for x in places], "x double, y double, z double")
    found = {x["id"]: x for x in packing.closest_surface(s, p).collect()}
    for n, x in enumerate(points):
        away = np.linalg.norm(places - x, axis=1)
        assert abs(found[n]["distance"] - away.min()) < 1e-9
        assert np.allclose([found[n][a] for a in "xyz"], places[away.argmin()])
    assert packing.closest_surface(s.limit(0), p).count() == 0
    assert packing.closest_surface(s, p.limit(0)).count() == 0


def test_closest_surface_in_tiles(spark):
    """More points and places in one bucket than a chunk holds, places far away, ties, and coordinates that are none."""
    random.seed(5)
    at = [(random.random() * 6, random.random() * 6, random.random() * 6) for _ in range(1500)] + [(90.0, 1.0, 1.0), (3.0, 3.0, 3.0)]
    places = [(round(random.random() * 40, 1), 30.0, round(random.random() * 7, 1)) for _ in range(1300)] + [(4.0, 3.0, 3.0), (2.0, 3.0, 3.0)]
    points = spark.createDataFrame([(n, *p) for n, p in enumerate(at)] + [(-1, float("nan"), 0.0, 0.0), (-2, None, 0.0, 0.0), (-3, float("inf"), 0.0, 0.0)], "id long, px double, py double, pz double")
    surface = spark.createDataFrame([*places, (float("nan"), 0.0, 0.0)], "x double, y double, z double")
    found = {x["id"]: tuple(x)[1:] for x in packing.closest_surface(surface, points).collect()}
    assert set(found) == set(range(len(at)))
    for n, p in enumerate(at):
        distance, place = min((math.dist(p, q), q) for q in places)
        assert math.isclose(found[n][0], distance) and math.isclose(math.dist(p, found[n][1:]), distance)
    assert found[len(at) - 1] == (1.0, 2.0, 3.0, 3.0)


def test_tables_of_a_round_are_shuffled(spark, cloud, monkeypatch):
    """No plan sends a table to all tasks by way of the driver, and a large bucket is shared out."""
    plans, written = [], packing._written
    monkeypatch.setattr(packing, "_written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df))
    rows = [*cloud[::12], (3, 2, 1, 70.0), (90, 2, 1, 40.0)]
    df = spark.createDataFrame(rows, "i int, j int, k int, r double")
    for overlapping in (False, True):
        ours = [tuple(x) for x in packing.packed(df, overlapping=overlapping).collect()]
        assert sorted(ours) == sorted(one_by_one(rows, overlapping=overlapping))
    points = df.selectExpr("struct(i, j, k) as id", "cast(i as double) as px", "cast(j as double) as py", "cast(k as double) as pz")
    far = spark.createDataFrame([(0.0, 0.0, 0.0), (900.0, 0.0, 0.0)], "x double, y double, z double")
    assert packing.closest_surface(far, points).count() == len(rows)
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
