"""Pieces next to cuts made one by one in numpy."""

import numpy as np
import pytest

from gridloom.model import Grid
from gridloom.operators import fracture

HALF = 3.0
N = np.arange(-13, 14)
AT = np.stack(np.meshgrid(N, N, N, indexing="ij"), -1).reshape(-1, 3)


def ball(centre, radius):
    return np.linalg.norm(AT - np.array(centre), axis=1) - radius


def one_by_one(solid, radius, places, overlap):
    whole = lambda v: (v < HALF).sum() >= 27 and v.min() < 0
    fragments, rests = {}, {"a": solid}
    for n, p in enumerate(places):
        by, new = ball(p, radius), {}
        for group in ([fragments] if overlap else []) + [rests]:
            for name in list(group):
                inner, outer = np.maximum(group[name], by), np.maximum(group[name], -by)
                if whole(inner) and whole(outer):
                    new[f"{name}/{n}"], group[name] = inner, outer
        fragments |= new
    return fragments | rests


def frame(spark, values, extra=""):
    rows = [(*map(int, x), float(v)) for x, v in zip(AT, values) if v < HALF]
    return spark.createDataFrame(rows, "i int, j int, k int, value double")


@pytest.mark.parametrize("overlap", [True, False])
def test_pieces_are_those_of_cuts_one_by_one(spark, overlap):
    solid = np.minimum(ball((-5, 0, 0), 6.2), ball((7, 1, 0), 4.6))
    places = [(-8, 0, 0), (8, 0, 0), (-4, 2, 1), (0, 11, 0), (7, 1, 0), (-5, -3, 0)]
    cutter = Grid(frame(spark, ball((0, 0, 0), 4.3)).selectExpr("*", "true as active"), HALF)
    found: dict = {}
    for x in fracture.fractured(frame(spark, solid).selectExpr("'a' as piece", "*"), cutter, places, HALF, overlap=overlap).collect():
        found.setdefault(x["piece"], {})[x["i"], x["j"], x["k"]] = x["value"]
    wanted = one_by_one(solid, 4.3, places, overlap)
    assert set(found) == set(wanted) and len(found) > 4
    for name, v in wanted.items():
        rows = {tuple(map(int, x)): w for x, w in zip(AT, v) if w < HALF}
        assert set(rows) == set(found[name])
        assert all(abs(found[name][x] - w) < 1e-9 for x, w in rows.items())
    insides = sum(v < 0 for p in found.values() for v in p.values())
    assert insides == (solid < 0).sum()  # no voxel lies exactly on a cut


def test_rounds_keep_the_order_of_copies_that_meet():
    box = lambda x: ((x, 0, 0), (x + 4, 4, 4))
    assert fracture.rounds([box(0), box(10), box(3), box(6), box(20)]) == [[0, 1, 4], [2], [3]]
    assert fracture.rounds([]) == []


def test_turned_cutters_parts_and_empty_tables(spark):
    solid = frame(spark, ball((0, 0, 0), 7.2)).selectExpr("'a' as piece", "*")
    slab = np.abs(AT[:, 2] + 0.25) - 2.0  # cuts in two
    cutter = Grid(frame(spark, slab).selectExpr("*", "true as active"), HALF)
    upright = fracture.fractured(solid, cutter, [(0.0, 0.0, 0.0)], HALF, turns=[[[0, 0, 1], [0, 1, 0], [-1, 0, 0]]])
    parts = fracture.parted(upright).select("piece", "si", "sj", "sk", "n").distinct().collect()
    assert sorted(x["piece"] for x in parts) == ["a", "a", "a/0"]
    assert sum(x["n"] for x in parts) == (ball((0, 0, 0), 7.2) < 0).sum()
    for x in upright.where("piece = 'a/0' and value < 0").select("i").distinct().collect():
        assert abs(x["i"]) <= 2
    assert fracture.fractured(solid.limit(0), cutter, [(0, 0, 0)], HALF).count() == 0
    assert fracture.fractured(solid, Grid(cutter.df.limit(0), HALF), [(0, 0, 0)], HALF).count() == solid.count()
