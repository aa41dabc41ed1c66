"""Bands that move with their surface: volumes and places against closed forms."""

import math
from itertools import product

import numpy as np
from gridloom.model import Grid, grid
from gridloom.operators import band
from pyspark.sql import functions as F


def ball(spark, radius, half=3.0, at=(0.0, 0.0, 0.0), n=None):
    n = n or int(radius + half) + 2
    low, high = [int(x) - n for x in at], [int(x) + n for x in at]
    d = {c: math.dist(c, at) - radius for c in product(*[range(a, b + 1) for a, b in zip(low, high)])}
    return grid(spark.createDataFrame([(*c, v) for c, v in d.items() if abs(v) < half], "i int, j int, k int, value double"), half)


def rows(g):
    return {(r.i, r.j, r.k): r.value for r in g.df.collect()}


def volume(values, half):
    """Voxels inside, with a linear share of those that the surface crosses; lines are filled between a band's sides."""
    lines = {}
    for (i, j, k), v in values.items():
        lines.setdefault((i, j), []).append((k, v))
    total = 0.0
    for line in lines.values():
        line.sort()
        for (k, v), (m, w) in zip(line, line[1:]):
            if v < 0 and w < 0:
                total += m - k
            elif v < 0 or w < 0:
                total += (min(v, w) / (min(v, w) - max(v, w))) if m == k + 1 else 0
    return total


def test_a_ball_that_is_carried_keeps_its_volume(spark):
    g = ball(spark, 6.0)
    before = volume(rows(g), 3.0)
    assert abs(before / (4 / 3 * math.pi * 216) - 1) < 0.02
    speed = (3.0, -1.0, 0.5)
    moved, steps = band.advected(g, lambda x, y, z, t: tuple(F.lit(s) for s in speed), 0.0, 1.0, 2, "weno5", count=1)
    got = rows(moved)
    assert steps == math.ceil(math.sqrt(10.25) / band.CFL[2])
    assert abs(volume(got, 3.0) / before - 1) < 0.02
    off = [abs(v - (math.dist(c, speed) - 6)) for c, v in got.items()]
    assert max(abs(v) for v in got.values()) < 3 and np.mean(off) < 0.05
    # All of the band around the new place is there.
    want = {c for c in product(*[range(int(x) - 11, int(x) + 12) for x in speed]) if abs(math.dist(c, speed) - 6) < 2.5}
    assert want <= set(got)


def test_resizing(spark):
    g = ball(spark, 8.0, 2.0)
    wide = band.resized(g, 4.0)
    got = rows(wide)
    assert wide.background == 4.0 and all(got[c] == v for c, v in rows(g).items())
    want = {c: math.dist(c, (0, 0, 0)) - 8 for c in product(range(-13, 14), repeat=3)}
    assert {c for c, v in want.items() if abs(v) < 3.2} <= set(got)
    assert max(abs(v - want[c]) for c, v in got.items()) < 0.9 and np.mean([abs(v - want[c]) for c, v in got.items()]) < 0.15
    narrow = band.resized(wide, 1.5)
    assert narrow.background == 1.5 and set(rows(narrow)) == {c for c, v in got.items() if abs(v) < 1.5}


def test_tracking_mends_slopes_and_leaves_the_surface(spark):
    g = ball(spark, 8.0, 3.0)
    steep = Grid(g.map(F.col("value") * 2).df.where("abs(value) < 3"), 3.0)
    got = rows(band.tracked(band.tracked(steep, 4, "first"), 4, "first"))
    off = {c: abs(v - (math.dist(c, (0, 0, 0)) - 8)) for c, v in got.items()}
    before = np.mean([abs(v - (math.dist(c, (0, 0, 0)) - 8)) for c, v in rows(steep).items()])
    assert np.mean(list(off.values())) < before / 2 and max(v for c, v in off.items() if abs(math.dist(c, (0, 0, 0)) - 8) < 0.5) < 0.25
    assert band.advected(Grid(g.df.where("false"), 3.0), lambda x, y, z, t: (x, y, z), 0, 1)[0].df.count() == 0


def test_morphing_goes_towards_the_target(spark):
    target = ball(spark, 6.0, 6.0, (1.0, 0.0, 0.0), 13)
    got, steps = band.morphed(ball(spark, 5.0, 3.0), target, 0.0, 0.15, 1, "first", 1, "first")
    off = lambda values: np.mean([abs(math.dist(c, (1, 0, 0)) - 6 - v) for c, v in values.items() if abs(v) < 1.5])
    assert steps >= 3 and off(rows(got)) < 0.97 * off(rows(ball(spark, 5.0, 3.0)))


def test_weights_of_a_smooth_line():
    """On a cubic the fifth-order differences are exact to rounding, up to the smoothness weights."""
    f = lambda x: 0.01 * x**3 - 0.1 * x * x + x
    import duckdb

    con = duckdb.connect()
    for side in (-1, 1):
        columns = {band.at(0, s): f(2 + s) for s in range(-3, 4)}
        text = "select " + ", ".join(f"{v}::double as {k}" for k, v in columns.items())
        for stage in band._weighed("d", band._differences(0, side, "weno5")):
            text = "select *, " + ", ".join(f"{e} as {k}" for k, e in stage.items()) + f" from ({text})"
        assert abs(con.execute(f"select d from ({text})").fetchone()[0] - (0.03 * 4 - 0.2 * 2 + 1)) < 1e-3
