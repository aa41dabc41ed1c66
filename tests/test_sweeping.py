"""Distances by the Eikonal equation against brute force and closed forms."""

import math
from itertools import product

import numpy as np
from gridloom.model import Grid, grid
from gridloom.operators import sweeping
from pyspark.sql import functions as F

AROUND = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def made(spark, values, background=0.0):
    return grid(spark.createDataFrame([(*c, float(v)) for c, v in values.items()], "i int, j int, k int, value double"), background)


def rows(g):
    return {(r.i, r.j, r.k): r.value for r in g.df.collect()}


def update(known, c):
    """The quadratic of one voxel, by trying one, two and three axes."""
    least = sorted(min(known.get(tuple(x + s * (m == n) for m, x in enumerate(c)), math.inf) for s in (-1, 1)) for n in range(3))
    best = math.inf
    for many in (1, 2, 3):
        a = least[:many]
        if a[-1] == math.inf:
            break
        p, q = sum(a), sum(x * x for x in a) - 1
        if p * p - many * q < 0:
            break
        t = (p + math.sqrt(p * p - many * q)) / many
        if t < a[-1]:
            break
        best = t
    return best


def by_hand(fixed, free):
    """Gauss-Seidel until nothing changes."""
    known = dict(fixed)
    while True:
        changed = False
        for c in free:
            t = update(known, c)
            if t < known.get(c, math.inf) - 1e-13:
                known[c], changed = t, True
        if not changed:
            return known


def sphere(n, r, half, at=(0.0, 0.0, 0.0), scale=1.0):
    d = {c: (math.dist(c, at) - r) * scale for c in product(range(-n, n + 1), repeat=3)}
    return {c: v for c, v in d.items() if abs(v) < half * scale}


def test_same_as_brute_force_over_blocks(spark):
    rng = np.random.default_rng(1)
    domain = [c for c in product(range(-20, 21), range(-3, 18), range(-2, 3)) if rng.random() < 0.8]
    values = {c: 1.0 for c in domain}
    for c in [(-18, 0, 0), (17, 16, 2), (3, -3, 2)]:
        values[c] = -1.0
    got = rows(sweeping.sdf_to_sdf(made(spark, values, 1.0)))
    sign = {c: values[c] for c in domain if c in values} | {c: v for c, v in values.items() if v < 0}
    fixed = {}
    for c, v in sign.items():
        across = [tuple(x + y for x, y in zip(c, o)) for o in AROUND]
        total = sum(4.0 for n in range(0, 6, 2) if any((sign.get(a, v) < 0) != (v < 0) for a in across[n : n + 2]))
        if total:
            fixed[c] = 1 / math.sqrt(total)
    want = by_hand(fixed, [c for c in sign if c not in fixed])
    far = max(want[c] for c in want if sign[c] > 0)
    assert set(got) == set(sign)
    for c, v in got.items():
        assert abs(v - sign[c] * want.get(c, far)) < 1e-9, c


def test_slope_is_one_off_the_medial_axis(spark):
    """A solid ball and its surroundings, from values that are right at the surface only."""
    values = {c: v * (1 + abs(v)) for c, v in sphere(16, 10.3, 6).items()}
    got = rows(sweeping.sdf_to_sdf(made(spark, values, 6.0)))
    off = [abs(v - (math.dist(c, (0, 0, 0)) - 10.3)) for c, v in got.items()]
    assert max(off) < 0.5 and np.mean(off) < 0.2  # the scheme is of first order
    slopes = []
    for c, v in got.items():
        # One-sided differences from the side that the distance came from.
        back = [max([0.0, *(abs(v) - abs(got[o]) for o in [tuple(x + s * (m == n) for m, x in enumerate(c)) for s in (-1, 1)] if o in got)]) for n in range(3)]
        if abs(v) > 1 and all(tuple(x + y for x, y in zip(c, o)) in got for o in AROUND):
            slopes.append(math.sqrt(sum(b * b for b in back)))
    assert len(slopes) > 5000 and max(abs(s - 1) for s in slopes) < 0.02


def test_fog(spark):
    inside = {c: min(1.0, -v / 3) for c, v in sphere(12, 9.0, 9.5).items() if v < 0}
    got = rows(sweeping.fog_to_sdf(made(spark, inside), 0.5))
    assert set(got) == set(inside)
    assert all((v < 0) == (inside[c] > 0.5) or abs(v) < 1e-9 for c, v in got.items())
    assert max(abs(v - (math.dist(c, (0, 0, 0)) - 7.5)) for c, v in got.items() if inside[c] < 1) < 0.6
    assert sweeping.fog_to_sdf(Grid(made(spark, inside).df.where("false")), 0.5).df.count() == 0
    # Without a surface all is infinite, by the side it is on.
    assert set(rows(sweeping.fog_to_sdf(made(spark, dict.fromkeys(inside, 0.9), 0.9), 0.5)).values()) == {-math.inf}


def test_dilation_keeps_the_band_and_widens_it(spark):
    band = sphere(20, 9.4, 2)
    g = made(spark, band, 2.0)
    wide = sweeping.dilated(g, 4, 26)
    got = rows(wide)
    assert wide.background == 6.0 and all(got[c] == v for c, v in band.items())
    assert {c for c in product(range(-13, 14), repeat=3) if abs(math.dist(c, (0, 0, 0)) - 9.4) < 5} <= set(got)
    assert max(abs(v - (math.dist(c, (0, 0, 0)) - 9.4)) for c, v in got.items()) < 0.65
    out, into = rows(sweeping.dilated(g, 3, 6, 1)), rows(sweeping.dilated(g, 3, 6, -1))
    assert min(out.values()) == min(into.get(c, v) for c, v in band.items()) and max(into.values()) == max(band.values())
    both = rows(sweeping.dilated(g, 3, 6))
    assert set(out) | set(into) == set(both) and set(out) & set(into) == set(band)


def test_mask(spark):
    band = sphere(12, 8.0, 1.5)
    box = {c: 1.0 for c in product(range(0, 12), repeat=3)}
    got = rows(sweeping.masked(made(spark, band, 1.5), made(spark, box)))
    assert set(got) == set(band) | set(box)
    assert all((v < 0) == (math.dist(c, (0, 0, 0)) < 8) for c, v in got.items())
    assert got[0, 0, 0] < -7 and abs(got[11, 11, 11] - (math.sqrt(363) - 8)) < 1


def test_carried_fields(spark):
    band = sphere(12, 8.0, 3)
    g = made(spark, band, 3.0)
    sdf, ext = sweeping.extension(g, 0.0, lambda x, y, z: x + y * 2)
    assert rows(sdf).keys() == band.keys()
    for c, v in rows(ext).items():
        here = math.dist(c, (0, 0, 0))
        assert abs(v - (c[0] + 2 * c[1]) * 8 / here) < 1.2  # its value at the nearest point of the ball
    constant = rows(sweeping.extension(g, 0.0, lambda x, y, z: F.lit(7.0))[1])
    assert max(abs(v - 7) for v in constant.values()) < 1e-9
    one = rows(sweeping.extension(g, 0.0, lambda x, y, z: F.lit(7.0), side=1, default=g.map(F.lit(-1.0)))[1])
    assert all(abs(v - (7 if band[c] > 0 else -1)) < 1e-9 for c, v in one.items())
