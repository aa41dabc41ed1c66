"""Meshes: fewer polygons, closed, near the surface; and level sets made anew from their faces."""

import math
from collections import Counter
from itertools import product

import pytest
from gridloom.model import grid
from gridloom.operators import meshing, surface


def made(spark, distance, n, half):
    d = {c: distance(*c) for c in product(range(-n, n + 1), repeat=3)}
    return grid(spark.createDataFrame([(*c, float(v)) for c, v in d.items() if abs(v) < half], "i int, j int, k int, value double"), half)


def ball(x, y, z):
    return math.sqrt(x * x + y * y + z * z) - 9.3


def box(x, y, z):
    out = [max(abs(v) - 8.4, 0) for v in (x, y, z)]
    return math.sqrt(sum(v * v for v in out)) + min(max(abs(x) - 8.4, abs(y) - 8.4, abs(z) - 8.4), 0)


@pytest.mark.parametrize("shape,tolerance,share", [(ball, 0.15, 0.8), (box, 0.05, 0.35)])
def test_adaptive_polygons(spark, shape, tolerance, share):
    g = made(spark, shape, 13, 3.0)
    points, polygons = meshing.adaptive(g, 0.0, tolerance)
    at = {(r.level, r.ni, r.nj, r.nk): (r.x, r.y, r.z) for r in points.collect()}
    faces = [[tuple(c) for c in r.corners] for r in polygons.collect()]
    assert {c for f in faces for c in f} <= set(at)
    assert len(faces) < share * surface.quads(g).count() and max(k[0] for k in at) >= 1
    # Closed: each edge belongs to an even number of polygons, and they run along it in both directions alike.
    edges, runs = Counter(), Counter()
    for f in faces:
        for a, b in zip(f, f[1:] + f[:1]):
            edges[frozenset((a, b))] += 1
            runs[(a, b)] += 1
    assert all(n % 2 == 0 for n in edges.values()) and all(runs[b, a] == n for (a, b), n in runs.items())
    # Within the tolerance, and what the cells' own vertices are off by.
    own = max(abs(shape(r.x, r.y, r.z)) for r in surface.vertices(g).collect())
    assert max(abs(shape(*p)) for p in at.values()) <= tolerance + own + 0.05
    # The volume inside, from the faces as seen from outside.
    total = 0.0
    for f in faces:
        p = [at[c] for c in f]
        for b, c in zip(p[1:], p[2:]):
            a = p[0]
            total += (a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])) / 6
    want = 4 / 3 * math.pi * 9.3**3 if shape is ball else 16.8**3
    assert abs(total / want - 1) < 0.04  # edges and corners are cut


def test_no_tolerance_merges_nothing_that_is_bent(spark):
    g = made(spark, ball, 12, 2.0)
    points, polygons = meshing.adaptive(g, 0.0, 0.0)
    assert polygons.count() == surface.quads(g).count() and points.count() == surface.vertices(g).count()


def test_rebuilt_by_faces(spark):
    g = made(spark, ball, 14, 2.5)
    steep = g.map(g.df["value"] * 1.7)
    got = {(r.i, r.j, r.k): r.value for r in surface.rebuilt(steep, half=3.0).df.collect()}
    assert max(abs(v - ball(*c)) for c, v in got.items()) < 0.12
    assert {c for c in product(range(-13, 14), repeat=3) if abs(ball(*c)) < 2.8} <= set(got)
