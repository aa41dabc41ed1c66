"""Solvers and searches against brute force, and meshes' properties."""

import numpy as np
from gridloom.model import Grid, grid
from gridloom.operators import levelset, points, surface
from pyspark.sql import functions as F


def test_poisson_against_a_dense_solution(spark):
    rng = np.random.default_rng(1)
    at = sorted({tuple(int(x) for x in rng.integers(0, 5, 3)) for _ in range(70)})
    right = rng.normal(0, 1, len(at))
    g = grid(spark.createDataFrame([(*c, float(v)) for c, v in zip(at, right)], "i int, j int, k int, value double"))
    number = {c: n for n, c in enumerate(at)}
    m = np.zeros((len(at), len(at)))
    for c, n in number.items():
        m[n, n] = -6
        for axis in range(3):
            for step in (-1, 1):
                other = tuple(x + step * (a == axis) for a, x in enumerate(c))
                if other in number:
                    m[n, number[other]] = 1
    want = np.linalg.solve(m, right)
    got = {(r.i, r.j, r.k): r.value for r in levelset.poisson_solved(g, 1e-8).df.collect()}
    assert len(got) == len(at) and max(abs(got[c] - want[n]) for c, n in number.items()) < 1e-5
    assert levelset.poisson_solved(Grid(g.df.where("false"))).df.count() == 0


def test_nearest_others_however_far(spark):
    rng = np.random.default_rng(2)
    xyz = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(400, 1, (3, 3)), [[9_000, 0, 0]]])
    df = spark.createDataFrame([(n, *map(float, p)) for n, p in enumerate(xyz)], "id long, px double, py double, pz double")
    got = {}
    for r in points.nearest_others(df, df.where("id % 3 = 0"), 4, 0.5).collect():
        got.setdefault(r.id, {})[r.place] = r.other
    for n in range(0, 64, 3):
        away = np.linalg.norm(xyz - xyz[n], axis=1)
        want = [int(m) for m in np.lexsort((np.arange(64), away)) if m != n][:4]
        assert [got[n][p] for p in (1, 2, 3, 4)] == want
    assert points.nearest_others(df.where("id = 1"), df.where("id = 1"), 2).count() == 0


def test_mesh_of_a_ball_is_closed(spark):
    g = levelset.sphere(spark, 16, (7.3, 7.6, 7.1), 4.2)
    corners = {(r.i, r.j, r.k): (r.x, r.y, r.z) for r in surface.vertices(g).collect()}
    assert all(abs(np.linalg.norm(np.array(p) - (7.3, 7.6, 7.1)) - 4.2) < 0.3 for p in corners.values())
    edges, n = {}, 0
    for q in surface.quads(g).collect():
        n += 1
        u, v = (np.eye(3, dtype=int)[a] for a in range(3) if a != q.axis)
        ring = [tuple(int(x) for x in np.array([q.i, q.j, q.k]) - a * u - b * v) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]
        assert all(c in corners for c in ring)
        for a, b in zip(ring, ring[1:] + ring[:1]):
            edges[frozenset((a, b))] = edges.get(frozenset((a, b)), 0) + 1
    assert set(edges.values()) == {2} and len(corners) - len(edges) + n == 2


def test_distances_to_a_triangle(spark):
    t = spark.createDataFrame([(0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.0, 4.0, 0.0)], "ax double, ay double, az double, ex double, ey double, ez double, cx double, cy double, cz double")
    got = {(r.i, r.j, r.k): r.value for r in surface.mesh_distance(t, 2.5).df.collect()}
    for place, want in {(1, 1, 2): 2.0, (-1, 0, 0): 1.0, (-1, -1, 1): 3**0.5, (3, 3, 0): 2**0.5, (2, 2, 0): 0.0, (5, 0, 1): 2**0.5}.items():
        assert abs(got[place] - want) < 1e-9
    assert surface.mesh_distance(t.where(F.lit(False))).df.count() == 0


def test_only_written_grids_are_deleted(spark, tmp_path):
    from gridloom.operators.tree import _forget, _written

    spark.range(3).write.parquet(f"{tmp_path}/grid-1/grid-2")
    theirs = spark.read.parquet(f"{tmp_path}/grid-1/grid-2")
    own = _written(spark.range(4))
    _forget(theirs)
    _forget(theirs.union(own))
    assert theirs.count() == 3 and not spark._jvm.java.io.File(own.inputFiles()[0].removeprefix("file:")).exists()
