"""Open and unoriented triangles to level sets, and what walls enclose, against brute force."""

import math
import random
from itertools import product

import numpy as np
import pyarrow as pa
from gridloom.model import grid
from gridloom.operators import soup, surface

NAMES = ", ".join(f"{p}{a} double" for p in "aec" for a in "xyz")


def ball(radius, at=(0.0, 0.0, 0.0), rows=14):
    """Triangles of a ball, not oriented alike."""
    point = lambda r, c: tuple(x + radius * y for x, y in zip(at, (math.sin(math.pi * r / rows) * math.cos(math.pi * c / rows), math.sin(math.pi * r / rows) * math.sin(math.pi * c / rows), math.cos(math.pi * r / rows))))
    out = []
    for r in range(rows):
        for c in range(2 * rows):
            a, b, d, e = point(r, c), point(r, c + 1), point(r + 1, c), point(r + 1, c + 1)
            out += [(a, d, e), (a, e, b)]
    rng = random.Random(5)
    return [tuple(sum(t if rng.random() < 0.5 else (t[0], t[2], t[1]), ())) for t in out]


def shrunk(t, share):
    """A triangle drawn to its middle, which leaves gaps to its neighbours."""
    middle = [sum(t[n::3]) / 3 for n in range(3)]
    return tuple(m + (v - m) * share for v, m in zip(t, middle * 3))


def values(g):
    return {(r.i, r.j, r.k): r.value for r in g.df.collect()}


def test_a_soup_of_flipped_triangles_with_small_holes(spark):
    radius, at = 6.3, (20.2, -3.1, 0.4)
    triangles = [shrunk(t, 0.8) for t in ball(radius, at)]
    got = values(soup.level_set(spark.createDataFrame(triangles, NAMES)))
    close = [c for c in product(*[range(int(x) - 11, int(x) + 12) for x in at]) if abs(math.dist(c, at) - radius) < 2.6]
    assert set(close) <= set(got)
    # The mesh is up to 0.1 inside the ball, and gaps make distances longer.
    assert all((v < 0) == (math.dist(c, at) < radius - 0.05) for c, v in got.items() if abs(math.dist(c, at) - radius + 0.05) > 0.15)
    assert max(abs(v - (math.dist(c, at) - radius)) for c, v in got.items()) < 0.6


def test_a_shell_is_hollow_and_an_open_cup_is_not(spark):
    both = ball(8.0) + ball(3.5)
    got = values(soup.level_set(spark.createDataFrame(both, NAMES)))
    # What the inner ball holds is shut off from outside as well.
    assert all(v < 0 for c, v in got.items() if math.dist(c, (0, 0, 0)) < 7.7)
    cup = [t for t in ball(8.0) if min(t[2::3]) < 2]
    assert all(v >= 0 for v in values(soup.level_set(spark.createDataFrame(cup, NAMES))).values())
    assert soup.level_set(spark.createDataFrame([], NAMES)).df.count() == 0


def test_a_long_triangle_gives_only_voxels_near_it(spark):
    one = spark.createDataFrame([(0.2, 0.1, 0.3, 700.4, 0.3, 500.2, 3.0, 40.0, 2.0)], NAMES)
    rows = surface._descended(one, 1.0)
    near = surface.mesh_distance(one, 1.0)
    assert near.df.count() > 30_000 and rows.count() < 12 * near.df.count()


def test_distances_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    flat = [tuple(map(float, rng.uniform(-9, 9, 9))) for _ in range(6)] + [(1.0, 1.0, 1.0, 4.0, 4.0, 4.0, 7.0, 7.0, 7.0)]
    df = spark.createDataFrame(flat, NAMES)
    got = {(r.i, r.j, r.k): r.value for r in surface.mesh_distance(df, 2.0).df.collect()}

    def away(p, t):
        a, b, c = (np.array(t[n : n + 3]) for n in (0, 3, 6))
        s, u = np.meshgrid(np.linspace(0, 1, 41), np.linspace(0, 1, 41))
        keep = s + u <= 1 + 1e-9
        points = a + s[keep][:, None] * (b - a) + u[keep][:, None] * (c - a)
        return np.linalg.norm(points - p, axis=1).min()

    some = list(product(range(-11, 12, 2), repeat=3))
    want = {c: min(away(np.array(c), t) for t in flat) for c in some}
    for c in some:
        if want[c] < 1.7:
            assert abs(got[c] - want[c]) < 0.3 and got[c] <= want[c] + 1e-9
        elif want[c] > 2.5:
            assert c not in got


def test_enclosed_regions(spark):
    """A hollow ball has one cavity; a cup has none; brute force by flooding the whole box."""
    d = {c: abs(math.dist(c, (0, 0, 0)) - 8.0) - 2.0 for c in product(range(-13, 14), repeat=3)}
    band = {c: v for c, v in d.items() if abs(v) < 2}
    frame = lambda values: grid(spark.createDataFrame([(*c, float(v)) for c, v in values.items()], "i int, j int, k int, value double"), 2.0)
    got = {(r.i, r.j, r.k) for r in soup.enclosed_region(frame(band)).df.collect()}
    assert got == {c for c, v in band.items() if v >= 0 and math.dist(c, (0, 0, 0)) < 8}
    cup = {c: (1.0 if c[2] > 5 else v) for c, v in band.items()}
    assert soup.enclosed_region(frame(cup)).df.count() == 0


def test_signs_by_flood(spark):
    """Inactive voxels in and around a ball, all stored as positive, and one deep inside without a neighbour."""
    d = {c: math.dist(c, (0, 0, 0)) - 7.0 for c in product(range(-9, 10), repeat=3)}
    rows = [(*c, float(v) if abs(v) < 2 else 3.0, abs(v) < 2) for c, v in d.items() if abs(v) < 4 or c == (0, 0, 0)]
    g = grid(spark.createDataFrame(rows, "i int, j int, k int, value double, active boolean"), 3.0)
    got = {(r.i, r.j, r.k): (r.value, r.active) for r in soup.flooded_signs(g).df.collect()}
    assert got == {(i, j, k): (v if on else math.copysign(3.0, d[i, j, k]), on) for i, j, k, v, on in rows}


def spelt(df):
    """Rows that the explosions of a query's plan have made, once it has run."""
    df.collect()
    waiting, rows = [df._jdf.queryExecution().executedPlan()], 0
    while waiting:
        node = waiting.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            waiting.append(node.plan())
        elif kind == "GenerateExec":
            rows += node.metrics().apply("numOutputRows").value()
        children = node.children()
        waiting += [children.apply(n) for n in range(children.size())]
    return rows


def test_triangles_go_to_tasks_by_nodes_and_copies_once(spark):
    """Rows that Spark makes of small triangles are some for each of them, not one for each of their voxels."""
    rng = np.random.default_rng(8)
    some = [tuple(float(v) for v in np.tile(rng.uniform(6, 9, 3), 3) + rng.uniform(-1, 1, 9)) for _ in range(300)]
    once = surface.mesh_distance(spark.createDataFrame(some, NAMES), 3.0).df
    assert 0 < spelt(once) < 30 * len(some)
    copies = surface.mesh_distance(spark.createDataFrame(some * 5, NAMES), 3.0).df
    assert spelt(copies) == spelt(once) and sorted(copies.collect()) == sorted(once.collect())


def test_a_task_sends_the_least_of_each_voxel(monkeypatch):
    """In portions of any size, with ties, and with voxels too far apart for one number."""
    names = [p + a for p in "aec" for a in "xyz"]
    rng = np.random.default_rng(9)
    flat = np.concatenate([rng.integers(1, 14, (60, 9)).astype(float), np.tile([2e9, -2e9, 2e9], (4, 3)) + rng.integers(1, 7, (4, 9))])
    nodes = np.floor(flat.reshape(-1, 3, 3).mean(1) / 16).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([*map(pa.array, nodes.T), *map(pa.array, flat.T)], names=["i", "j", "k", *names])
    told = lambda parts: sorted(t for b in surface._nearest(iter(parts), 2.0) for t in zip(*b.to_pydict().values()))
    whole = told([batch, batch])
    assert len({t[:3] for t in whole}) == len(whole) > 1000 and min(t[0] for t in whole) >= 0 and max(t[0] for t in whole) > 1e9
    monkeypatch.setattr(surface, "PORTION", 100)
    assert told([batch, batch]) == whole
    monkeypatch.setattr(surface, "HELD", 500)
    parts = {}
    for t in told([batch.slice(n, 1) for n in range(batch.num_rows)]):
        parts[t[:3]] = min(parts.get(t[:3], t), t)
    assert sorted(parts.values()) == whole
