"""Axes of neighbourhoods and level sets of ellipsoids next to plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import ellipsoids
from gridloom.operators.band import staged

SCHEMA = "id int, px double, py double, pz double"


def test_eigenvectors(spark):
    draw = np.random.default_rng(2)
    many = [(lambda m: m + m.T)(draw.normal(0, 1, (3, 3)) * 10.0 ** draw.integers(-6, 7)) for _ in range(60)]
    many += [np.zeros((3, 3)), np.eye(3) * 4, np.diag([1.0, 2.0, 2.0]), np.ones((3, 3)), np.diag([3.0, -1.0, 0.0])]
    rows = [(n, *(float(m[p, q]) for p, q in ellipsoids.PAIRS)) for n, m in enumerate(many)]
    df = staged(spark.createDataFrame(rows, "n int, " + ", ".join(f"a{p}{q} double" for p, q in ellipsoids.PAIRS)), ellipsoids.eigen())
    for x in df.select("n", "e0", "e1", "e2", *[f"u{r}{n}" for r in range(3) for n in range(3)]).collect():
        m = many[x["n"]]
        e, u = np.array([x[f"e{n}"] for n in range(3)]), np.array([[x[f"u{r}{n}"] for n in range(3)] for r in range(3)])
        size = np.abs(m).max() or 1.0
        assert np.allclose(e / size, np.linalg.eigvalsh(m)[::-1] / size, atol=1e-12)
        assert np.allclose(u @ u.T, np.eye(3), atol=1e-12)
        assert np.allclose(u @ np.diag(e) @ u.T / size, m / size, atol=1e-12)


@pytest.fixture(scope="module")
def cloud():
    draw = np.random.default_rng(3)
    at = np.concatenate([draw.normal(0, 1, (60, 3)) * [4, 1, 0.3], draw.normal(20, 1, (8, 3)), [[50.0, 0, 0]] * 25, [[-50.0, 0, 0]]])
    return np.concatenate([at, at[:5]])  # repeated points


def told(cloud, radius, ratio, threshold, average):
    for x in cloud:
        d = cloud - x
        away = np.linalg.norm(d, axis=1)
        near = away <= radius
        w = 1 - (away[near] / radius) ** 3
        mean = (w[:, None] * d[near]).sum(0) / w.sum()
        c = (w[:, None, None] * np.einsum("np,nq->npq", d[near] - mean, d[near] - mean)).sum(0) / w.sum()
        s, u = np.ones(3), np.eye(3)
        if near.sum() >= threshold:
            e, v = np.linalg.eigh(c)
            e, v = e[::-1], v[:, ::-1]
            if e[0] > 1e-11:
                s, u = np.maximum(e, e[0] * ratio), v
                s = s / np.cbrt(s.prod())
        yield near.sum(), x + average * mean, s, u


def test_neighbourhoods(spark, cloud):
    df = spark.createDataFrame([(n, *map(float, x)) for n, x in enumerate(cloud)], SCHEMA)
    found = {x["id"]: x for x in ellipsoids.local_axes(df, 3.0, 0.25, 1.0, 10, 0.75).collect()}
    assert len(found) == len(cloud)
    for n, (size, q, s, u) in enumerate(told(cloud, 3.0, 0.25, 10, 0.75)):
        x = found[n]
        assert x["n"] == size
        assert np.allclose([x["qx"], x["qy"], x["qz"]], q, atol=1e-9)
        ours = np.array([[x[f"u{r}{m}"] for m in range(3)] for r in range(3)])
        assert np.allclose([x[f"s{m}"] for m in range(3)], s, atol=1e-8)
        assert np.allclose(ours @ np.diag([x[f"s{m}"] for m in range(3)]) @ ours.T, u @ np.diag(s) @ u.T, atol=1e-7)


def test_odd_points(spark):
    rows = [(1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0), (3, float("nan"), 0.0, 0.0), (4, -0.0, 0.0, 0.0)]
    found = {x["id"]: x for x in ellipsoids.local_axes(spark.createDataFrame(rows, SCHEMA), 1.0).collect()}
    assert [found[n]["n"] for n in (1, 2, 3, 4)] == [2, 0, 0, 2] and found[2]["qx"] is None and found[3]["s0"] is None
    empty = spark.createDataFrame([], SCHEMA)
    assert ellipsoids.local_axes(empty, 1.0).count() == 0
    assert ellipsoids.ellipsoids(ellipsoids.local_axes(empty, 1.0), F.lit(1.0)).df.count() == 0


def test_a_sphere_is_a_sphere_and_an_ellipsoid_is_near_its_distance(spark):
    eye = {f"u{r}{n}": F.lit(float(r == n)) for r in range(3) for n in range(3)}
    one = spark.createDataFrame([(0.0, 0.5, -0.25)], "qx double, qy double, qz double")
    ball = ellipsoids.ellipsoids(one.withColumns({**{f"s{n}": F.lit(1.0) for n in range(3)}, **eye}), F.lit(3.0), 2.0).df.collect()
    assert len(ball) > 300
    for x in ball:
        assert abs(x["value"] - (np.linalg.norm([x["i"], x["j"] - 0.5, x["k"] + 0.25]) - 3)) < 1e-9
    long = ellipsoids.ellipsoids(one.withColumns({"s0": F.lit(2.0), "s1": F.lit(1.0), "s2": F.lit(0.5), **eye}), F.lit(4.0), 1.5).df.collect()
    t, p = np.meshgrid(np.linspace(0, 2 * np.pi, 400), np.linspace(0, np.pi, 200))
    skin = np.stack([8 * np.cos(t) * np.sin(p), 4 * np.sin(t) * np.sin(p) + 0.5, 2 * np.cos(p) - 0.25], -1).reshape(-1, 3)
    for x in [x for x in long if 0 < x["value"] < 0.5]:
        true = np.linalg.norm(skin - [x["i"], x["j"], x["k"]], axis=1).min()
        assert x["value"] <= true + 1e-9 and true - x["value"] < 0.15
