"""Points carried along a ball's surface next to plain numpy and to the rotation that they follow."""

import numpy as np
import pytest

from gridloom.model import Grid
from gridloom.operators import constrained

TURN = 0.3


def around(x, y, z):
    return [-y * TURN, x * TURN, z * 0.0 + 0.2]  # about the axis, and off the surface


@pytest.fixture(scope="module")
def ball(spark):
    n = range(-11, 12)
    rows = [(i, j, k, float(v)) for i in n for j in n for k in n if abs(v := np.sqrt(i * i + j * j + k * k) - 7.4) < 3]
    return Grid(spark.createDataFrame(rows, "i int, j int, k int, value double").selectExpr("*", "true as active"), 3.0)


def test_steps_are_those_of_numpy(spark, ball):
    values = {(x["i"], x["j"], x["k"]): x["value"] for x in ball.df.collect()}
    steps = np.eye(3, dtype=int)
    place = {}
    for v, d in values.items():
        sides = [(values.get(tuple(map(int, np.add(v, s)))), values.get(tuple(map(int, np.subtract(v, s))))) for s in steps]
        if all(a is not None and b is not None for a, b in sides):
            place[v] = np.array(v) - d * np.array([(a - b) / 2 for a, b in sides])
    draw = np.random.default_rng(4)
    at = draw.normal(0, 1, (200, 3))
    at = at / np.linalg.norm(at, axis=1)[:, None] * draw.uniform(5, 10, 200)[:, None]
    at[0] = (7, 0, 2)  # on a voxel
    df = spark.createDataFrame([(n, *map(float, x), f"p{n}") for n, x in enumerate(at)], "id int, px double, py double, pz double, name string")
    found = constrained.carried_along(df, ball, around, 0.5, 2, 2, 1)
    assert found.columns == df.columns
    found = {x["id"]: x for x in found.collect()}
    moved = 0
    for n, x in enumerate(at):
        for _ in range(2):
            x = x + 0.5 * np.array([-x[1] * TURN, x[0] * TURN, 0.2])
            for _ in range(2):
                low, total = np.floor(x).astype(int), np.zeros(3)
                for o in np.ndindex(2, 2, 2):
                    w = np.prod(np.where(o, x - low, 1 - (x - low)))
                    if w > 0 and total is not None:
                        p = place.get(tuple(map(int, low + o)))
                        total = None if p is None else total + w * p
                x = x if total is None else total
                moved += total is not None
        assert np.allclose([found[n]["px"], found[n]["py"], found[n]["pz"]], x, atol=1e-9)
        assert found[n]["name"] == f"p{n}"
    assert moved > 300


def test_points_stay_on_the_surface_and_turn_with_the_field(spark, ball):
    a = np.linspace(0, 6, 40)
    df = spark.createDataFrame([(n, float(7.4 * np.cos(x)), float(7.4 * np.sin(x)), 0.0) for n, x in enumerate(a)], "id int, px double, py double, pz double")
    found = constrained.carried_along(df, ball, lambda x, y, z: [-y * TURN, x * TURN, z * 0.0], 0.5, 3, 1, 4).collect()
    for x in found:
        assert abs(np.linalg.norm([x["px"], x["py"], x["pz"]]) - 7.4) < 0.05
        turned = a[x["id"]] + TURN * 1.5
        assert abs(x["px"] - 7.4 * np.cos(turned)) < 0.1 and abs(x["py"] - 7.4 * np.sin(turned)) < 0.1


def test_far_null_and_no_points(spark, ball):
    df = spark.createDataFrame([(1, 30.0, 0.0, 0.0), (2, None, 1.0, 7.0), (3, 0.0, 0.0, 9.0)], "id int, px double, py double, pz double")
    found = {x["id"]: x for x in constrained.carried_along(df, ball, around, 0.5, 1, 1, 0).collect()}
    assert found[1]["px"] == 30.0 and found[2]["px"] is None and found[2]["pz"] == 7.0 and abs(found[3]["pz"] - 7.4) < 0.1
    assert constrained.carried_along(df.limit(0), ball, around, 0.5).count() == 0
    with pytest.raises(ValueError):
        constrained.carried_along(df, ball, around, 0.5, order=3)
