"""Poisson's equation with boundary terms against dense solutions, and potential flow against its closed form."""

import numpy as np
from gridloom.model import IJK, Grid, grid
from gridloom.operators import levelset, poisson
from gridloom.operators.stencil import FACES
from gridloom.plans import poisson as plans
from pyspark.sql import functions as F


def dense(at, right, terms):
    """A plain matrix; terms(place, offset) gives (source, diagonal) of a missing neighbour."""
    number = {c: n for n, c in enumerate(at)}
    m, b = np.zeros((len(at), len(at))), np.array(right, dtype=float)
    for c, n in number.items():
        for o in FACES:
            other = tuple(int(x) for x in np.add(c, o))
            if other in number:
                m[n, n] -= 1
                m[n, number[other]] += 1
            else:
                source, diagonal = terms(c, o)
                b[n] += source
                m[n, n] += diagonal
    return np.linalg.solve(m, b)


def scattered(n, side, seed):
    rng = np.random.default_rng(seed)
    at = sorted({tuple(int(x) - 3 for x in rng.integers(0, side, 3)) for _ in range(n)})
    return at, rng.normal(0, 1, len(at))


def rows_of(spark, at, right):
    return spark.createDataFrame([(*c, float(v)) for c, v in zip(at, right)], "i int, j int, k int, value double")


def found(s):
    return {(r.i, r.j, r.k): r.value for r in s.grid.df.collect()}


def test_boundary_terms_and_levels_against_a_dense_solution(spark):
    at, right = scattered(4500, 14, 1)  # more than COARSEST, with holes and negative places
    assert len(at) > 2 * poisson.COARSEST
    rows = rows_of(spark, at, right)

    def terms(o):
        value, slope = F.col("i") * 0.5 + o[0], F.col("j") * 0.25 - 1
        return (-value, F.lit(-1.0)) if o[2] == 0 else (-slope, F.lit(0.0))

    want = dense(at, right, lambda c, o: (-(c[0] * 0.5 + o[0]), -1) if o[2] == 0 else (-(c[1] * 0.25 - 1), 0))
    s = poisson.solved(rows, terms, 1e-9)
    got = found(s)
    assert len(got) == len(at) and max(abs(got[c] - want[n]) for n, c in enumerate(at)) < 1e-5
    assert s.error <= 1e-9 and s.rounds <= 25
    both = poisson.applied(rows, terms, s.grid).collect()
    assert len(both) == len(at) and max(abs(r.left - r.right) for r in both) < 1e-5


def test_small_domains_nulls_and_none(spark):
    at, right = scattered(60, 6, 2)
    right[5] = 0
    rows = rows_of(spark, at, right).withColumn("value", F.when(F.col("value") != 0, F.col("value")))  # one null
    got = found(poisson.solved(rows, poisson.dirichlet(2.0), 1e-9))
    want = dense(at, right, lambda c, o: (-2.0, -1))
    assert max(abs(got[c] - want[n]) for n, c in enumerate(at)) < 1e-6
    empty = poisson.solved(rows.where("false"))
    assert empty.grid.df.count() == 0 and empty.rounds == 0
    still = poisson.solved(rows.withColumn("value", F.lit(0.0)))
    assert still.rounds == 0 and set(found(still).values()) == {0.0}


def test_a_closed_domain_is_solved_up_to_a_constant(spark):
    rows = levelset.lattice(spark, 6).withColumn("value", F.cos(np.pi * (F.col("i") + 0.5) / 6))
    got = found(poisson.solved(rows, poisson.neumann(), 1e-9))
    factor = 2 * np.cos(np.pi / 6) - 2  # of this wave, exact for mirrored ends
    want = {c: np.cos(np.pi * (c[0] + 0.5) / 6) / factor for c in got}
    shift = np.mean([got[c] - want[c] for c in got])
    assert max(abs(got[c] - want[c] - shift) for c in got) < 1e-6


def test_flow_domain_is_outside_only(spark):
    g = levelset.sphere(spark, 24, (11.5, 11.5, 11.5), 6.0, 1.6)  # hollow
    inside = {(r.i, r.j, r.k) for r in levelset.lattice(spark, 24).where("sqrt(pow(i - 11.5, 2) + pow(j - 11.5, 2) + pow(k - 11.5, 2)) < 6").collect()}
    want, last = set(inside), set(inside)
    for _ in range(3):
        last = {tuple(np.add(c, o)) for c in last for o in np.ndindex(3, 3, 3) for o in [np.subtract(o, 1)] if np.abs(o).sum() <= 2}
        want |= last
    got = [(r.i, r.j, r.k) for r in poisson.flow_domain(g, 3).df.collect()]
    assert len(got) == len(set(got)) and set(got) == want - inside


def test_flow_in_a_shell_around_a_sphere(spark):
    inner, outer, wind, n = 6.0, 12.0, 1.5, 26
    d = "sqrt(pow(i - 12.5, 2) + pow(j - 12.5, 2) + pow(k - 12.5, 2))"
    g = levelset.sphere(spark, n, (12.5, 12.5, 12.5), inner, 1.6)
    domain = grid(levelset.lattice(spark, n).where(f"{d} >= {inner} and {d} <= {outer}").withColumn("value", F.lit(1.0)))
    wall = poisson.wall_velocities(g, domain, (wind, 0.0, 0.0))
    s = poisson.potential(domain, wall)
    assert s.error <= 1e-6
    # (a r + b / r^2) cos, 0 at the outer shell, sloping by the wind at the sphere
    out = outer + 0.5
    a = wind / (1 + 2 * (out / inner) ** 3)
    b = -a * out**3
    miss, size = 0.0, 0.0
    for r in s.grid.df.collect():
        x = np.array([r.i, r.j, r.k]) - 12.5
        away = np.linalg.norm(x)
        want = (a * away + b / away**2) * x[0] / away
        miss, size = miss + (r.value - want) ** 2, size + want**2
    assert (miss / size) ** 0.5 < 0.15
    # velocities: odd about the middle, the wall's own at the skin, less the wind
    v = {(r.i, r.j, r.k): (r.vx, r.vy, r.vz) for r in poisson.flow(s.grid, wall, (wind, 0.0, 0.0)).collect()}
    held = {(r.i, r.j, r.k): (r.vx, r.vy, r.vz) for r in wall.collect()}
    assert set(v) == set(found(s))
    skin = [c for c in held if any(tuple(np.add(c, o)) not in v for o in FACES)]
    assert skin and all(np.allclose(np.add(v[c], (wind, 0, 0)), held[c]) for c in skin)
    assert all(abs(v[c][0] - v[(25 - c[0], c[1], c[2])][0]) < 1e-4 for c in v)


def test_walls_that_move_and_nothing_that_moves(spark):
    g = levelset.sphere(spark, 12, (5.5, 5.5, 5.5), 3.0, 1.6)
    domain = poisson.flow_domain(g, 2)
    assert poisson.wall_velocities(g, domain, (0.0, 0.0, 0.0)).count() == 0
    moving = g.df.select(*IJK, F.lit(0.0).alias("vx"), F.lit(2.0).alias("vy"), F.lit(0.0).alias("vz")).where("i < 6")
    got = poisson.wall_velocities(g, domain, (0.0, 1.0, 0.0), moving).collect()
    still = {(r.i, r.j, r.k): r.vy for r in poisson.wall_velocities(g, domain, (0.0, 1.0, 0.0)).collect()}
    assert got and all(abs(r.vy - still[r.i, r.j, r.k] * (3 if r.i < 6 else 1)) < 1e-9 for r in got)
    assert poisson.potential(Grid(domain.df), poisson.wall_velocities(g, domain, (0.0, 0.0, 0.0))).rounds == 0


def test_large_values_meet_an_error_of_fixed_size(spark):
    rows = spark.range(12**3).selectExpr("cast(id % 12 as int) as i", "cast(floor(id / 12) % 12 as int) as j", "cast(floor(id / 144) as int) as k", "cast(1e6 * ((id * 7919) % 101) as double) as value")
    x = poisson.solved(rows, poisson.dirichlet(), 1e-5, largest=0.02).grid
    worst = poisson.applied(rows, poisson.dirichlet(), x).selectExpr("max(abs(left - right))").first()[0]
    assert worst < 0.05


def test_a_pocket_without_a_solution_does_not_hold_up_the_rest(spark):
    """A pair of walled-off voxels whose slopes don't sum to 0, beside a bar that is held at its sides."""
    at = [(n, 0, 0) for n in range(5)] + [(9, 0, 0), (10, 0, 0)]
    rows = spark.createDataFrame([(*a, 1.0, a[0] > 8) for a in at], "i int, j int, k int, value double, free boolean")
    terms = lambda o: (F.when(F.col("free"), 0.0).otherwise(-1.0), F.when(F.col("free"), 0.0).otherwise(-1.0))
    s = poisson.solved(rows, terms, 1e-9)
    assert s.rounds < 20 and s.error <= 1e-9
    met = {x["i"]: abs(x["left"] - x["right"]) for x in poisson.applied(rows, terms, s.grid).collect()}
    assert all(met[n] < 1e-6 for n in range(5)) and abs(met[9] - 1.0) < 1e-6


def test_the_potentials_query_meets_its_right_sides_in_a_strong_wind(spark, monkeypatch):
    """Its bound is of a fixed size, as the right side's length grows with the domain and the wind."""
    monkeypatch.setattr(plans, "ball", lambda spark, d: levelset.sphere(spark, 22, (10.5, 10.5, 10.5), 7.0, 1.6))
    monkeypatch.setattr(plans, "WIND", (1.5e4, 0.5e4, -0.25e4))
    got = plans.flow_potential(spark, "").collect()
    assert len(got) > poisson.COARSEST and all(r.met for r in got)
    assert max(abs(r.right) for r in got) > 1e4
