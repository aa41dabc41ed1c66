"""Queries of Poisson's equation with boundary terms and of potential flow, with their SQL.

SQL can't solve the equations, but it gives their right sides: a query returns these, and whether the solution that
Spark has found meets them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.model import Grid
from gridloom.operators import poisson, stencil
from gridloom.operators.stencil import name
from gridloom.plans import sql
from gridloom.plans.queries import BALL, ball, diff, query, shown
from gridloom.plans.sql import near, r
from gridloom.sources import tables

WIND, DILATION = (1.5, 0.5, -0.25), 2


def _missing(source) -> str:
    """What neighbours beyond the domain add to the right side."""
    return " + ".join(f"case when {name(o)} = 0 then {source(o)} else 0 end" for o in stencil.FACES)


def _held(o) -> str:
    return "-(i * 0.5 + 2)" if o[2] == 0 else "-(j * 0.25 - 1)"


@query(
    "tools_poisson_boundary",
    f"with {sql.CUBE}, ones as (select i, j, k, 1.0::double as value, active from cube) select i, j, k, {r(f'c.value / 10000 + {_missing(_held)}', 3)} as \"right\", true as met from {near('ones', stencil.FACES)} n join (select i, j, k, value from cube) c using (i, j, k)",
)
def poisson_boundary(spark, d):
    """Values beyond the sides along i and j, slopes beyond those along k."""

    def terms(o):
        value, slope = F.col("i") * 0.5 + 2, F.col("j") * 0.25 - 1
        return (-value, F.lit(-1.0)) if o[2] == 0 else (-slope, F.lit(0.0))

    rows = tables.cube(spark, d).on.withColumn("value", F.col("value") / 10000)
    found = poisson.applied(rows, terms, poisson.solved(rows, terms, 1e-5, largest=0.02).grid)
    return shown(found.select("i", "j", "k", "right", (F.abs(F.col("left") - F.col("right")) < 0.05).alias("met")), 3)


NEAR18 = ", ".join(map(str, [(n, *o) for n, o in enumerate([(0, 0, 0), *stencil.EDGES])]))


def _domain() -> str:
    """Steps over faces and edges from the inside, then from what is outside."""
    moved = "t.i + di as i, t.j + dj as j, t.k + dk as k"
    parts = [f"f1 as materialized (select i, j, k, inside from (select {moved}, max(case when o = 0 then value < 0 end) as inside, max(o > 0) as next from ball t cross join (values {NEAR18}) s(o, di, dj, dk) where o = 0 or value < 0 group by 1, 2, 3) where inside or (not inside and next))"]
    for n in range(2, DILATION + 1):
        parts.append(f"f{n} as materialized (select {moved}, max(inside) as inside from f{n - 1} t cross join (values {NEAR18}) s(o, di, dj, dk) where o = 0 or not inside group by 1, 2, 3)")
    return ", ".join([*parts, f"domain as materialized (select i, j, k, 1.0::double as value, true as active from f{DILATION} where not inside)"])


SLOPES = ", ".join(f"{diff(n)} as g{a}" for n, a in enumerate("xyz"))
ALONG = " + ".join(f"g{a} * ({w})" for a, w in zip("xyz", WIND))
STEEP = "(gx * gx + gy * gy + gz * gz)"
WALLS = f"walls as materialized (select i, j, k, {', '.join(f'({ALONG}) * g{a} / {STEEP} as v{a}' for a in 'xyz')} from (select i, j, k, {SLOPES} from {near('ball', stencil.FACES, 1.5)}) semi join domain using (i, j, k) where {STEEP} > 0)"
FLOW = f"with {BALL}, {_domain()}, {WALLS}"


def _walls(spark, d):
    g = ball(spark, d)
    domain = poisson.flow_domain(g, DILATION)
    return domain, poisson.wall_velocities(g, domain, WIND)


@query("tools_potential_flow_mask", f"with {BALL}, {_domain()} select * from domain")
def flow_mask(spark, d):
    return poisson.flow_domain(ball(spark, d), DILATION).df


@query("tools_potential_flow_walls", f"{FLOW} select i, j, k, {', '.join(f'{r(f"v{a}")} as v{a}' for a in 'xyz')} from walls")
def flow_walls(spark, d):
    return shown(_walls(spark, d)[1])


@query(
    "tools_potential_flow_potential",
    f"{FLOW} select i, j, k, {r(_missing(lambda o: 'coalesce(-(' + ' + '.join(f'v{a} * ({x})' for a, x in zip('xyz', o)) + '), 0)'), 4)} as \"right\", true as met from {near('domain', stencil.FACES)} n left join walls using (i, j, k)",
)
def flow_potential(spark, d):
    domain, wall = _walls(spark, d)
    found = poisson.applied(*poisson.flow_equation(domain, wall), poisson.potential(domain, wall, 1e-4, largest=0.02).grid)
    return shown(found.select("i", "j", "k", "right", (F.abs(F.col("left") - F.col("right")) < 0.05).alias("met")), 4)


GIVEN = "(i * i - j * k) / 16.0"
SKIN = " or ".join(f"{name(o)}_held = 0" for o in stencil.FACES)


def _velocity(n: int, a: str) -> str:
    return f"(case when ({SKIN}) and v{a} is not null then v{a} else ({name(stencil.axis(n))}_value - {name(stencil.axis(n, -1))}_value) / 2 end) - ({WIND[n]})"


@query(
    "tools_potential_flow_velocities",
    f"{FLOW}, given as materialized (select i, j, k, cast({GIVEN} as double) as value, 1.0::double as held, active from domain) select i, j, k, {', '.join(f'{r(_velocity(n, a))} as v{a}' for n, a in enumerate('xyz'))} from {near('given', stencil.FACES, 0.0, ('value', 'held'))} n left join walls using (i, j, k)",
)
def flow_velocities(spark, d):
    """Velocities of a potential that is given."""
    domain, wall = _walls(spark, d)
    given = Grid(domain.df.withColumn("value", F.expr(f"cast({GIVEN} as double)")), 0.0)
    return shown(poisson.flow(given, wall, WIND))
