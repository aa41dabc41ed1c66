"""The query of points carried along a surface, with its SQL."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from gridloom.model import IJK
from gridloom.operators import constrained, stencil
from gridloom.plans.queries import BALL, ball, query, shown
from gridloom.plans.sql import near, r
from gridloom.sources import tables

STEP, STEPS, PROJECTIONS, TURN = 0.5, 2, 2, 0.05
PLACES = ", ".join(f"{c} - value * ({stencil.name(stencil.axis(n))} - {stencil.name(stencil.axis(n, -1))}) / 2 as {a}" for n, (c, a) in enumerate(zip(IJK, "xyz")))
CLOSEST = f"places as materialized (select * from (select i, j, k, {PLACES} from {near('ball', stencil.FACES, 'null::double')}) where x is not null and y is not null and z is not null)"
OFFSETS = ", ".join(map(str, product((0, 1), repeat=3)))
WEIGHT = " * ".join(f"(case when {d} = 1 then p{a} - floor(p{a}) else 1.0 - (p{a} - floor(p{a})) end)" for d, a in zip(("di", "dj", "dk"), "xyz"))


def velocity(x, y, z):
    return [-y * TURN, x * TURN, z * 0.0 + 0.25]


def _put_back(of: str) -> str:
    corners = f"(select id, px, py, pz, {', '.join(f'cast(floor(p{a}) as int) + d{c} as {c}' for a, c in zip('xyz', IJK))}, {WEIGHT} as w from {of}, (values {OFFSETS}) o(di, dj, dk))"
    return f"(select id, {', '.join(f'case when count(x) = count(*) then sum(w * {a}) else p{a} end as p{a}' for a in 'xyz')} from {corners} left join places using (i, j, k) where w > 0 group by id, px, py, pz)"


def _moved(of: str) -> str:
    return f"(select id, px - py * {TURN} * {STEP} as px, py + px * {TURN} * {STEP} as py, pz + 0.25 * {STEP} as pz from {of})"


def _all() -> str:
    of = "asked"
    for _ in range(STEPS):
        of = _moved(of)
        for _ in range(PROJECTIONS):
            of = _put_back(of)
    return of


@query("points_advect_constrained", f"with {BALL}, {CLOSEST}, asked as (select id, px + 1.2 as px, py - 0.4 as py, pz + 0.3 as pz from vectors) select id, {', '.join(f'{r(f"p{a}", 5)} as p{a}' for a in 'xyz')} from {_all()}")
def advect_constrained(spark, d):
    p = tables.vectors(spark, d).select("id", (F.col("px") + 1.2).alias("px"), (F.col("py") - 0.4).alias("py"), (F.col("pz") + 0.3).alias("pz"))
    return shown(constrained.carried_along(p, ball(spark, d), velocity, STEP, STEPS, PROJECTIONS, 1), 5)
