"""Queries of bands that move with their surface, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.model import Grid
from gridloom.operators import band, points, stencil
from gridloom.plans.further import _field
from gridloom.plans.queries import BALL, ball, query, shown
from gridloom.plans.sql import near, r

FACES = ", ".join(map(str, [(n, *o) for n, o in enumerate([(0, 0, 0), *stencil.FACES])]))


def _staged(text: str, stages: band.Stages) -> str:
    for stage in stages:
        text = f"(select *, {', '.join(f'{e} as {n}' for n, e in stage.items())} from {text})"
    return text


def _around(table: str, scheme: str, half: float) -> str:
    """A table's rows with their neighbours along the axes, and their own other columns."""
    return _staged(f"(select n.*, t.* exclude (i, j, k, value, active) from {near(table, band.offsets(scheme), 'null::double')} n join {table} t using (i, j, k))", band.resolved(scheme, half))


def _layered(new: str, table: str, half: float) -> str:
    met = f"(select i, j, k, max(own) as own, sum(side) as side from (select t.i + di as i, t.j + dj as j, t.k + dk as k, case when o = 0 then value end as own, case when value < 0 then -1 else 1 end as side from {table} t cross join (values {FACES}) v(o, di, dj, dk)) group by i, j, k)"
    return f"{new} as materialized (select cast(i as int) as i, cast(j as int) as j, cast(k as int) as k, coalesce(own, case when side < 0 then cast({-half} as double) else cast({half} as double) end) as value, true as active from {met})"


def _normal(new: str, table: str, half: float, scheme: str, free: bool = False) -> str:
    value = f"value + rate * {band.NORMAL}"
    return f"{new} as materialized (select i, j, k, {f'case when free then {value} else value end' if free else value} as value, active{', free' * free} from {_staged(_around(table, scheme, half), band.levelled(scheme))})"


def _tracked(new: str, table: str, half: float, count: int, scheme: str) -> str:
    parts = [_layered(f"{new}_0", table, half), *[_normal(f"{new}_{n + 1}", f"{new}_{n}", half, scheme) for n in range(count)]]
    return ", ".join([*parts, f"{new} as materialized (select i, j, k, value, active from {new}_{count} where abs(value) < {half})"])


def _step(new: str, table: str, dt: str, speeds: dict[str, str], rate: band.Stages, half: float, stages: int, scheme: str, speed_join: str = "") -> str:
    parts = [f"{new}_s0 as materialized (select *, value as first from {table})"]
    for n, part in enumerate(band.FIRST[stages]):
        rows = _staged(_staged(f"(select a.*{', f.speed' if speed_join else ''} from {_around(f'{new}_s{n}', scheme, half)} a {speed_join})", [speeds]), rate)
        parts.append(f"{new}_s{n + 1} as materialized (select i, j, k, first * {part}::double + (value + rate * {dt}) * (1 - {part}::double) as value, active, first from {rows})")
    return ", ".join([*parts, f"{new} as materialized (select i, j, k, value, active from {new}_s{stages})"])


ENRIGHT = {f"u{n}": _field(n, *[f"({c} / 50.0::double)" for c in "ijk"]) for n in range(3)}
TOP = " + ".join(f"({u}) * ({u})" for u in ENRIGHT.values())
END = 0.4


def _dt(new: str, table: str, left: str) -> str:
    return f"{new} as materialized (select least({band.CFL[2]!r}::double / max(sqrt({TOP})), {left}) as dt from {table})"


@query(
    "tools_level_set_advection",
    f"with {BALL}, {_dt('t1', 'ball', f'{END}::double')}, {_step('a', 'ball', '(select dt from t1)', ENRIGHT, band.carried('weno5'), 1.5, 2, 'weno5')}, {_tracked('b', 'a', 1.5, 1, 'first')}, "
    f"{_dt('t2', 'b', f'{END}::double - (select dt from t1)')}, {_step('c', 'b', '(select dt from t2)', ENRIGHT, band.carried('weno5'), 1.5, 2, 'weno5')}, {_tracked('d', 'c', 1.5, 1, 'first')} select i, j, k, {r('value', 3)} as value, active from d",
)
def level_set_advection(spark, d):
    """Two steps of two stages each, with the band tracked after each."""
    field = lambda x, y, z, t: points.enright(x / 50.0, y / 50.0, z / 50.0)
    return shown(band.advected(ball(spark, d), field, 0.0, END, 2, "weno5", 1, "first")[0], 3)


@query(
    "tools_level_set_resize",
    f"with {BALL}, {_layered('wide', 'ball', 2.5)}, w0 as materialized (select w.*, b.value is null as free from wide w left join ball b using (i, j, k)), {_normal('w1', 'w0', 2.5, 'weno5', True)}, {_normal('w2', 'w1', 2.5, 'weno5', True)} select i, j, k, {r('value', 3)} as value, active from w2 where abs(value) < 2.25",
)
def level_set_resize(spark, d):
    """A layer more, then all that is within 2.25 voxels."""
    return shown(band.resized(band.widened(ball(spark, d), 1, 2), 2.25), 3)


TARGET = "target as (select i, j, k, value - 0.75 as speed from ball)"


@query(
    "tools_level_set_morphing",
    f"with {BALL}, {TARGET}, {_step('a', 'ball', '0.05::double', {'u0': '-coalesce(speed, 1.5)'}, band.pushed('first'), 1.5, 1, 'first', 'left join target f using (i, j, k)')}, {_tracked('b', 'a', 1.5, 2, 'first')} select i, j, k, {r('value', 3)} as value, active from b",
)
def level_set_morphing(spark, d):
    """A step towards the surface three quarters of a voxel further out."""
    g = ball(spark, d)
    target = Grid(g.map(F.col("value") - 0.75).df, 1.5)
    return shown(band.morphed(g, target, 0.0, 0.05, 1, "first", 2, "first")[0], 3)
