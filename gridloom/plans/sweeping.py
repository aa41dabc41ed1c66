"""Queries of distances by the Eikonal equation, with SQL that updates all voxels at once until they stand still."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.model import Grid
from gridloom.operators import stencil, sweeping
from gridloom.plans import sql
from gridloom.plans.queries import BALL, WITH_CUBE, _offsets, ball, query, shown
from gridloom.plans.sql import near, r
from gridloom.sources import tables

FAR = "1e18::double"
#: o, offset, axis; a voxel sends its values to where its neighbours find them.
SENT = ", ".join(str((n, *[-x for x in o], next((a for a in range(3) if o[a]), -1))) for n, o in enumerate([(0, 0, 0), *stencil.FACES]))
TWO = "(l[1] + l[2] + sqrt(greatest(2 - (l[1] - l[2]) * (l[1] - l[2]), 0))) / 2"
SUM = "(l[1] + l[2] + l[3])"
THREE = f"({SUM} + sqrt(greatest({SUM} * {SUM} - 3 * (l[1] * l[1] + l[2] * l[2] + l[3] * l[3] - 1), 0))) / 3"


def swept(name: str, start: str, rounds: int) -> str:
    """Tables name0 ... of (i, j, k, d, s, e, fixed); d is FAR until it is known."""
    parts = [f"{name}0 as materialized ({start})"]
    for n in range(rounds):
        axes_ = ", ".join(f"coalesce(min(case when axis = {a} then d end), {FAR}) as d{a}, arg_min(case when axis = {a} then e end, case when axis = {a} then d end) as e{a}" for a in range(3))
        own = ", ".join(f"max(case when o = 0 then {c} end) as {c}" for c in ("d", "s", "e", "fixed"))
        met = f"(select i, j, k, {own}, {axes_}, arg_min(case when o > 0 then s end, case when o > 0 then d end) as sn from (select t.i + di as i, t.j + dj as j, t.k + dk as k, d, s, e, fixed, o, axis from {name}{n} t cross join (values {SENT}) v(o, di, dj, dk, axis)) group by i, j, k having max(case when o = 0 then 1 end) = 1)"
        new = f"(select *, case when l[1] >= {FAR} / 2 then {FAR} when l[1] + 1 <= l[2] then l[1] + 1 when {TWO} <= l[3] then {TWO} else {THREE} end as dn from (select *, list_sort([d0, d1, d2]) as l from {met}))"
        known = f"(select * exclude (d), case when fixed then d else least(d, dn) end as d from {new})"
        weights = [f"greatest(d - d{a}, 0)" for a in range(3)]
        parts.append(f"{name}{n + 1} as materialized (select i, j, k, d, case when fixed or d >= {FAR} / 2 then s else sn end as s, case when fixed or d >= {FAR} / 2 then e else ({' + '.join(f'{w} * coalesce(e{a}, 0)' for a, w in enumerate(weights))}) / ({' + '.join(weights)}) end as e, fixed from {known})")
    return ", ".join(parts)


def started(table: str, iso: str, above: int, background: str, field: str | None = None) -> str:
    """(i, j, k, d, s, e, fixed) of active voxels: distances at crossings."""
    other = [[f"coalesce({stencil.name(stencil.axis(n, s))}, {background})" for s in (-1, 1)] for n in range(3)]
    t = ", ".join(f"case when (value < {iso}) <> ({o} < {iso}) then abs((value - {iso}) / (value - {o})) end as t{n}{m}" for n in range(3) for m, o in enumerate(other[n]))
    least = ", ".join(f"least(t{n}0, t{n}1) as t{n}, case when t{n}1 is null or t{n}0 <= t{n}1 then -1 else 1 end as u{n}" for n in range(3))
    w = [f"coalesce(1 / (t{n} * t{n}), 0)" for n in range(3)]
    total = " + ".join(w)
    e = "null::double"
    if field:
        there = [field.format(*[f"({c} + u{n} * t{n})" if m == n else c for m, c in enumerate("ijk")]) for n in range(3)]
        e = f"({' + '.join(f'case when t{n} is null then 0 else {x} * ({v}) end' for n, (x, v) in enumerate(zip(w, there)))}) / ({total})"
    on = "coalesce(t0, t1, t2) is not null"
    rows = near(table, stencil.FACES, "null::double")
    return f"select i, j, k, case when {on} then 1 / sqrt({total}) else {FAR} end as d, case when value > {iso} then {above}.0::double else {-above}.0::double end as s, case when {on} then {e} end as e, {on} as fixed from (select *, {least} from (select *, {t} from {rows}))"


def signed(name: str) -> str:
    """The rows' distances; those that weren't reached take the extremes of what was."""
    end = f"select i, j, k, d, s from {name}"
    return f"select i, j, k, {r(f'case when d < {FAR} / 2 then d * s when s < 0 then low else high end')} as value, true as active from ({end}), (select min(d * s) as low, max(d * s) as high from {name} where d < {FAR} / 2)"


#: The right surface, but wrong slopes.
BENT = "bent as materialized (select i, j, k, value * (1 + abs(value)) as value, active from ball)"


def bent(spark, d) -> Grid:
    g = ball(spark, d)
    return g.map(F.col("value") * (F.abs("value") + 1.0))


@query("tools_sdf_to_sdf", f"with {BALL}, {BENT}, {swept('x', started('bent', '0', 1, 'value'), 12)} {signed('x12')}")
def sdf_to_sdf(spark, d):
    return shown(sweeping.sdf_to_sdf(bent(spark, d)))


MIDDLE = "(select floor(avg(value)) from cube)"


@query("tools_fog_to_sdf", f"{WITH_CUBE}, {swept('x', started('cube', MIDDLE, -1, '0.0'), 12)} {signed('x12')}")
def fog_to_sdf(spark, d):
    g = tables.cube(spark, d)
    return shown(sweeping.fog_to_sdf(g, g.df.agg(F.floor(F.avg("value"))).first()[0] or 0))


FIELD = "{0} + 2 * ({1}) - 0.5 * ({2})"


@query("tools_sdf_to_extension", f"with {BALL}, {BENT}, {swept('x', started('bent', '0', 1, 'value', FIELD), 14)} select i, j, k, {r('e', 5)} as value, true as active from (select i, j, k, coalesce(case when d < {FAR} / 2 then e end, 0.0) as e from x14)")
def sdf_to_extension(spark, d):
    return shown(sweeping.extension(bent(spark, d), 0.0, lambda x, y, z: x + y * 2 - z * 0.5)[1], 5)


@query("tools_fog_to_extension", f"{WITH_CUBE}, {swept('x', started('cube', MIDDLE, -1, '0.0', FIELD), 14)} select i, j, k, {r(f'case when s > 0 then 0.0 when d < {FAR} / 2 then e else 0.0 end', 5)} as value, true as active from x14")
def fog_to_extension(spark, d):
    """Only where the density is above the surface's value; elsewhere the field is 0."""
    g = tables.cube(spark, d)
    iso = g.df.agg(F.floor(F.avg("value"))).first()[0] or 0
    return shown(sweeping.extension(g, iso, lambda x, y, z: x + y * 2 - z * 0.5, fog=True, side=1, default=Grid(g.map(F.lit(0.0)).df, 0.0))[1], 5)


def _grown(near_: int, steps: int) -> str:
    parts = [f"grown0 as (select i, j, k from ball), o(di, dj, dk) as (values {_offsets(near_)})"]
    parts += [f"grown{n + 1} as materialized (select distinct cast(i + di as int) i, cast(j + dj as int) j, cast(k + dk as int) k from grown{n}, o)" for n in range(steps)]
    return ", ".join(parts)


def _kept(mask: str) -> str:
    return f"select i, j, k, coalesce(abs(value), {FAR}) as d, case when value < 0 then -1.0::double else 1.0::double end as s, 0.0::double as e, value is not null as fixed from {mask} left join ball using (i, j, k)"


@query("tools_dilate_sdf", f"with {BALL}, {_grown(6, 2)}, {swept('x', _kept('grown2'), 14)} {signed('x14')}")
def dilate_sdf(spark, d):
    return shown(sweeping.dilated(ball(spark, d), 2))


@query("tools_mask_sdf", f"with {BALL}, {_grown(26, 1)}, {swept('x', _kept('grown1'), 14)} {signed('x14')}")
def mask_sdf(spark, d):
    g = ball(spark, d)
    return shown(sweeping.masked(g, stencil.dilate(g, 26)))
