"""Queries of rays, runs, moves, particles and further functions, with their SQL."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.model import IJK
from gridloom.operators import levelset, points, rays, stencil
from gridloom.plans import sql
from gridloom.plans.queries import BALL, HALF, M, OTHERS, T, WITH_CUBE, WITH_EVENTS, WITH_VECTORS, _godunov, _weighted, ball, half_off, query, row, shown
from gridloom.plans.sql import near, r
from gridloom.sources import tables

# --- rays and runs -----------------------------------------------------------------------------------------
LENGTH = 60
AIMED = "rays as (select id, -2.25 as ox, 5.1 + py * 0.125 as oy, 4.3 + pz * 0.125 as oz, 1.0 as dx, px * 0.0078125 as dy, py * 0.0078125 as dz from vectors)"


def _times(a: str) -> str:
    low, high = (f"cast(floor({f}(o{a}, o{a} + d{a} * {LENGTH}) + 0.5) as int)" for f in ("least", "greatest"))
    return f"select id, (unnest(range({low} + 1, {high} + 1)) - 0.5::double - o{a}) / d{a} as t from rays"


SPANS = f"""times as (select id, 0.0::double as t from rays union all select id, {LENGTH}.0::double from rays union all {" union all ".join(map(_times, "xyz"))}),
 spans as (select id, t as enter, lead(t) over (partition by id order by t) as leave from times where t between 0 and {LENGTH}),
 passed as (select id, {", ".join(f"cast(floor(o{a} + d{a} * ((enter + leave) / 2) + 0.5) as int) as {c}" for a, c in zip("xyz", "ijk"))}, enter, leave from spans join rays using (id) where leave > enter)"""
WITH_RAYS = f"with {sql.CUBE}, {HALF}, {sql.VECTORS}, {AIMED}, {SPANS}"


def aimed(spark, d) -> DataFrame:
    """A ray for each embedding, through the cube of line items."""
    x, y, z = F.col("px"), F.col("py"), F.col("pz")
    return tables.vectors(spark, d).select("id", F.lit(-2.25).alias("ox"), (y * 0.125 + 5.1).alias("oy"), (z * 0.125 + 4.3).alias("oz"), F.lit(1.0).alias("dx"), (x * 0.0078125).alias("dy"), (y * 0.0078125).alias("dz"))


@query("math_ray_voxels", f"{WITH_RAYS} select id, i, j, k, {r('enter')} as enter, {r('leave')} as leave from passed")
def ray_voxels(spark, d):
    return shown(rays.crossed(aimed(spark, d), LENGTH))


@query("math_ray_hits", f"{WITH_RAYS}, met as (select * from passed join half_off using (i, j, k) where active qualify row_number() over (partition by id order by enter) = 1) select id, {r('enter')} as enter, i, j, k, {r('value')} as value from met")
def ray_hits(spark, d):
    return shown(rays.hits(half_off(spark, d), aimed(spark, d), LENGTH))


@query("math_ray_integral", f"{WITH_RAYS} select id, count(*) as n, {r('sum(value * (leave - enter))', 2)} as total from passed join half_off using (i, j, k) where active group by id")
def ray_integral(spark, d):
    return shown(rays.through(half_off(spark, d), aimed(spark, d), LENGTH), 2)


@query("tools_active_runs", f"{WITH_EVENTS}, o as (select *, k - row_number() over (partition by i, j order by k) as island from events_grid) select i, j, min(k) as first, max(k) as last, count(*) as n from o group by i, j, island")
def active_runs(spark, d):
    return rays.runs(tables.events(spark, d))


# --- moves and level sets ----------------------------------------------------------------------------------
#: A turn by a right angle about k, i stretched by two, and a shift.
MATRIX, SHIFT = [[0.0, 2.0, 0.0], [-1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], (3.5, 40.25, -2.0)
MOVED = "asked as (select (i, j, k) as id, (j - 40.25) * -1.0 as x, (i - 3.5) * 0.5 as y, (k + 2.0) * 1.0 as z from (select distinct unnest(range(cast(ceil(b * 2.0 + 1.5) as int), cast(floor(b * 2.0 + 5.5) as int) + 1)) as i, j, k from (select b, unnest(range(cast(ceil(a * -1.0 + 39.25) as int), cast(floor(a * -1.0 + 41.25) as int) + 1)) as j, k from (select i as a, j as b, unnest(range(k - 3, k)) as k from cube))))"


@query("tools_grid_transform", f"{WITH_CUBE}, {MOVED}, s as (select * from (with {_weighted(product((0, 1), repeat=3), {0: '(1 - {0})', 1: '{0}'}).replace(', 3) + 0.0', ', 6) + 0.0')})) select id[1] as i, id[2] as j, id[3] as k, value, active from s where active")
def grid_transform(spark, d):
    return shown(rays.transformed(tables.cube(spark, d), MATRIX, SHIFT), 6)


def _slope(outside: str) -> str:
    return f"sqrt(0.0 + {' + '.join(f'({_godunov(n)})' for n in range(3))})".replace("value > 0", outside)


@query("tools_level_set_normalise", f"with {BALL} select i, j, k, {r(f'value - value / sqrt(value * value + 1.0) * ({_slope("value > 0")} - 1.0) * 0.3')} as value, active from {near('ball', stencil.FACES, 1.5)}")
def level_set_normalise(spark, d):
    return shown(levelset.normalised(ball(spark, d)))


OTHER = sql.sphere(24, (12.5, 12.0, 11.0), 6.0, 3.0, "other")


@query("tools_level_set_morph", f"with {BALL}, {OTHER}, n as (select b.*, coalesce(o.value, 3.0) as speed from {near('ball', stencil.FACES, 1.5)} b left join other o using (i, j, k)) select i, j, k, {r(f'value - speed * {_slope("speed > 0")} * 0.3')} as value, active from n")
def level_set_morph(spark, d):
    return shown(levelset.morphed(ball(spark, d), levelset.sphere(spark, 24, (12.5, 12.0, 11.0), 6.0)))


def _reach(p: str) -> str:
    return f"unnest(range(cast(ceil({p} - (r + 1.5)) as int), cast(floor({p} + (r + 1.5)) as int) + 1))"


AWAY = "sqrt((i - px) * (i - px) + (j - py) * (j - py) + (k - pz) * (k - pz)) - r"


@query("tools_particles_to_level_set", f"{WITH_VECTORS}, a as (select px, py, pz, 1.0 + label * 0.25 as r from vectors), b as (select *, {_reach('px')} as i from a), c as (select *, {_reach('py')} as j from b), e as (select *, {_reach('pz')} as k from c), f as (select i, j, k, min({AWAY}) as value from e group by i, j, k) select i, j, k, {r('value')} as value, true as active from f where abs(value) < 1.5")
def particles_to_level_set(spark, d):
    return shown(levelset.particles(tables.vectors(spark, d), F.lit(1.0) + F.col("label") * 0.25, 1.5))


for which, step in (("forward", 1), ("backward", -1)):
    parts = ", ".join(f"{r(f'({stencil.name(stencil.axis(n, step))} - value) * {step}')} as {c}" for n, c in enumerate(("gx", "gy", "gz")))
    query(f"math_gradient_{which}", f"with {BALL} select i, j, k, {parts} from {near('ball', [stencil.axis(n, step) for n in range(3)], 1.5)}")(lambda spark, d, step=step: shown(stencil.one_sided(ball(spark, d), step)))


@query("points_nearest", f"{WITH_VECTORS}, {OTHERS}, o as (select *, cast(row_number() over (partition by id order by distance, other) as int) as place from p) select id, other, {r('distance')} as distance, place from o where place <= 4")
def points_nearest(spark, d):
    p = tables.vectors(spark, d)
    return shown(points.nearest_others(p, p.where("id % 50 = 0"), 4, 4.0))


# --- functions ---------------------------------------------------------------------------------------------
@query("ax_modulo_functions", f"select id, {r('(q - 25) - (-7.0) * trunc((q - 25) / -7.0)')} as truncated, {r('(q - 25) - 7.0 * floor((q - 25) / 7.0)')} as euclidean, {r('(q - 25) - (-7.0) * floor((q - 25) / -7.0)')} as floored from {T}")
def ax_modulo(spark, d):
    x, y = F.col("q") - 25, F.lit(-7.0)
    return shown(row(spark, d).select("id", scalar.truncated_mod(x, y).alias("truncated"), scalar.euclidean_mod(x, y).alias("euclidean"), scalar.floored_mod(x, y).alias("floored")))


def _minor(n: int) -> str:
    (a, b), (c, e) = [x for x in range(3) if x != n // 3], [x for x in range(3) if x != n % 3]
    return f"{'-' if n % 2 else ''}(m{3 * a + c} * m{3 * b + e} - m{3 * a + e} * m{3 * b + c})"


WHOLE = "(m0 * (m4 * m8 - m5 * m7) - m1 * (m3 * m8 - m5 * m6) + m2 * (m3 * m7 - m4 * m6))"


@query("ax_matrix_inverse", f"with m as (select id, {', '.join(f'{e}::double as m{n}' for n, e in enumerate(M))} from {T}) select id, {', '.join(f'{r(_minor(n))} as c{n}' for n in range(9))}, {', '.join(f'{r(f"case when {WHOLE} = 0 then m{n} else {_minor(3 * (n % 3) + n // 3)} / {WHOLE} end", 4)} as v{n}' for n in (0, 1, 5))} from m")
def ax_matrix_inverse(spark, d):
    m = [F.expr(e).cast("double") for e in M]
    c, v = scalar.cofactors(m), scalar.inverse(m)
    df = row(spark, d).select("id", *[x.alias(f"c{n}") for n, x in enumerate(c)], *[v[n].alias(f"v{n}") for n in (0, 1, 5)])
    return df.select("id", *[(F.round(n, 4 if n[0] == "v" else 6) + 0.0).alias(n) for n in df.columns[1:]])


@query("ax_sort_functions", f"select id, l[1] as low, l[2] as middle, l[3] as high, cast(case when y <= z and y <= q * 0.01 then 0 when z <= q * 0.01 then 1 else 2 end as int) as first from (select *, list_sort([y, z, q * 0.01]) as l from {T})")
def ax_sort(spark, d):
    v = (F.col("y"), F.col("z"), F.col("q") * 0.01)
    low, middle, high = scalar.ordered(v)
    return row(spark, d).select("id", low.alias("low"), middle.alias("middle"), high.alias("high"), scalar.order(v)[0].alias("first"))


@query("ax_leaf_offsets", f"{WITH_EVENTS} select i, j, k, ((i & 7) << 6) | ((j & 7) << 3) | (k & 7) as place, i & 7 as x, j & 7 as y, k & 7 as z from events_grid")
def ax_leaf_offsets(spark, d):
    df = tables.events(spark, d).df.select(*IJK, scalar.leaf_offset(*map(F.col, IJK)).alias("place"))
    return df.select("*", *[c.alias(a) for c, a in zip(scalar.offset_coordinates(F.col("place")), "xyz")])
