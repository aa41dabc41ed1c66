"""The operators over the driver's tables, and DuckDB's SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.model import IJK, Grid
from gridloom.operators import combine, levelset, points, sample, stats, stencil, tree
from gridloom.plans import sql
from gridloom.plans.sql import near, paired, r
from gridloom.sources import tables
from gridloom.streaming import voxels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = f
        if text is not None:
            SQL[name] = text
        return f

    return add


def shown(g: Grid | DataFrame, digits: int = 6) -> DataFrame:
    """Rows for comparing: numbers rounded, without negative zeros."""
    df = g.df if isinstance(g, Grid) else g
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# --- two grids ---------------------------------------------------------------------------------------------
WITH_AR = f"with {sql.flag('A')}, {sql.flag('R')}"


def two(name: str, f: Callable[[Grid, Grid], Grid], value: str, active: str = "on_a or on_b", where: str = "true", bg: float = 0.0) -> None:
    QUERIES[name] = lambda spark, d: shown(f(Grid(tables.by_flag(spark, d, "A").df, bg), Grid(tables.by_flag(spark, d, "R").df, bg)))
    SQL[name] = f"{WITH_AR} select i, j, k, {r(value)} as value, {active} as active from {paired('a', 'r', bg, bg)} where {where}"


two("tools_comp_min", combine.minimum, "least(a, b)")
two("tools_comp_max", combine.maximum, "greatest(a, b)")
two("tools_comp_sum", combine.add, "a + b")
two("tools_comp_mul", combine.multiply, "a * b", bg=2.0)
two("tools_comp_div", combine.divide, "a / b", bg=3.0)
two("tools_comp_replace", combine.over, "case when on_b then b else a end")
two("tools_csg_union", combine.union, "least(a, b)", "case when a <= b then on_a else on_b end", bg=30000.0)
two("tools_csg_intersection", combine.intersection, "greatest(a, b)", "case when a >= b then on_a else on_b end", bg=30000.0)
two("tools_csg_difference", combine.difference, "greatest(a, -b)", "case when a >= -b then on_a else on_b end", bg=30000.0)
two("tree_topology_union", lambda a, b: combine.topology(a, b, "union"), "a")
two("tree_topology_intersection", lambda a, b: combine.topology(a, b, "intersection"), "a", "on_a and on_b", "has_a")
two("tree_topology_difference", lambda a, b: combine.topology(a, b, "difference"), "a", "on_a and not on_b", "has_a")
two("tree_combine_extended", lambda a, b: combine.combine(a, b, lambda x, y: F.least(x, y) * 2 + F.greatest(x, y) * 3, 0.0), "least(a, b) * 2 + greatest(a, b) * 3")
two("tools_clip_mask", combine.clip_mask, "a", "on_a", "has_a and on_b")
two("tools_clip_mask_outside", lambda a, b: combine.clip_mask(a, b, False), "a", "on_a", "has_a and not on_b")

KINDS = ("click", "error", "purchase", "signup", "view")
WITH_KINDS = "with " + ", ".join(map(sql.kind, KINDS))
ALL_KINDS = " union all ".join(f"select *, {n} as n from {e}" for n, e in enumerate(KINDS))
for how, text in {"sum": "sum(value)", "min": "min(value)", "max": "max(value)", "count": "cast(count(*) as double)", "first": "arg_min(value, n)"}.items():
    QUERIES[f"tools_merge_{how}"] = lambda spark, d, how=how: shown(combine.merge([tables.events(spark, d, e) for e in KINDS], how), 4)
    SQL[f"tools_merge_{how}"] = f"{WITH_KINDS} select i, j, k, {r(text, 4)} as value, true as active from ({ALL_KINDS}) group by i, j, k"


# --- one grid, voxel by voxel ------------------------------------------------------------------------------
WITH_CUBE = f"with {sql.CUBE}"


@query("tools_clip_box", f"{WITH_CUBE} select * from cube where i between 5 and 30 and j between 2 and 8 and k between 0 and 4")
def clip_box(spark, d):
    return combine.clip_box(tables.cube(spark, d), (5, 2, 0), (30, 8, 4)).df


@query("tools_clip_box_outside", f"{WITH_CUBE} select * from cube where not (i between 5 and 30 and j between 2 and 8 and k between 0 and 4)")
def clip_box_outside(spark, d):
    return combine.clip_box(tables.cube(spark, d), (5, 2, 0), (30, 8, 4), False).df


@query("tree_fill", f"{WITH_CUBE} select * from cube where not (i between 48 and 55 and j between 8 and 12 and k between 6 and 9) union all select cast(a.range as int), cast(b.range as int), cast(c.range as int), 7.0::double, true from range(48, 56) a, range(8, 13) b, range(6, 10) c")
def fill(spark, d):
    return combine.fill(tables.cube(spark, d), (48, 8, 6), (55, 12, 9), 7.0).df


def half_off(spark, d) -> Grid:
    """The cube with the voxels of high prices active only."""
    g = tables.cube(spark, d)
    return g.with_df(g.df.withColumn("active", F.col("value") > 40000))


HALF = "half_off as (select i, j, k, value, value > 40000 as active from cube)"


@query("tools_activate", f"{WITH_CUBE}, {HALF} select i, j, k, value, active or abs(value - 30000) <= 5000 as active from half_off")
def activate(spark, d):
    return combine.activate(half_off(spark, d), 30000.0, 5000.0).df


@query("tools_deactivate", f"{WITH_CUBE}, {HALF} select i, j, k, value, active and abs(value - 60000) > 9000 as active from half_off")
def deactivate(spark, d):
    return combine.deactivate(half_off(spark, d), 60000.0, 9000.0).df


@query("tools_mask", f"{WITH_CUBE}, {HALF} select i, j, k, 1.0::double as value, true as active from half_off where active")
def mask(spark, d):
    return combine.mask(half_off(spark, d)).df


@query("tools_foreach", f"{WITH_CUBE}, {HALF} select i, j, k, case when active then {r('value * 2 + i')} else value end as value, active from half_off")
def foreach(spark, d):
    g = half_off(spark, d)
    return g.map(F.round(F.col("value") * 2 + F.col("i"), 6) + 0.0).df


# --- neighbourhoods ----------------------------------------------------------------------------------------
def diff(n: int, of: str = "") -> str:
    tail = f"_{of}" if of else ""
    return f"({stencil.name(stencil.axis(n))}{tail} - {stencil.name(stencil.axis(n, -1))}{tail}) / 2"


FACES_SUM = " + ".join(stencil.name(o) for o in stencil.FACES)
GRADIENT = ", ".join(f"{r(diff(n))} as {c}" for n, c in enumerate(("gx", "gy", "gz")))
NORM = f"sqrt({' + '.join(f'{diff(n)} * ({diff(n)})' for n in range(3))})"


@query("tools_gradient", f"{WITH_CUBE} select i, j, k, {GRADIENT} from {near('cube', stencil.FACES)}")
def gradient(spark, d):
    return shown(stencil.gradient(tables.cube(spark, d)))


@query("tools_gradient_inactive_neighbours", f"{WITH_CUBE}, {HALF} select i, j, k, {GRADIENT} from {near('half_off', stencil.FACES, 5.0)}")
def gradient_inactive(spark, d):
    return shown(stencil.gradient(Grid(half_off(spark, d).df, 5.0)))


@query("tools_magnitude", f"{WITH_CUBE} select i, j, k, {r(NORM, 4)} as value, true as active from {near('cube', stencil.FACES)}")
def magnitude(spark, d):
    return shown(stencil.norm(tables.cube(spark, d)), 4)


@query("tools_laplacian", f"{WITH_CUBE} select i, j, k, {r(f'({FACES_SUM}) - value * 6', 4)} as value, active from {near('cube', stencil.FACES)}")
def laplacian(spark, d):
    return shown(stencil.laplacian(tables.cube(spark, d)), 4)


CLOSEST = ", ".join(f"{r(f'{c} - value * ({diff(n)})')} as {x}" for n, (c, x) in enumerate(zip("ijk", "xyz")))
#: A level set from a whole table: the band of spheres around all vectors.
BALL = f"{sql.VECTORS}, {sql.BALLS}"


def ball(spark, d) -> Grid:
    return levelset.particles(tables.vectors(spark, d), F.lit(1.0) + F.col("label") * 0.25, 1.5)


@query("tools_closest_point", f"with {BALL} select i, j, k, {CLOSEST} from {near('ball', stencil.FACES, 1.5)}")
def closest_point(spark, d):
    return shown(stencil.closest_point(ball(spark, d)))


def _second(n: int) -> str:
    return f"({stencil.name(stencil.axis(n))} + {stencil.name(stencil.axis(n, -1))} - value * 2)"


def _mixed(a: int, b: int) -> str:
    at = lambda s, t: stencil.name(tuple(s if n == a else t if n == b else 0 for n in range(3)))
    return f"(({at(1, 1)} - {at(1, -1)} - {at(-1, 1)} + {at(-1, -1)}) / 4)"


BENT = f"""e as (select *, {diff(0)} as x, {diff(1)} as y, {diff(2)} as z, {_second(0)} as xx, {_second(1)} as yy, {_second(2)} as zz, {_mixed(0, 1)} as xy, {_mixed(0, 2)} as xz, {_mixed(1, 2)} as yz from {near('ball', stencil.EDGES, 1.5)}),
    f as (select *, x * x + y * y + z * z as s from e), bent as (select i, j, k, value, active, s, case when s > 1e-12 then (x * x * (yy + zz) + y * y * (xx + zz) + z * z * (xx + yy) - (x * y * xy + x * z * xz + y * z * yz) * 2) / (pow(s, 1.5) * 2) else 0.0 end as bend from f)"""


@query("tools_mean_curvature", f"with {BALL}, {BENT} select i, j, k, {r('bend')} as value, active from bent")
def mean_curvature(spark, d):
    return shown(stencil.mean_curvature(ball(spark, d)))


def _godunov(n: int) -> str:
    b, a = f"(value - {stencil.name(stencil.axis(n, -1))})", f"({stencil.name(stencil.axis(n))} - value)"
    return f"case when value > 0 then greatest(pow(greatest({b}, 0.0), 2.0), pow(least({a}, 0.0), 2.0)) else greatest(pow(least({b}, 0.0), 2.0), pow(greatest({a}, 0.0), 2.0)) end"


@query("math_upwind_norm", f"with {BALL} select i, j, k, {r(f'sqrt(0.0 + ({_godunov(0)}) + ({_godunov(1)}) + ({_godunov(2)}))')} as value, active from {near('ball', stencil.FACES, 1.5)}")
def upwind_norm(spark, d):
    return shown(stencil.upwind_norm(ball(spark, d)))


VECTOR = "vec as (select i, j, k, max(case when event_type = 'click' then value end) as vx0, max(case when event_type = 'purchase' then value end) as vy0, max(case when event_type = 'view' then value end) as vz0 from (select *, 'click' as event_type from click union all select *, 'purchase' from purchase union all select *, 'view' from view) group by i, j, k), v as (select i, j, k, coalesce(vx0, 0.0) as vx, coalesce(vy0, 0.0) as vy, coalesce(vz0, 0.0) as vz, true as active from vec)"
WITH_VECTOR = f"with {sql.kind('click')}, {sql.kind('purchase')}, {sql.kind('view')}, {VECTOR}"


def vector(spark, d) -> Grid:
    """Three kinds of events as one grid of vectors."""
    rows = None
    for n, e in zip(("vx", "vy", "vz"), ("click", "purchase", "view")):
        own = tables.events(spark, d, e).df.select(*IJK, F.lit(n).alias("part"), "value")
        rows = own if rows is None else rows.unionByName(own)
    parts = rows.groupBy(*IJK).agg(*[F.coalesce(F.max(F.when(F.col("part") == n, F.col("value"))), F.lit(0.0)).alias(n) for n in ("vx", "vy", "vz")])
    return Grid(parts.withColumn("active", F.lit(True)), 0.0)


NEAR_V = near("v", stencil.FACES, 0.0, ("vx", "vy", "vz"))


@query("tools_divergence", f"{WITH_VECTOR} select i, j, k, {r(f'{diff(0, "vx")} + {diff(1, "vy")} + {diff(2, "vz")}')} as value from {NEAR_V}")
def divergence(spark, d):
    return shown(stencil.divergence(vector(spark, d)))


@query("tools_curl", f"{WITH_VECTOR} select i, j, k, {r(f'{diff(1, "vz")} - {diff(2, "vy")}')} as cx, {r(f'{diff(2, "vx")} - {diff(0, "vz")}')} as cy, {r(f'{diff(0, "vy")} - {diff(1, "vx")}')} as cz from {NEAR_V}")
def curl(spark, d):
    return shown(stencil.curl(vector(spark, d)))


@query("tools_normalize", f"{WITH_VECTOR}, n as (select *, sqrt(vx * vx + vy * vy + vz * vz) as l from v) select i, j, k, {', '.join(f'{r(f"case when l = 0 then {c} else {c} / l end")} as {c}' for c in ('vx', 'vy', 'vz'))} from n")
def normalize(spark, d):
    df = vector(spark, d).df
    unit = scalar.normalise(tuple(F.col(c) for c in ("vx", "vy", "vz")))
    return shown(df.select(*IJK, *[u.alias(c) for u, c in zip(unit, ("vx", "vy", "vz"))]))


def _pass(table: str, n: int) -> str:
    steps = [stencil.axis(n, -1), stencil.axis(n, 1)]
    return f"(select i, j, k, (value + {' + '.join(stencil.name(o) for o in steps)}) / 3 as value, active from {near(table, steps)} union all select i, j, k, value, active from {table} where not active)"


def _mean(table: str, prefix: str) -> str:
    return f"{prefix}0 as {_pass(table, 0)}, {prefix}1 as {_pass(f'{prefix}0', 1)}, {prefix}2 as {_pass(f'{prefix}1', 2)}"


@query("tools_filter_mean", f"{WITH_CUBE}, {HALF}, {_mean('half_off', 'm')} select i, j, k, {r('value', 4)} as value, active from m2")
def filter_mean(spark, d):
    return shown(stencil.mean(half_off(spark, d)), 4)


@query("tools_filter_gaussian", f"{WITH_CUBE}, {_mean('cube', 'a')}, {_mean('a2', 'b')} select i, j, k, {r('value', 4)} as value, active from b2")
def filter_gaussian(spark, d):
    return shown(stencil.gaussian(tables.cube(spark, d), 1, 2), 4)


@query("tools_filter_median", f"{WITH_CUBE} select i, j, k, list_sort([value, {', '.join(stencil.name(o) for o in stencil.CUBE)}])[14] as value, active from {near('cube', stencil.CUBE)}")
def filter_median(spark, d):
    return stencil.median(tables.cube(spark, d)).df


def _offsets(near_: int) -> str:
    return ", ".join(f"({o[0]}, {o[1]}, {o[2]})" for o in [(0, 0, 0), *stencil.NEAR[near_]])


WITH_EVENTS = f"with {sql.EVENTS}"
for size in (6, 18, 26):
    QUERIES[f"tools_dilate_{size}"] = lambda spark, d, size=size: stencil.dilate(tables.events(spark, d, "click"), size).df
    SQL[f"tools_dilate_{size}"] = f"with {sql.kind('click')}, o(di, dj, dk) as (values {_offsets(size)}), grown as (select distinct cast(i + di as int) i, cast(j + dj as int) j, cast(k + dk as int) k from click, o) select i, j, k, coalesce(value, 0.0) as value, true as active from grown left join click using (i, j, k)"
    QUERIES[f"tools_erode_{size}"] = lambda spark, d, size=size: stencil.erode(tables.cube(spark, d), size).df
    SQL[f"tools_erode_{size}"] = f"{WITH_CUBE}, o(di, dj, dk) as (values {_offsets(size)}), n as (select cast(i + di as int) i, cast(j + dj as int) j, cast(k + dk as int) k, count(*) as n from cube, o group by all) select i, j, k, value, n = {size + 1} as active from cube join n using (i, j, k)"


@query("tools_close", f"with {sql.kind('click')}, o(di, dj, dk) as (values {_offsets(6)}), grown as (select distinct cast(i + di as int) i, cast(j + dj as int) j, cast(k + dk as int) k from click, o), n as (select cast(i + di as int) i, cast(j + dj as int) j, cast(k + dk as int) k, count(*) as n from grown, o group by all) select i, j, k, coalesce(value, 0.0) as value, n = 7 as active from grown join n using (i, j, k) left join click using (i, j, k)")
def close(spark, d):
    return stencil.closed(tables.events(spark, d, "click")).df


@query("tools_surface_mask", f"with {BALL} select i, j, k, 1.0::double as value, active from {near('ball', stencil.FACES, 1.5)} where {' or '.join(f'({stencil.name(o)} < 0) <> (value < 0)' for o in stencil.FACES)}")
def surface_mask(spark, d):
    return stencil.surface_mask(ball(spark, d)).df


# --- reductions --------------------------------------------------------------------------------------------
@query("tools_count", f"{WITH_CUBE}, {HALF} select count(*) filter (where active) as active, count(*) filter (where not active) as inactive, count(distinct case when active then (i >> 3, j >> 3, k >> 3) end) as leaves from half_off")
def count(spark, d):
    return stats.count(half_off(spark, d))


@query("tools_bounds", f"{WITH_EVENTS} select {', '.join(f'{f}({c}) as {f}_{c}' for f in ('min', 'max') for c in 'ijk')} from events_grid where active")
def bounds(spark, d):
    return stats.bounds(tables.events(spark, d))


@query("tools_min_max", f"{WITH_CUBE}, {HALF} select min(value) as least, max(value) as most from half_off where active")
def min_max(spark, d):
    return stats.min_max(half_off(spark, d))


@query("tools_statistics", f"{WITH_CUBE} select count(*) as n, {r('min(value)', 3)} as least, {r('max(value)', 3)} as most, {r('avg(value)', 3)} as mean, {r('var_pop(value)', 1)} as variance, {r('stddev_pop(value)', 3)} as deviation from cube")
def statistics(spark, d):
    s = stats.statistics(tables.cube(spark, d))
    return s.select("n", *[(F.round(c, 1 if c == "variance" else 3) + 0.0).alias(c) for c in s.columns[1:]])


@query("tools_histogram", f"{WITH_CUBE} select cast(least(floor(value * 20 / 400000), 19) as int) as bin, count(*) as n from cube where value between 0 and 400000 group by 1")
def histogram(spark, d):
    return stats.histogram(tables.cube(spark, d), 0.0, 400000.0, 20)


@query("nano_grid_stats", f"{WITH_EVENTS}, l as (select level, bits, cast((i >> bits) << bits as int) as ni, cast((j >> bits) << bits as int) as nj, cast((k >> bits) << bits as int) as nk, value from events_grid, (values (1, 3), (2, 7), (3, 12)) t(level, bits)) select level, ni, nj, nk, cast(count(*) as bigint) as n, min(value) as least, max(value) as most, {r('sum(value)', 3)} as total from l group by all")
def grid_stats(spark, d):
    return shown(stats.nodes(tables.events(spark, d)), 3)


@query("tools_diagnostics", f"{WITH_CUBE} select count(*) filter (where isnan(value)) as n_nan, count(*) filter (where isinf(value)) as n_infinite, count(*) filter (where active and value = 0) as n_background, count(*) filter (where active and not value between 10000 and 90000) as n_outside from cube")
def diagnostics(spark, d):
    return stats.diagnose(tables.cube(spark, d), 10000.0, 90000.0)


@query("tools_inactive_values", f"{WITH_CUBE}, {HALF} select distinct value from half_off where not active order by value limit 50")
def inactive_values(spark, d):
    return stats.inactive_values(half_off(spark, d), 50)


@query("tools_largest_voxels", f"{WITH_CUBE} select i, j, k, value from cube order by value desc, i, j, k limit 10")
def largest(spark, d):
    return stats.largest(tables.cube(spark, d))


DIRAC = "case when abs(value) < 1.5 then (1.0 + cos(value * (3.141592653589793 / 1.5))) / 3 else 0.0 end"


@query("tools_level_set_measure", f"with {BALL} select {r(f'sum(({DIRAC}) * {NORM})', 4)} as area, {r(f'sum(({DIRAC}) * (i * ({diff(0)}) + j * ({diff(1)}) + k * ({diff(2)}))) / 3', 4)} as volume from {near('ball', stencil.FACES, 1.5)}")
def measure(spark, d):
    return shown(stats.measure(ball(spark, d)), 4)


@query("tools_op_statistics", f"with {BALL}, n as (select {NORM} as value from {near('ball', stencil.FACES, 1.5)}) select {r('avg(value)')} as mean, {r('max(abs(value - 1))')} as most from n")
def steepness(spark, d):
    return shown(levelset.steepness(ball(spark, d)))


# --- samples -----------------------------------------------------------------------------------------------
WITH_POINTS = f"with {sql.VECTORS}"
ASKED = "asked as (select id, px * 0.5 + 25 as x, py * 0.1 + 5 as y, pz * 0.1 + 4 as z from vectors)"


def asked(spark, d) -> DataFrame:
    return tables.vectors(spark, d).select("id", (F.col("px") * 0.5 + 25).alias("x"), (F.col("py") * 0.1 + 5).alias("y"), (F.col("pz") * 0.1 + 4).alias("z"))


@query("tools_point_sampler", f"{WITH_POINTS}, {sql.CUBE}, {ASKED} select id, coalesce(value, 0.0) as value, coalesce(active, false) as active from asked left join cube on i = floor(x + 0.5) and j = floor(y + 0.5) and k = floor(z + 0.5)")
def point_sampler(spark, d):
    return sample.nearest(tables.cube(spark, d), asked(spark, d))


def _weighted(offsets, weights: dict[int, str], shift: str = "") -> str:
    w = " * ".join(f"(case d{c} {' '.join(f'when {n} then {e.format(f"({a} - floor({a}))")}' for n, e in weights.items())} end)" for c, a in zip("ijk", "xyz"))
    on = " and ".join(f"g.{c} = floor({a}) + d{c}" for c, a in zip("ijk", "xyz"))
    return f"o(di, dj, dk) as (values {', '.join(map(str, offsets))}) select id, {r(f'sum({w} * coalesce(g.value, 0.0))', 3)} as value, coalesce(bool_or(g.active), false) as active from asked cross join o left join cube g on {on} group by id"


@query("tools_box_sampler", f"{WITH_POINTS}, {sql.CUBE}, {ASKED}, {_weighted(product((0, 1), repeat=3), {0: '(1 - {0})', 1: '{0}'})}")
def box_sampler(spark, d):
    return shown(sample.trilinear(tables.cube(spark, d), asked(spark, d)), 3)


@query("tools_quadratic_sampler", f"{WITH_POINTS}, {sql.CUBE}, {ASKED}, {_weighted(product((-1, 0, 1), repeat=3), {-1: '({0} * ({0} - 1) / 2)', 0: '(1 - {0} * {0})', 1: '({0} * ({0} + 1) / 2)'})}")
def quadratic_sampler(spark, d):
    return shown(sample.quadratic(tables.cube(spark, d), asked(spark, d)), 3)


def _shifted(n: int) -> str:
    return ", ".join(f"{a} + {0.5 if m == n else 0.0} as {a}" for m, a in enumerate("xyz"))


STAGGERED = ", ".join(
    f"at{n} as (select id, {_shifted(n)} from asked), s{n} as (select id, value as v{a} from (with {_weighted(product((0, 1), repeat=3), {0: '(1 - {0})', 1: '{0}'}).replace('from asked cross join o left join cube g', f'from at{n} cross join o left join {t} g')}))"
    for n, (a, t) in enumerate(zip("xyz", ("cube", "a", "r")))
)


@query("tools_staggered_sampler", f"{WITH_POINTS}, {sql.CUBE}, {sql.flag('A')}, {sql.flag('R')}, {ASKED}, {STAGGERED} select * from s0 join s1 using (id) join s2 using (id)")
def staggered_sampler(spark, d):
    return shown(sample.staggered({"x": tables.cube(spark, d), "y": tables.by_flag(spark, d, "A"), "z": tables.by_flag(spark, d, "R")}, asked(spark, d)), 3)


@query("tools_resample", f"{WITH_CUBE} select cast(floor(i / 2.0) as int) as i, cast(floor(j / 2.0) as int) as j, cast(floor(k / 2.0) as int) as k, {r('coalesce(max(case when i % 2 = 0 and j % 2 = 0 and k % 2 = 0 then value end), 0.0)')} as value, true as active from cube group by 1, 2, 3")
def resample(spark, d):
    return shown(sample.resample(tables.cube(spark, d), 2))


# --- tiles, pyramids, segments -----------------------------------------------------------------------------
@query("tools_prune", f"with blocks as (select cast(a.range as int) i, cast(b.range as int) j, cast(c.range as int) k, case when a.range < 16 then 2.5::double else cast(a.range as double) end as value, true as active from range(24) a, range(8) b, range(12) c), n as (select *, i >> 3 a, j >> 3 b, k >> 3 c from blocks), t as (select a, b, c, count(*) = 512 and max(value) = min(value) as tile, median(value) as m from n group by a, b, c) select cast(a * 8 as int) as i, cast(b * 8 as int) as j, cast(c * 8 as int) as k, 1 as level, m as value, true as active from t where tile union all select i, j, k, 0, value, active from n join t using (a, b, c) where not tile")
def prune(spark, d):
    return tree.prune(blocks(spark))


def blocks(spark) -> Grid:
    rows = spark.range(24 * 8 * 12).select(F.expr("cast(id div 96 as int)").alias("i"), F.expr("cast(id div 12 % 8 as int)").alias("j"), F.expr("cast(id % 12 as int)").alias("k"))
    return Grid(rows.select(*IJK, F.when(F.col("i") < 16, 2.5).otherwise(F.col("i").cast("double")).alias("value"), F.lit(True).alias("active")), 0.0)


@query("tree_voxelize", "select cast(a.range as int) i, cast(b.range as int) j, cast(c.range as int) k, case when a.range < 16 then 2.5::double else cast(a.range as double) end as value, true as active from range(24) a, range(8) b, range(12) c")
def voxelize(spark, d):
    return tree.voxelize(tree.prune(blocks(spark))).df


@query("tools_multires_restrict", f"{WITH_CUBE}, e as (select * from cube where i % 2 = 0 and j % 2 = 0 and k % 2 = 0) select cast(i // 2 as int) as i, cast(j // 2 as int) as j, cast(k // 2 as int) as k, {r('(' + ' + '.join(f'{8 // 2 ** sum(map(abs, o))} * {stencil.name(o)}' for o in stencil.CUBE) + ' + 8 * value) / 64', 8)} as value, true as active from {near('cube', stencil.CUBE)} where i % 2 = 0 and j % 2 = 0 and k % 2 = 0")
def restrict(spark, d):
    return shown(tree.coarser(tables.cube(spark, d)), 8)


@query("tools_multires_prolong", f"{WITH_CUBE}, o(di, dj, dk) as (values {_offsets(26)}) select cast(2 * i + di as int) as i, cast(2 * j + dj as int) as j, cast(2 * k + dk as int) as k, {r('sum(value * pow(0.5, abs(di) + abs(dj) + abs(dk)))')} as value, true as active from cube, o group by 1, 2, 3")
def prolong(spark, d):
    return shown(tree.finer(tables.cube(spark, d)))


@query("tools_segmentation", f"with recursive {sql.kind('click')}, o(di, dj, dk) as (values {', '.join(map(str, stencil.FACES))}), reach as (select i, j, k, i as si, j as sj, k as sk from click union select g.i, g.j, g.k, r.si, r.sj, r.sk from reach r, o, click g where g.i = r.i + di and g.j = r.j + dj and g.k = r.k + dk), s as (select i, j, k, min((si, sj, sk)) as s from reach group by all) select i, j, k, s[1] as si, s[2] as sj, s[3] as sk, count(*) over (partition by s) as n from s")
def segmentation(spark, d):
    return tree.segments(tables.events(spark, d, "click"))


@query("tools_signed_flood_fill", f"{WITH_CUBE}, {HALF}, s3 as (select i, j, k, case when active then value - 60000 else value end as value, active, case when active then sign(value - 60000) end as sg from half_off), " + ", ".join(f"s{n} as (select i, j, k, value, active, coalesce(last_value(sg ignore nulls) over (partition by {', '.join(c for c in IJK if c != IJK[n])} order by {IJK[n]} rows between unbounded preceding and current row), first_value(sg ignore nulls) over (partition by {', '.join(c for c in IJK if c != IJK[n])} order by {IJK[n]} rows between current row and unbounded following)) as sg from s{n + 1})" for n in (2, 1, 0)) + f" select i, j, k, {r('case when active then value else abs(value) * case when coalesce(sg, 1) < 0 then -1.0 else 1.0 end end')} as value, active from s0")
def signed_flood_fill(spark, d):
    return shown(tree.flood_signs(half_off(spark, d).map(F.col("value") - 60000)))


@query("tools_volume_to_faces", f"with {sql.kind('click')}, o(di, dj, dk) as (values {', '.join(map(str, stencil.FACES))}) select i, j, k, case when di <> 0 then 0 when dj <> 0 then 1 else 2 end as axis, di + dj + dk as side from click g, o where not exists (select 1 from click b where b.i = g.i + di and b.j = g.j + dj and b.k = g.k + dk)")
def volume_to_faces(spark, d):
    return tree.faces(tables.events(spark, d, "click"))


# --- level sets --------------------------------------------------------------------------------------------
@query("tools_level_set_sphere", f"with {sql.sphere(24, (11.8, 12.2, 11.7), 7.3, 3.0)} select i, j, k, {r('value')} as value, active from ball")
def level_set_sphere(spark, d):
    return shown(levelset.sphere(spark, 24, (11.8, 12.2, 11.7), 7.3))


Q = [f"(abs({c} - 12.0) - 6.5)" for c in "ijk"]


@query("tools_level_set_cube", f"with c as (select i, j, k, sqrt({' + '.join(f'greatest({q}, 0.0) * greatest({q}, 0.0)' for q in Q)}) + least(greatest({', '.join(Q)}), 0.0) as value from {sql.axes(25)}) select i, j, k, {r('value')} as value, true as active from c where abs(value) < 3.0")
def level_set_cube(spark, d):
    return shown(levelset.cube(spark, 25, 5.5, 18.5))


@query("tools_level_set_torus", f"with f as (select i, j, k, sqrt((i - 15.2) * (i - 15.2) + (j - 15.2) * (j - 15.2)) - 9.0 as f from {sql.axes(31)}), t as (select i, j, k, sqrt(f * f + (k - 15.2) * (k - 15.2)) - 3.4 as value from f) select i, j, k, {r('value')} as value, true as active from t where abs(value) < 3.0")
def level_set_torus(spark, d):
    return shown(levelset.torus(spark, 31, 15.2, 9.0, 3.4))


@query("tools_sdf_to_fog", f"with {BALL} select i, j, k, {r('least(value / -1.25, 1.0)')} as value, true as active from ball where value < 0")
def sdf_to_fog(spark, d):
    return shown(levelset.fog(ball(spark, d), 1.25))


@query("tools_interior_mask", f"with {BALL} select i, j, k, 1.0::double as value, true as active from ball where value < 0.5")
def interior_mask(spark, d):
    return levelset.interior(ball(spark, d), 0.5).df


@query("tools_level_set_offset", f"with {BALL} select i, j, k, {r('value - 0.75')} as value, active from ball")
def level_set_offset(spark, d):
    return shown(levelset.offset(ball(spark, d), 0.75))


@query("tools_level_set_laplacian_flow", f"with {BALL}, a as (select i, j, k, value + (({FACES_SUM}) - value * 6) * (1.0 / 6) as value, active from {near('ball', stencil.FACES, 1.5)}) select i, j, k, {r(f'value + (({FACES_SUM}) - value * 6) * (1.0 / 6)')} as value, active from {near('a', stencil.FACES, 1.5)}")
def laplacian_flow(spark, d):
    return shown(levelset.laplacian_flow(ball(spark, d), 2))


@query("tools_level_set_curvature_flow", f"with {BALL}, {BENT} select i, j, k, {r('value + bend * sqrt(s) * 0.25')} as value, active from bent")
def curvature_flow(spark, d):
    return shown(levelset.curvature_flow(ball(spark, d)))


def _jacobi(table: str) -> str:
    return f"(select i, j, k, (({FACES_SUM}) - f) / 6 as value, n.active from {near(table, stencil.FACES)} n join (select i, j, k, value as f from cube) using (i, j, k))"


@query("tools_poisson_jacobi", f"{WITH_CUBE}, x0 as (select i, j, k, 0.0::double as value, active from cube), " + ", ".join(f"x{n} as {_jacobi(f'x{n - 1}')}" for n in range(1, 5)) + f" select i, j, k, {r('value', 3)} as value, active from x4")
def poisson(spark, d):
    return shown(levelset.poisson(tables.cube(spark, d), 4), 3)


@query("tools_poisson_solve")
def poisson_solve(spark, d):
    return shown(levelset.poisson_solved(tables.cube(spark, d)), 2)


@query("tools_fast_sweeping", f"with recursive {sql.CUBE}, o(di, dj, dk) as (values {', '.join(map(str, stencil.FACES))}), walk as (select i, j, k, 0 as n from cube where i = 25 and j = 5 and k = 4 union select g.i, g.j, g.k, w.n + 1 from walk w, o, cube g where w.n < 80 and g.i = w.i + di and g.j = w.j + dj and g.k = w.k + dk) select i, j, k, cast(coalesce(min(n), 1000000000) as double) as value, true as active from cube left join walk using (i, j, k) group by i, j, k")
def fast_sweeping(spark, d):
    g = tables.cube(spark, d)
    return levelset.distances(combine.clip_box(g, (25, 5, 4), (25, 5, 4)), g).df


ADVECTED = "asked as (select (i, j, k) as id, i - 0.5 as x, j - 0.25 as y, k + 0.5 as z from cube)"


@query("tools_volume_advect", f"{WITH_CUBE}, {ADVECTED}, s as (select * from (with {_weighted(product((0, 1), repeat=3), {0: '(1 - {0})', 1: '{0}'})})) select id[1] as i, id[2] as j, id[3] as k, value, true as active from s")
def volume_advect(spark, d):
    return shown(levelset.advect(tables.cube(spark, d), (1.0, 0.5, -1.0), 0.5), 3)


@query("math_ray_first_hit", f"{WITH_EVENTS} select i, j, min(k) as hit, arg_min(value, k) as value from events_grid group by i, j")
def ray_first_hit(spark, d):
    return levelset.first_hits(tables.events(spark, d))


# --- points ------------------------------------------------------------------------------------------------
WITH_VECTORS = f"with {sql.VECTORS}, {sql.LOCATED.format('vectors')}"
WITH_ITEMS = f"with {sql.ITEMS}, {sql.LOCATED.format('items')}"


@query("points_convert", f"{WITH_VECTORS} select id, label, i, j, k, {r('px')} as px, {r('py')} as py, {r('pz')} as pz, {r('px - i')} as oi, {r('py - j')} as oj, {r('pz - k')} as ok from located")
def points_convert(spark, d):
    return shown(points.located(tables.vectors(spark, d)))


@query("points_count", f"{WITH_ITEMS} select i, j, k, cast(count(*) as double) as value, true as active from located group by i, j, k")
def points_count(spark, d):
    return points.count(tables.items(spark, d)).df


@query("points_mask", f"{WITH_ITEMS} select distinct i, j, k, 1.0::double as value, true as active from located")
def points_mask(spark, d):
    return points.mask(tables.items(spark, d)).df


@query("points_offsets", f"{WITH_ITEMS}, n as (select i, j, k, count(*) as n from located group by all) select i, j, k, n, cast(sum(n) over (partition by i >> 3, j >> 3, k >> 3 order by i, j, k) as bigint) as end from n")
def points_offsets(spark, d):
    return points.offsets(tables.items(spark, d))


def grouped(spark, d) -> DataFrame:
    return points.grouped(tables.items(spark, d), returned=F.col("flag") == "R", open=F.col("status") == "O", cheap=F.col("py") < 20)


@query("points_group_sizes", f"{WITH_ITEMS} select count(*) filter (where flag = 'R') as returned, count(*) filter (where status = 'O') as open, count(*) filter (where py < 20) as cheap from items")
def points_group_sizes(spark, d):
    return points.group_sizes(grouped(spark, d))


@query("points_group_filter", f"{WITH_ITEMS} select id from items where (flag = 'R' or status = 'O') and not py < 20")
def points_group_filter(spark, d):
    return points.in_groups(grouped(spark, d), ["returned", "open"], ["cheap"]).select("id")


@query("points_box_filter", f"{WITH_ITEMS} select id from items where px between 10 and 20 and py between 5 and 30 and pz between 1 and 4")
def points_box_filter(spark, d):
    return points.in_box(tables.items(spark, d), (10.0, 5.0, 1.0), (20.0, 30.0, 4.0)).select("id")


@query("points_mask_filter", f"{WITH_VECTORS}, {sql.CUBE} select id from located p where exists (select 1 from cube g where g.i = p.i and g.j = p.j and g.k = p.k)")
def points_mask_filter(spark, d):
    return points.in_mask(tables.vectors(spark, d), tables.cube(spark, d)).select("id")


BALL_AT_0 = sql.sphere(24, (0.0, 0.0, 0.0), 9.0, 3.0)


@query("points_level_set_filter", f"{WITH_POINTS}, {BALL_AT_0}, asked as (select id, px as x, py as y, pz as z from vectors), cube as (select i, j, k, value - 3.0 as value, active from ball), s as (select id, value + 3.0 as d from (with {_weighted(product((0, 1), repeat=3), {0: '(1 - {0})', 1: '{0}'})})) select id from s where d > -1.0001 and d < 2.0001")
def points_level_set_filter(spark, d):
    return points.in_level_set(tables.vectors(spark, d), levelset.sphere(spark, 24, (0.0, 0.0, 0.0), 9.0), -1.0001, 2.0001).select("id")


@query("points_random_leaf_filter", f"{WITH_ITEMS} select id from (select id, row_number() over (partition by i >> 3, j >> 3, k >> 3 order by (id * 2654435761 + 5) % 4294967296, id) as r from located) where r <= 3")
def points_random_leaf_filter(spark, d):
    return points.per_leaf(tables.items(spark, d), 3, 5).select("id")


@query("points_statistics", f"{WITH_ITEMS} select flag, count(discount) as n, min(discount) as least, max(discount) as most, {r('avg(discount)')} as mean, {r('var_pop(discount)')} as variance from items group by flag")
def points_statistics(spark, d):
    return shown(points.attribute_statistics(tables.items(spark, d), "discount", ["flag"]))


PAIRS = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]


@query("points_pca_covariance", f"{WITH_VECTORS} select {', '.join(f'{r(f"avg(p{a})", 4)} as m{a}' for a in 'xyz')}, {', '.join(f'{r(f"covar_pop(p{a}, p{b})", 4)} as c{a}{b}' for a, b in PAIRS)} from vectors")
def points_pca(spark, d):
    return shown(points.centre(tables.vectors(spark, d)), 4)


def _raster(value: str) -> str:
    w = " * ".join(f"(case d{c} when 0 then 1 - (p{a} - floor(p{a})) else p{a} - floor(p{a}) end)" for c, a in zip("ijk", "xyz"))
    at = ", ".join(f"cast(floor(p{a}) + d{c} as int) as {c}" for c, a in zip("ijk", "xyz"))
    return f"o(di, dj, dk) as (values {', '.join(map(str, product((0, 1), repeat=3)))}), w as (select {at}, {w} as w, label as v from vectors, o) select i, j, k, {r(value)} as value, true as active from w where w > 0 group by i, j, k"


@query("points_rasterize_mean", f"{WITH_VECTORS}, {_raster('sum(w * v) / sum(w)')}")
def points_rasterize_mean(spark, d):
    return shown(points.raster(tables.vectors(spark, d), "label"))


@query("points_rasterize_sum", f"{WITH_VECTORS}, {_raster('sum(w * v)')}")
def points_rasterize_sum(spark, d):
    return shown(points.raster(tables.vectors(spark, d), "label", False))


@query("points_sample", f"{WITH_POINTS}, {sql.CUBE}, asked as (select id, px as x, py as y, pz as z from vectors), s as (select * from (with {_weighted(product((0, 1), repeat=3), {0: '(1 - {0})', 1: '{0}'})})) select id, value as price from s")
def points_sample(spark, d):
    return shown(points.sampled(tables.vectors(spark, d), tables.cube(spark, d), "price").select("id", "price"), 3)


DISTANCE = "sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) + (a.pz - b.pz) * (a.pz - b.pz))"


@query("points_radius_search", f"{WITH_VECTORS} select a.id, b.id as other, {r(DISTANCE)} as distance from vectors a, vectors b where a.id % 50 = 0 and a.id <> b.id and {DISTANCE} <= 4.0")
def points_radius_search(spark, d):
    p = tables.vectors(spark, d)
    return shown(points.within(p, p.where("id % 50 = 0"), 4.0).where("id <> other"))


OTHERS = f"p as (select a.id, b.id as other, {DISTANCE} as distance from vectors a, vectors b where a.id % 50 = 0 and a.id <> b.id)"


@query("points_closest", f"{WITH_VECTORS}, {OTHERS} select id, other, {r('distance')} as distance from p qualify row_number() over (partition by id order by distance, other) = 1")
def points_closest(spark, d):
    p = tables.vectors(spark, d)
    return shown(points.nearest_others(p, p.where("id % 50 = 0"), 1, 4.0).drop("place"))


@query("points_move", f"{WITH_VECTORS} select id, label, {r('px + 1.5')} as px, {r('py - 0.25')} as py, {r('pz + 4.0')} as pz from vectors")
def points_move(spark, d):
    return shown(points.moved(tables.vectors(spark, d), (1.5, -0.25, 4.0)))


@query("points_advect", f"{WITH_VECTOR}, {sql.VECTORS}, {sql.LOCATED.format('vectors')} select id, label, {', '.join(f'{r(f"p{a} + coalesce(v{a}, 0.0) * 0.1")} as p{a}' for a in 'xyz')} from located left join v using (i, j, k)")
def points_advect(spark, d):
    return shown(points.carried(tables.vectors(spark, d), vector(spark, d), ("vx", "vy", "vz"), 0.1))


@query("points_replicate", f"{WITH_VECTORS} select id * 3 + n as id, label, {r('px + cos(n * 2.399963) * 0.2 * n')} as px, {r('py + sin(n * 2.399963) * 0.2 * n')} as py, {r('pz')} as pz from vectors, (values (0), (1), (2)) t(n)")
def points_replicate(spark, d):
    return shown(points.replicated(tables.vectors(spark, d), 3, 0.2))


def _draw(n: int) -> str:
    return f"(cast('0x' || substr(md5(concat_ws(':', 1, i, j, k, n, {n})), 1, 8) as bigint) / 4294967296.0::double - 0.5)"


@query("points_scatter", f"{WITH_CUBE}, n as (select i, j, k, cast(range as int) as n from cube, range(4)) select i, j, k, n, " + ", ".join(f"{r(f'{c} + {_draw(m)}')} as p{a}" for m, (c, a) in enumerate(zip(IJK, "xyz"))) + " from n")
def points_scatter(spark, d):
    return shown(points.scattered(tables.cube(spark, d), 4))


# --- functions ---------------------------------------------------------------------------------------------
T = "(select l_orderkey * 8 + l_linenumber as id, l_extendedprice as x, l_discount as y, l_tax as z, l_quantity as q, l_suppkey as s from lineitem)"


def row(spark, d) -> DataFrame:
    return tables.read(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"), F.col("l_quantity").alias("q"), F.col("l_suppkey").alias("s"))


@query(
    "ax_scalar_functions",
    f"""select id, {r('least(greatest(x, 5000.0), 30000.0)')} as clamp, {r('y + (z - y) * q')} as lerp, {r('(least(greatest((q - 5.0) / 40.0, 0.0), 1.0) * least(greatest((q - 5.0) / 40.0, 0.0), 1.0)) * (3.0 - least(greatest((q - 5.0) / 40.0, 0.0), 1.0) * 2)')} as smoothstep,
    {r('(least(greatest(q, 10.0), 40.0) - 10.0) / 30.0 * 4 - 2')} as fit, {r('(q - 25) - 7.0 * floor((q - 25) / 7.0)')} as floormod, cast(sign(q - 25) as int) as sign, {r('case when y = 0 then 0.0 else x / y end')} as divided, {r('cbrt(x)')} as cbrt,
    {r('sin(q)')} as sin, {r('atan2(y, q)')} as atan2, {r('exp(-q)')} as exp, {r('ln(x)')} as log, {r('pow(q, 1.5)')} as pow, {r('tanh(q - 25)')} as tanh, {r('q * (180 / 3.141592653589793)')} as degrees, {r('floor(least(greatest(y, 0.0), 0.1) / 0.1 * 255 + 0.5) / 255 * 0.1')} as quantised from {T}""",
)
def ax_scalar(spark, d):
    q, x, y, z = (F.col(c) for c in "qxyz")
    return shown(
        row(spark, d).select(
            "id", scalar.clamp(x, 5000.0, 30000.0).alias("clamp"), scalar.lerp(y, z, q).alias("lerp"), scalar.smoothstep(q, 5.0, 45.0).alias("smoothstep"), scalar.fit(q, 10.0, 40.0, -2.0, 2.0).alias("fit"), scalar.floored_mod(q - 25, F.lit(7.0)).alias("floormod"),
            scalar.sign(q - 25).alias("sign"), scalar.safe_divide(x, y).alias("divided"), scalar.cbrt(x).alias("cbrt"), F.sin(q).alias("sin"), F.atan2(y, q).alias("atan2"), F.exp(-q).alias("exp"), F.ln(x).alias("log"), F.pow(q, F.lit(1.5)).alias("pow"), F.tanh(q - 25).alias("tanh"),
            scalar.to_degrees(q).alias("degrees"), scalar.quantised(y, 0.0, 0.1, 8).alias("quantised"),
        )
    )


@query("ax_vector_functions", f"select id, {r('x * q + y * s + z * 2.0', 4)} as dot, {r('y * 2.0 - z * s')} as cx, {r('z * q - x * 2.0', 4)} as cy, {r('x * s - y * q', 4)} as cz, {r('sqrt(x * x + y * y + z * z)')} as length, {r('case when x * x + y * y + z * z = 0 then x else x / sqrt(x * x + y * y + z * z) end')} as nx from {T}")
def ax_vector(spark, d):
    a, b = (F.col("x"), F.col("y"), F.col("z")), (F.col("q"), F.col("s").cast("double"), F.lit(2.0))
    c = scalar.cross(a, b)
    df = row(spark, d).select("id", scalar.dot(a, b).alias("dot"), c[0].alias("cx"), c[1].alias("cy"), c[2].alias("cz"), scalar.length(a).alias("length"), scalar.normalise(a)[0].alias("nx"))
    return df.select("id", *[(F.round(n, 6 if n in ("cx", "length", "nx") else 4) + 0.0).alias(n) for n in df.columns[1:]])


M = ["q", "y", "z", "1.0", "q + 1", "2.0", "y", "0.5", "q"]


@query("ax_matrix_functions", f"with m as (select id, x, y as y0, z as z0, {', '.join(f'{e} as m{n}' for n, e in enumerate(M))} from {T}) select id, {r('m0 * (m4 * m8 - m5 * m7) - m1 * (m3 * m8 - m5 * m6) + m2 * (m3 * m7 - m4 * m6)')} as determinant, {r('m0 + m4 + m8')} as trace, {', '.join(f'{r(f"m{3 * n} * x + m{3 * n + 1} * y0 + m{3 * n + 2} * z0", 4)} as t{n}' for n in range(3))}, {r('m0 * m0 + m1 * m1 + m2 * m2')} as p0, {r('m0 * m6 + m1 * m7 + m2 * m8')} as p2 from m")
def ax_matrix(spark, d):
    m = [F.expr(e).cast("double") for e in M]
    t = scalar.transform(m, (F.col("x"), F.col("y"), F.col("z")))
    p = scalar.multiply(m, scalar.transpose(m))
    df = row(spark, d).select("id", scalar.determinant(m).alias("determinant"), scalar.trace(m).alias("trace"), *[c.alias(f"t{n}") for n, c in enumerate(t)], p[0].alias("p0"), p[2].alias("p2"))
    return df.select("id", *[(F.round(n, 4 if n[0] == "t" and n != "trace" else 6) + 0.0).alias(n) for n in df.columns[1:]])


@query("ax_colour_round_trip", f"select id, {r('z * 10')} as r, {r('q / 50')} as g, {r('y * 10')} as b, {r('greatest(z * 10, q / 50, y * 10)')} as v from {T}")
def ax_colour(spark, d):
    r_, g, b = F.col("z") * 10, F.col("q") / 50, F.col("y") * 10
    h, s, v = scalar.hsv(r_, g, b)
    back = scalar.rgb(F.col("h"), F.col("s"), F.col("v"))
    return shown(row(spark, d).select("id", h.alias("h"), s.alias("s"), v.alias("v")).select("id", *[c.alias(n) for n, c in zip("rgb", back)], "v"))


MORTON = " | ".join(f"((({c} >> {b}) & 1) << {3 * b + n})" for b in range(6) for n, c in enumerate("ijk"))


@query("math_morton_order", f"{WITH_CUBE} select i, j, k, cast({MORTON} as bigint) as code from (select cast(i as bigint) i, cast(j as bigint) j, cast(k as bigint) k from cube)")
def morton(spark, d):
    return tables.cube(spark, d).df.select(*IJK, scalar.morton(F.col("i"), F.col("j"), F.col("k"), 6).alias("code"))


@query("ax_string_functions", "select o_orderkey, cast(length(o_orderpriority) as int) as n, o_orderstatus || '-' || o_orderpriority as joined, cast(coalesce(nullif(regexp_extract(o_orderpriority, '^\\s*([+-]?\\d+)', 1), ''), '0') as bigint) as number from orders")
def ax_strings(spark, d):
    return tables.read(spark, d, "orders").select("o_orderkey", F.length("o_orderpriority").alias("n"), F.concat("o_orderstatus", F.lit("-"), "o_orderpriority").alias("joined"), scalar.number(F.col("o_orderpriority")).alias("number"))


# --- streams, and the flagship -----------------------------------------------------------------------------
@query("stream_windowed_voxels", "select date_trunc('day', ts) as start, cast(user_id as int) as i, cast(hour(ts) as int) as k, count(*) as n, cast(sum(cast(floor(value * 100 + 0.5) as bigint)) as double) / 100 as value from events group by all")
def windowed_voxels(spark, d):
    return voxels.windowed(tables.read(spark, d, "events"))


@query("flagship", f"{WITH_AR}, s as (select i, j, k, a + b as value, on_a or on_b as active from {paired('a', 'r')}) select i, j, k, {r(NORM, 3)} as value from {near('s', stencil.FACES)} order by {NORM} desc, i, j, k limit 50")
def flagship(spark, d):
    """Two grids summed, and the steepest voxels of the sum."""
    summed = combine.add(tables.by_flag(spark, d, "A"), tables.by_flag(spark, d, "R"))
    return shown(stats.largest(stencil.norm(summed), 50), 3)
