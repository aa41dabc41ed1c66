"""Queries of bands that move, checks, merged solids, closed meshes, views and larger matrices, with their SQL."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.model import IJK, Grid
from gridloom.operators import combine, levelset, points, stats, stencil, surface
from gridloom.plans import sql
from gridloom.plans.further import _boxes, _field
from gridloom.plans.motion import _slope
from gridloom.plans.queries import ALL_KINDS, BALL, KINDS, NORM, SQL, QUERIES, T, WITH_CUBE, WITH_ITEMS, WITH_KINDS, WITH_VECTORS, _weighted, ball, query, row, shown
from gridloom.plans.sql import near, r
from gridloom.sources import tables

NEAR = near("ball", stencil.FACES, 1.5)

# --- bands -------------------------------------------------------------------------------------------------
NORMAL = f"value - value / sqrt(value * value + 1.0) * ({_slope('value > 0')} - 1.0) * 0.3"


@query("tools_level_set_trim", f"with {BALL} select i, j, k, {r('value')} as value, active from ball where abs(value) < 1.25")
def trim(spark, d):
    return shown(levelset.trimmed(ball(spark, d), 1.25))


@query("tools_level_set_track", f"with {BALL}, n as (select i, j, k, {NORMAL} as value, active from {NEAR}) select i, j, k, {r('value')} as value, active from n where abs(value) < 1.25")
def track(spark, d):
    return shown(levelset.tracked(ball(spark, d), 1.25))


def _upwind(n: int) -> str:
    ahead, back = stencil.name(stencil.axis(n)), stencil.name(stencil.axis(n, -1))
    u = _field(n, *[f"({c} / 50.0::double)" for c in IJK])
    return f"greatest({u}, 0.0) * (value - {back}) + least({u}, 0.0) * ({ahead} - value)"


@query("tools_level_set_advect", f"with {BALL} select i, j, k, {r(f'value - ({" + ".join(_upwind(n) for n in range(3))}) * 0.25')} as value, active from {NEAR}")
def level_set_advect(spark, d):
    return shown(levelset.flowed(ball(spark, d), lambda *at: points.enright(*[c / 50.0 for c in at]), 0.25))


#: Every seventh slice steeper, every eleventh inactive.
SPOILT = "spoilt as (select i, j, k, case when i % 7 = 0 then value * 1.5 else value end as value, i % 11 <> 0 as active from ball)"
CHECKED = f"(select * from (select *, {NORM} as steep from {near('spoilt_on', stencil.FACES, chr(39) + 'nan' + chr(39) + '::double')}) where not isnan(steep))"


def spoilt(spark, d) -> Grid:
    g = ball(spark, d)
    return g.with_df(g.df.withColumn("value", F.when(F.col("i") % 7 == 0, F.col("value") * 1.5).otherwise(F.col("value"))).withColumn("active", F.col("i") % 11 != 0))


@query("tools_check_level_set", f"with {BALL}, {SPOILT}, spoilt_on as (select * from spoilt where active) select count(*) filter (where isnan(value) or isinf(value)) as n_not_finite, count(*) filter (where active and abs(value) >= 1.5) as n_beyond, count(*) filter (where not active and abs(value) <> 1.5) as n_off_background, (select count(*) from {CHECKED} where abs(steep - 1) > 0.25) as n_slope from spoilt")
def check_level_set(spark, d):
    return stats.check_level_set(spoilt(spark, d))


@query("tools_check_fog", f"with {BALL}, {SPOILT} select count(*) filter (where isnan(value) or isinf(value)) as n_not_finite, count(*) filter (where value < 0 or value > 1) as n_outside, count(*) filter (where not active and value <> 0) as n_off_background from spoilt")
def check_fog(spark, d):
    return stats.check_fog(spoilt(spark, d))


SKIN = f"skin as (select i, j, k from {NEAR} where {' or '.join(f'({stencil.name(o)} < 0) <> (value < 0)' for o in stencil.FACES)})"
WIDE = ", ".join(str((*o, sum(x * x for x in o))) for o in product(range(-2, 3), repeat=3) if sum(x * x for x in o) <= 4)


@query("tools_sdf_extension", f"with {BALL}, {SKIN}, o(di, dj, dk, d) as (values {WIDE}), m as (select i + di as vi, j + dj as vj, k + dk as vk, min((d, i, j, k)) as best from skin, o group by 1, 2, 3) select b.i, b.j, b.k, cast(best[2] + best[3] * 2 + best[4] * 3 as double) as value, {r('sqrt(cast(best[1] as double))')} as away from m join ball b on b.i = vi and b.j = vj and b.k = vk")
def extension(spark, d):
    g = ball(spark, d)
    return shown(surface.extended(g, g.map((F.col("i") + F.col("j") * 2 + F.col("k") * 3).cast("double")), 2))


# --- many solids -------------------------------------------------------------------------------------------
for kind, (fold, sign) in {"union": ("min", "1"), "intersection": ("max", "1"), "difference": ("max", "case when n = 0 then 1 else -1 end")}.items():
    state = "not active" if kind == "union" else "active"
    QUERIES[f"tools_merge_csg_{kind}"] = lambda spark, d, kind=kind: shown(combine.merge_csg([Grid(tables.events(spark, d, e).df, 40.0) for e in KINDS], kind), 4)
    SQL[f"tools_merge_csg_{kind}"] = (
        f"{WITH_KINDS}, every as (select i, j, k, n, coalesce(value, 40.0) * ({sign}) as value, coalesce(active, false) as active from (select distinct i, j, k from ({ALL_KINDS})) cross join (select cast(range as int) as n from range({len(KINDS)})) left join ({ALL_KINDS}) using (i, j, k, n)), "
        f"best as (select i, j, k, {fold}((value, {state})) as best from every group by i, j, k) select i, j, k, {r('best[1]', 4)} as value, {'not ' if kind == 'union' else ''}best[2] as active from best"
    )


# --- closed meshes -----------------------------------------------------------------------------------------
#: Eight triangles of an octahedron around each vector, seen from outside.
SIGNS = list(product((-1.0, 1.0), repeat=3))
TRIANGLES = "triangles as (select px + sx * 1.6 as ax, py as ay, pz as az, case when t > 0 then px else px end as ex, case when t > 0 then py + sy * 1.6 else py end as ey, case when t > 0 then pz else pz + sz * 1.6 end as ez, px as cx, case when t > 0 then py else py + sy * 1.6 end as cy, case when t > 0 then pz + sz * 1.6 else pz end as cz from (select *, sx * sy * sz as t from vectors, (values {0}) s(sx, sy, sz)))".format(
    ", ".join(f"({a}::double, {b}::double, {c}::double)" for a, b, c in SIGNS)
)


def _side(p: str, q: str) -> str:
    lx, ly, hx, hy = (f"case when {p}y <= {q}y then {a} else {b} end" for a, b in ((p + "x", q + "x"), (p + "y", q + "y"), (q + "x", p + "x"), (q + "y", p + "y")))
    return f"(case when ({ly}) <= j and ({hy}) > j and ({lx}) + (j - ({ly})) / (({hy}) - ({ly})) * (({hx}) - ({lx})) > i then 1 else 0 end)"


LINES = "(select *, unnest(range(cast(floor(least(ay, ey, cy)) as int), cast(ceil(greatest(ay, ey, cy)) as int) + 1)) as j from (select *, unnest(range(cast(floor(least(ax, ex, cx)) as int), cast(ceil(greatest(ax, ex, cx)) as int) + 1)) as i from triangles))"
AREA = "((ex - ax) * (cy - ay) - (ey - ay) * (cx - ax))"
HEIGHT = f"az - (((ey - ay) * (cz - az) - (ez - az) * (cy - ay)) * (i - ax) + ((ez - az) * (cx - ax) - (ex - ax) * (cz - az)) * (j - ay)) / {AREA}"
HIT = f"hit as (select i, j, {HEIGHT} as z, sign({AREA}) as turn from {LINES} where ({_side('a', 'e')} + {_side('e', 'c')} + {_side('c', 'a')}) % 2 = 1 and {AREA} <> 0)"
CLOSE = f"m as (select i, j, k, min({surface.triangle_distance('p', 'a', 'e', 'c')}) as v from {_boxes('triangles', 'least(a{0}, e{0}, c{0})', 'greatest(a{0}, e{0}, c{0})', '1.0')} group by i, j, k)"


def triangles(spark, d):
    x, y, z = (F.col(p) for p in points.P)
    names = [p + a for p in "aec" for a in "xyz"]

    def face(sx: float, sy: float, sz: float):
        a, b, c = [x + sx * 1.6, y, z], [x, y + sy * 1.6, z], [x, y, z + sz * 1.6]
        corners = [*a, *b, *c] if sx * sy * sz > 0 else [*a, *c, *b]
        return F.struct(*[v.alias(n) for v, n in zip(corners, names)])

    return tables.vectors(spark, d).select(F.inline(F.array(*[face(*s) for s in SIGNS])))


@query("tools_mesh_to_level_set", f"{WITH_VECTORS}, {TRIANGLES}, {HIT}, {CLOSE}, w as (select m.i, m.j, m.k, m.v, coalesce(sum(turn), 0) as turns from m left join hit on hit.i = m.i and hit.j = m.j and hit.z > m.k where m.v < 1.0 group by all) select cast(i as int) as i, cast(j as int) as j, cast(k as int) as k, {r('case when turns > 0 then -v else v end')} as value, true as active from w")
def mesh_to_level_set(spark, d):
    return shown(surface.mesh_level_set(triangles(spark, d), 1.0))


# --- points ------------------------------------------------------------------------------------------------
def _at_points(name: str, value: str, table: str, background: float) -> str:
    """Trilinear samples of a table's column at the asked points, as a table."""
    text = _weighted(product((0, 1), repeat=3), {0: "(1 - {0})", 1: "{0}"}).replace(", 3) + 0.0", ", 14) + 0.0").replace("coalesce(g.value, 0.0)", f"coalesce(g.{value}, {background})").replace("join cube g", f"join {table} g").replace("g.active", "true")
    return f"{name} as (select id, value as {name} from (with {text}))"


SLOPES = ", ".join(f"({stencil.name(stencil.axis(n))} - {stencil.name(stencil.axis(n, -1))}) / 2 as {c}" for n, c in enumerate(("gx", "gy", "gz")))
PARTS = ", ".join([_at_points("d", "value", "ball", 1.5), *[_at_points(f"s{c}", c, "slope", 0.0) for c in ("gx", "gy", "gz")]])
STEEP = "sqrt(sgx * sgx + sgy * sgy + sgz * sgz)"


@query("points_project", f"with {BALL}, slope as (select i, j, k, {SLOPES} from {NEAR}), asked as (select id, px + 1.2 as x, py - 0.4 as y, pz + 0.3 as z from vectors), {PARTS} select id, " + ", ".join(f"{r(f'case when {STEEP} > 0 then {a} - d * s{c} / {STEEP} else {a} end', 5)} as p{a}" for a, c in zip("xyz", ("gx", "gy", "gz"))) + " from asked join d using (id) join sgx using (id) join sgy using (id) join sgz using (id)")
def project(spark, d):
    p = tables.vectors(spark, d).select("id", (F.col("px") + 1.2).alias("px"), (F.col("py") - 0.4).alias("py"), (F.col("pz") + 0.3).alias("pz"))
    return shown(points.projected(p, ball(spark, d)), 5)


def _hash(seed: int, *parts: str) -> str:
    return f"(cast('0x' || substr(md5(concat_ws(':', {seed}, {', '.join(parts)})), 1, 8) as bigint) / 4294967296.0::double)"


@query("points_scatter_by_value", f"{WITH_CUBE}, m as (select *, cast(floor(value * 0.00005 + {_hash(1, *IJK)}) as int) as many from cube), n as (select i, j, k, unnest(range(1, many + 1)) as n from m) select i, j, k, cast(n as int) as n, " + ", ".join(f"{r(f'{c} + {_hash(1 + m, *IJK, "n")} - 0.5')} as p{a}" for m, (c, a) in enumerate(zip(IJK, "xyz"), 1)) + " from n")
def scatter_by_value(spark, d):
    return shown(points.scattered_by_value(tables.cube(spark, d), 0.00005))


VIEW = ((25.0, 30.0, 0.5), 8.0, 0.2, 5.0)
U, V = ("(({0} - {1}) / ((1.0 + (pz - 0.5) * 0.2) * 8.0) + 0.5)".format(p, x) for p, x in (("px", 25.0), ("py", 30.0)))


@query("points_frustum_raster", f"{WITH_ITEMS}, f as (select {U} as u, {V} as v, (pz - 0.5) / 5.0 as w, discount from items where pz >= 0.5 and pz < 5.5) select cast(floor(u * 16) as int) as fi, cast(floor(v * 16) as int) as fj, cast(floor(w * 16) as int) as fk, count(*) as n, {r('avg(discount)')} as mean from f where u >= 0 and u < 1 and v >= 0 and v < 1 group by 1, 2, 3")
def frustum_raster(spark, d):
    held = points.in_frustum(tables.items(spark, d), *VIEW, 16)
    return shown(held.groupBy("fi", "fj", "fk").agg(F.count(F.lit(1)).alias("n"), F.avg("discount").alias("mean")))


@query("tools_clip_frustum", f"{WITH_CUBE} select i, j, k, value, active from (select *, {U.replace('px', 'i').replace('pz', 'k').replace('25.0', '30.0')} as u, {V.replace('py', 'j').replace('pz', 'k').replace('30.0', '5.0')} as v from cube) where k >= 0.5 and k < 5.5 and u >= 0 and u < 1 and v >= 0 and v < 1")
def clip_frustum(spark, d):
    return points.clipped_to_frustum(tables.cube(spark, d), (30.0, 5.0, 0.5), 8.0, 0.2, 5.0).df


# --- functions ---------------------------------------------------------------------------------------------
M4 = ["q", "y", "z", "1.0", "2.0", "q + 1", "y", "0.5", "z", "3.0", "q", "y", "1.5", "z", "0.25", "q - 20"]


def _minor4(c: int) -> str:
    m = [f"m{4 * n + k}" for n in range(1, 4) for k in range(4) if k != c]
    return f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"


LAST = "(x * m3 + y0 * m7 + z0 * m11 + m15)"


@query("ax_matrix4_functions", f"with m as (select id, x, y as y0, z as z0, {', '.join(f'{e}::double as m{n}' for n, e in enumerate(f'({e})' for e in M4))} from {T}) select id, {r('m0 * ' + _minor4(0) + ' - m1 * ' + _minor4(1) + ' + m2 * ' + _minor4(2) + ' - m3 * ' + _minor4(3), 3)} as determinant, {r('m0 + m5 + m10 + m15')} as trace, {', '.join(f'{r(f"case when {LAST} = 0 then {own} else (x * m{c} + y0 * m{4 + c} + z0 * m{8 + c} + m{12 + c}) / {LAST} end", 4)} as t{c}' for c, own in enumerate(('x', 'y0', 'z0')))}, {r('m0 * m0 + m1 * m1 + m2 * m2 + m3 * m3', 4)} as p0, {r('m4 * m12 + m5 * m13 + m6 * m14 + m7 * m15', 4)} as p7 from m")
def matrix4(spark, d):
    m = [F.expr(e).cast("double") for e in M4]
    p, t = scalar.multiply4(m, scalar.transpose4(m)), scalar.transform4(m, (F.col("x"), F.col("y"), F.col("z")))
    df = row(spark, d).select("id", scalar.determinant4(m).alias("determinant"), scalar.trace4(m).alias("trace"), *[x.alias(f"t{n}") for n, x in enumerate(t)], p[0].alias("p0"), p[7].alias("p7"))
    return df.select("id", *[(F.round(n, {"determinant": 3, "trace": 6}.get(n, 4)) + 0.0).alias(n) for n in df.columns[1:]])
