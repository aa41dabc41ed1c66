"""Queries of values, surfaces, tubes, meshes, attributes and further functions, with their SQL."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from gridloom.model import IJK, Grid
from gridloom.operators import levelset, points, stats, stencil, surface, tree, values
from gridloom.plans import sql
from gridloom.plans.queries import HALF, NORM, T, WITH_AR, WITH_CUBE, WITH_VECTORS, half_off, query, row, shown
from gridloom.plans.sql import near, paired, r
from gridloom.sources import tables

# --- values ------------------------------------------------------------------------------------------------
#: Inactive voxels at 5, -5 or 1, so that backgrounds show.
FIVES = "fives as (select i, j, k, case when active then value else case i % 3 when 0 then 5.0 when 1 then -5.0 else 1.0 end end as value, active from half_off)"


def fives(spark, d) -> Grid:
    third = F.col("i") % 3
    df = half_off(spark, d).df
    return Grid(df.withColumn("value", F.when(F.col("active"), F.col("value")).when(third == 0, 5.0).when(third == 1, -5.0).otherwise(1.0)), 5.0)


@query("tools_change_background", f"{WITH_CUBE}, {HALF}, {FIVES} select i, j, k, cast(case when active then value when value = 5 then 2.5 when value = -5 then -2.5 else value end as double) as value, active from fives")
def change_background(spark, d):
    return values.change_background(fives(spark, d), 2.5).df


@query("tools_change_level_set_background", f"{WITH_CUBE}, {HALF}, {FIVES} select i, j, k, cast(case when active then value when value < 0 then -4.0 else 3.0 end as double) as value, active from fives")
def change_level_set_background(spark, d):
    return values.change_level_set_background(fives(spark, d), 3.0, -4.0).df


for how, text in {"min": "least(a, b)", "max": "greatest(a, b)", "sum": "a + b", "mult": "a * b"}.items():
    query(f"tools_set_value_on_{how}", f"{WITH_AR} select i, j, k, case when has_b then {text} else a end as value, on_a or has_b as active from (select *, on_b as has_b from {paired('a', 'r', 2.0, 0.0)})")(
        lambda spark, d, how=how: values.set_on(Grid(tables.by_flag(spark, d, "A").df, 2.0), tables.by_flag(spark, d, "R").df, how).df
    )

BOXES = "boxes as (select cast(s_suppkey as int) as box, cast(s_suppkey % 50 as int) as li, cast(s_suppkey % 7 as int) as lj, cast(s_suppkey % 5 as int) as lk, cast(s_suppkey % 50 + s_suppkey % 4 as int) as hi, cast(s_suppkey % 7 + 1 as int) as hj, cast(s_suppkey % 5 + s_suppkey % 3 as int) as hk from supplier)"


@query("tools_active_in_boxes", f"{WITH_CUBE}, {HALF}, {BOXES} select box, count(i) as n, count(i) > 0 as any_active, count(i) = (max(hi - li) + 1) * (max(hj - lj) + 1) * (max(hk - lk) + 1) as all_active from boxes left join (select * from half_off where active) g on i between li and hi and j between lj and hj and k between lk and hk group by box")
def active_in_boxes(spark, d):
    s = F.col("s_suppkey")
    parts = {"box": s, "li": s % 50, "lj": s % 7, "lk": s % 5, "hi": s % 50 + s % 4, "hj": s % 7 + 1, "hk": s % 5 + s % 3}
    return values.active_in(half_off(spark, d), tables.read(spark, d, "supplier").select(*[v.cast("int").alias(n) for n, v in parts.items()]))


@query("tools_count_tiles", f"{WITH_CUBE}, n as (select count(*) as n, min(floor(value / 5000)) as a, max(floor(value / 5000)) as b from cube group by i >> 1, j >> 1, k >> 1) select count(*) as nodes, count(*) filter (n = 8) as full, count(*) filter (n = 8 and a = b) as constant from n")
def count_tiles(spark, d):
    g = tables.cube(spark, d)
    return values.tile_counts(g.map(F.floor(F.col("value") / 5000).cast("double")), 1)


FIRST = "select i, j, k, value, row_number() over (order by value, i, j, k) as low, row_number() over (order by value desc, i, j, k) as high from cube"


@query("tools_extrema", f"{WITH_CUBE}, o as ({FIRST}) select count(*) as n, min(value) as least, max(value) as most, {', '.join(f'max({c}) filter ({o} = 1) as {w}_{c}' for o, w in (('low', 'least'), ('high', 'most')) for c in IJK)} from o")
def extrema(spark, d):
    return stats.extrema(tables.cube(spark, d))


@query("tools_op_extrema", f"{WITH_CUBE} select count(*) as n, {r('min(v)', 4)} as least, {r('max(v)', 4)} as most from (select {NORM} as v from {near('cube', stencil.FACES)})")
def op_extrema(spark, d):
    return shown(stats.extrema(stencil.norm(tables.cube(spark, d))).select("n", "least", "most"), 4)


TURN = [0.0, -1.0, 0.5, 2.0, 0.25, 0.0, -0.5, 0.0, 1.0]
SLOPES = [f"({stencil.name(stencil.axis(n))} - {stencil.name(stencil.axis(n, -1))}) / 2" for n in range(3)]


@query("tools_transform_vectors", f"{WITH_CUBE} select i, j, k, " + ", ".join(" + ".join(f"{SLOPES[m]} * {TURN[3 * n + m]}::double" for m in range(3)) + f" + {n + 1} as {c}" for n, c in enumerate(("gx", "gy", "gz"))) + f" from {near('cube', stencil.FACES)}")
def transform_vectors(spark, d):
    return values.transform_vectors(stencil.gradient(tables.cube(spark, d)), TURN, shift=(1.0, 2.0, 3.0))


#: Few voxels are active, so that leaves without one exist.
RARE = "rare as (select i, j, k, value - 60000 as value, value > 95000 as active from cube)"


def rare(spark, d) -> Grid:
    return Grid(tables.cube(spark, d).df.select(*IJK, (F.col("value") - 60000).alias("value"), (F.col("value") > 95000).alias("active")), 0.0)


SAME = " and ".join(f"(x.{c} >> {{0}}) = (rare.{c} >> {{0}})" for c in IJK)


@query("tools_prune_inactive", f"{WITH_CUBE}, {RARE} select i, j, k, {r('value')} as value, active from rare where exists (select 1 from rare x where x.active and {SAME.format(1)})")
def prune_inactive(spark, d):
    return shown(values.prune_inactive(rare(spark, d), 1))


@query(
    "tools_prune_level_set",
    f"{WITH_CUBE}, {RARE}, t as (select (i >> 1) << 1 as i, (j >> 1) << 1 as j, (k >> 1) << 1 as k, bool_or(active) as s, arg_min(value, (i, j, k)) as f from rare group by i >> 1, j >> 1, k >> 1) "
    f"select i, j, k, 1 as level, cast(case when f < 0 then -3.0 else 3.0 end as double) as value, false as active from t where not s union all select rare.i, rare.j, rare.k, 0, {r('value')}, active from rare join t on {' and '.join(f'(rare.{c} >> 1) << 1 = t.{c}' for c in IJK)} where s",
)
def prune_level_set(spark, d):
    return shown(values.prune_level_set(rare(spark, d), 3.0, -3.0, 1))


def _cells(odd: int) -> str:
    steps = [o for o in product((-1, 0, 1), repeat=3) if o.count(0) == odd]
    return f"(select count(*) from (select distinct i * 2 + di, j * 2 + dj, k * 2 + dk from click, (values {', '.join(map(str, steps))}) o(di, dj, dk)))"


@query("tools_euler_characteristic", f"with {sql.kind('click')}, c as (select {_cells(0)} as vertices, {_cells(1)} as edges, {_cells(2)} as faces, {_cells(3)} as cubes) select *, vertices - edges + faces - cubes as euler, 1 - (vertices - edges + faces - cubes) as genus from c")
def euler(spark, d):
    return values.euler(tables.events(spark, d, "click"))


# --- surfaces ----------------------------------------------------------------------------------------------
#: Around each vector a sphere; the band is wide enough for meshes.
AROUND = "around as (select px, py, pz, 1.5 + label * 0.25 as r from vectors)"


def _boxes(of: str, low: str, high: str, reach: str, rest: str = "*") -> str:
    """Text of a table with each voxel of its rows' boxes; {} in low and high stands for an axis."""
    out = of
    for c, a in zip(IJK, "xyz"):
        out = f"(select *, unnest(range(cast(ceil({low.format(a)} - {reach}) as int), cast(floor({high.format(a)} + {reach}) as int) + 1)) as {c} from {out})"
    return f"(select *, cast(i as double) as px, cast(j as double) as py, cast(k as double) as pz from {out})"


BLOBS = f"blobs as (select cast(i as int) as i, cast(j as int) as j, cast(k as int) as k, value, true as active from (select i, j, k, min(sqrt((i - ax) * (i - ax) + (j - ay) * (j - ay) + (k - az) * (k - az)) - r) as value from {_boxes('(select px as ax, py as ay, pz as az, 1.5 + label * 0.25 as r from vectors)', 'a{}', 'a{}', '(r + 2.5)')} group by i, j, k) where abs(value) < 2.5)"
WITH_BLOBS = f"{WITH_VECTORS}, {BLOBS}"


def blobs(spark, d) -> Grid:
    return levelset.particles(tables.vectors(spark, d), F.lit(1.5) + F.col("label") * 0.25, 2.5)


CELLS = f"cells as (select i - di as i, j - dj as j, k - dk as k, {', '.join(f'max(case when (di, dj, dk) = {o} then value end) as {surface.corner(o)}' for o in surface.CORNERS)} from blobs, (values {', '.join(map(str, surface.CORNERS))}) o(di, dj, dk) group by all having count(*) = 8)"
CELLS = CELLS.replace("group by all", "group by i - di, j - dj, k - dk")
CROSSED = [f"(({surface.corner(a)} < 0) <> ({surface.corner(b)} < 0))" for a, b in surface.EDGES]
CROSSINGS = " + ".join(f"(case when {x} then 1.0::double else 0 end)" for x in CROSSED)


def _vertex(axis: int) -> str:
    terms = [f"(case when {x} then {float(a[axis])} + (0.0::double - {surface.corner(a)}) / ({surface.corner(b)} - {surface.corner(a)}) * {float(b[axis] - a[axis])} else 0 end)" for x, (a, b) in zip(CROSSED, surface.EDGES)]
    return f"{IJK[axis]} + ({' + '.join(terms)}) / ({CROSSINGS})"


@query("tools_volume_to_mesh_vertices", f"{WITH_BLOBS}, {CELLS} select i, j, k, {', '.join(f'{r(_vertex(n))} as {a}' for n, a in enumerate('xyz'))} from cells where {CROSSINGS} > 0")
def mesh_vertices(spark, d):
    return shown(surface.vertices(blobs(spark, d)))


@query("tools_volume_to_mesh_quads", f"{WITH_BLOBS} " + " union all ".join(f"select {n} as axis, a.i, a.j, a.k, a.value < 0 as out from blobs a join blobs b on {' and '.join(f'b.{c} = a.{c} + {int(m == n)}' for m, c in enumerate(IJK))} where (a.value < 0) <> (b.value < 0)" for n in range(3)))
def mesh_quads(spark, d):
    return surface.quads(blobs(spark, d))


SEGMENTS = "select px as ax, py as ay, pz as az, px + 3 as ex, py - label as ey, pz + 2 as ez, 0.75 + label * 0.125 as r from vectors"
BAND = "select cast(i as int) as i, cast(j as int) as j, cast(k as int) as k, {0} as value, true as active from m where abs(v) < {1}"


def segments(spark, d):
    return tables.vectors(spark, d).select(F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("pz").alias("az"), (F.col("px") + 3).alias("ex"), (F.col("py") - F.col("label")).alias("ey"), (F.col("pz") + 2).alias("ez"), (F.lit(0.75) + F.col("label") * 0.125).alias("r"))


@query("tools_particle_trails", f"{WITH_VECTORS}, m as (select i, j, k, min({surface.segment_distance('p', 'a', 'e')} - r) as v from {_boxes(f'({SEGMENTS})', 'least(a{0}, e{0})', 'greatest(a{0}, e{0})', '(r + 1.5)')} group by i, j, k) {BAND.format(r('v'), 1.5)}")
def particle_trails(spark, d):
    return shown(surface.tubes(segments(spark, d), 1.5))


FACES = "select px as ax, py as ay, pz as az, px + 2.5 as ex, py + 0.5 as ey, pz + 1 as ez, px - 0.5 as cx, py + 2 as cy, pz + 1.5 as cz from vectors"


@query("tools_mesh_to_unsigned_distance", f"{WITH_VECTORS}, m as (select i, j, k, min({surface.triangle_distance('p', 'a', 'e', 'c')}) as v from {_boxes(f'({FACES})', 'least(a{0}, e{0}, c{0})', 'greatest(a{0}, e{0}, c{0})', '1.5')} group by i, j, k) {BAND.format(r('v'), 1.5)}")
def mesh_distance(spark, d):
    x, y, z = (F.col(p) for p in points.P)
    t = {"ax": x, "ay": y, "az": z, "ex": x + 2.5, "ey": y + 0.5, "ez": z + 1, "cx": x - 0.5, "cy": y + 2, "cz": z + 1.5}
    return shown(surface.mesh_distance(tables.vectors(spark, d).select(*[v.alias(n) for n, v in t.items()]), 1.5))


W = "pow(1.0 - ((px - ax) * (px - ax) + (py - ay) * (py - ay) + (pz - az) * (pz - az)) / 16.0, 3.0)"


@query("points_rasterize_smooth_spheres", f"{WITH_VECTORS}, w as (select *, {W} as w from {_boxes('(select px as ax, py as ay, pz as az from vectors)', 'a{}', 'a{}', '4.0')}), s as (select i, j, k, sum(w) as w, sum(w * ax) as x, sum(w * ay) as y, sum(w * az) as z from w where w > 0 group by i, j, k), m as (select i, j, k, sqrt((i - x / w) * (i - x / w) + (j - y / w) * (j - y / w) + (k - z / w) * (k - z / w)) - 2.0 as v from s) {BAND.format(r('v', 4), 1.5)}")
def smooth_spheres(spark, d):
    return shown(surface.balls(tables.vectors(spark, d), 2.0, 1.5), 4)


for faces, shape in {4: "tetrahedron", 8: "octahedron", 12: "dodecahedron", 20: "icosahedron"}.items():
    planes = ", ".join(f"(px - ax) * {x!r}::double + (py - ay) * {y!r}::double + (pz - az) * {z!r}::double" for x, y, z in surface.face_normals(faces))
    query(f"tools_level_set_{shape}", f"{WITH_VECTORS}, m as (select i, j, k, min(greatest({planes})) - 1.25 as v from {_boxes('(select px as ax, py as ay, pz as az from vectors)', 'a{}', 'a{}', '4.0')} group by i, j, k) {BAND.format(r('v'), 1.5)}")(
        lambda spark, d, faces=faces: shown(surface.solid(tables.vectors(spark, d), surface.face_normals(faces), 1.25, 1.5))
    )

OFFSETS = ", ".join(map(str, [o for o in product(range(-2, 3), repeat=3) if sum(x * x for x in o) <= 4]))
AWAY = "min(sqrt(di * di + dj * dj + dk * dk)) filter ({0})"


@query("tools_topology_to_level_set", f"with {sql.kind('click')}, o(di, dj, dk) as (values {OFFSETS}), every as (select distinct g.i + di as i, g.j + dj as j, g.k + dk as k from click g, o), m as (select e.i, e.j, e.k, bool_or(c.i is not null and (di, dj, dk) = (0, 0, 0)) as own, {AWAY.format('c.i is not null')} as to_in, {AWAY.format('c.i is null')} as to_out from every e cross join o left join click c on c.i = e.i + di and c.j = e.j + dj and c.k = e.k + dk group by e.i, e.j, e.k) select i, j, k, {r('case when own then 0.5 - to_out else to_in - 0.5 end')} as value, true as active from m where case when own then to_out is not null else true end")
def topology_to_level_set(spark, d):
    return shown(surface.of_mask(tables.events(spark, d, "click"), 2))


# --- points ------------------------------------------------------------------------------------------------
@query("points_delete", f"{WITH_VECTORS} select id, {r('px')} as px, label from vectors where not (label = 2 or px > 10)")
def points_delete(spark, d):
    p = points.grouped(tables.vectors(spark, d), two=F.col("label") == 2, far=F.col("px") > 10)
    return shown(points.deleted(p, ["two", "far"]).select("id", "px", "label"))


@query("points_attributes", f"{WITH_VECTORS} select id, {r('px')} as px, label as kind, 0.5::double as mass from vectors")
def points_attributes(spark, d):
    return shown(points.attributes(tables.vectors(spark, d), {"mass": 0.5}, {"label": "kind"}, ["py", "pz"]).select("id", "px", "kind", "mass"))


@query("points_string_codes", f"with {sql.ITEMS} select id, cast(dense_rank() over (order by status) as int) as status from items")
def string_codes(spark, d):
    return points.coded(tables.items(spark, d), "status")[0].select("id", "status")


UNIT = "t as (select id, px / n as u, py / n as v, pz from (select *, abs(px) + abs(py) + abs(pz) as n from vectors)), f as (select id, case when pz < 0 then (1.0 - abs(v)) * case when u < 0 then -1.0 else 1.0 end else u end as a, case when pz < 0 then (1.0 - abs(u)) * case when v < 0 then -1.0 else 1.0 end else v end as b from t)"


@query("points_unit_vector_codec", f"{WITH_VECTORS}, {UNIT} select id, cast(floor((a * 0.5 + 0.5) * 255 + 0.5) as int) as a, cast(floor((b * 0.5 + 0.5) * 255 + 0.5) as int) as b from f")
def unit_vector_codec(spark, d):
    a, b = points.unit_coded(*[F.col(p) for p in points.P])
    return tables.vectors(spark, d).select("id", a.alias("a"), b.alias("b"))


COV = ", ".join(f"covar_pop({a}, {b}) as c{a[1]}{b[1]}" for n, a in enumerate(points.P) for b in points.P[n:])


@query("points_principal_spread", f"{WITH_VECTORS}, c as (select {COV} from vectors), q as (select *, (cxx + cyy + czz) / 3 as q from c), p as (select *, sqrt(((cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) as p from q), s as (select *, ((cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz)) / (2 * p * p * p) as t from p), e as (select q, q + 2 * p * cos(acos(least(greatest(t, -1), 1)) / 3) as e1, q + 2 * p * cos(acos(least(greatest(t, -1), 1)) / 3 + 2.0943951023931953) as e3 from s) select {r('e1', 5)} as e1, {r('3 * q - e1 - e3', 5)} as e2, {r('e3', 5)} as e3 from e")
def principal_spread(spark, d):
    return shown(points.principal_spread(tables.vectors(spark, d)), 5)


def _field(n: int, x: str, y: str, z: str) -> str:
    s, t = (lambda v: f"sin({v} * 3.141592653589793)"), (lambda v: f"sin({v} * 6.283185307179586)")
    return (f"2.0 * {s(x)} * {s(x)} * {t(y)} * {t(z)}", f"-{s(y)} * {s(y)} * {t(x)} * {t(z)}", f"-{s(z)} * {s(z)} * {t(x)} * {t(y)}")[n]


def _stages(step: float) -> str:
    out = "s0 as (select id, px / 50 as x, py / 50 as y, pz / 50 as z from vectors)"
    for n, share in enumerate((0.0, 0.5, 0.5, 1.0), 1):
        at = [f"({a} + {share * step} * {a}{n - 1})" if n > 1 else a for a in "xyz"]
        out += f", s{n} as (select *, {', '.join(f'{_field(m, *at)} as {a}{n}' for m, a in enumerate('xyz'))} from s{n - 1})"
    return out


@query("points_advect_runge_kutta", f"{WITH_VECTORS}, {_stages(0.05)} select id, " + ", ".join(f"{r(f'{a} + ({a}1 + 2 * {a}2 + 2 * {a}3 + {a}4) * (0.05 / 6)')} as p{a}" for a in "xyz") + " from s4")
def advect_runge_kutta(spark, d):
    p = tables.vectors(spark, d).select("id", *[(F.col(c) / 50).alias(c) for c in points.P])
    return shown(points.advected(p, points.enright, 0.05))


# --- functions ---------------------------------------------------------------------------------------------
@query("ax_exponents_and_angles", f"select id, {r('pow(2, q / 10)')} as exp2, {r('log2(x)')} as log2, {r('log10(x)')} as log10, {r('abs(q - 25)')} as fabs, {r('acos(y)')} as acos, {r('asin(y)')} as asin, {r('atan(q)')} as atan, {r('tan(y)')} as tan, {r('cosh(y)')} as cosh, {r('sinh(y)')} as sinh, {r('acosh(q + 1)')} as acosh, {r('asinh(q)')} as asinh, {r('atanh(y)')} as atanh, q - 25 < 0 as signbit, true as finite, {r('q * q + y * y + z * z')} as lengthsq from {T}")
def exponents(spark, d):
    q, x, y, z = (F.col(c) for c in "qxyz")
    finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
    return row(spark, d).select(
        "id", *[(F.round(v, 6) + 0.0).alias(n) for n, v in {"exp2": F.pow(F.lit(2.0), q / 10), "log2": F.log2(x), "log10": F.log10(x), "fabs": F.abs(q - 25), "acos": F.acos(y), "asin": F.asin(y), "atan": F.atan(q), "tan": F.tan(y), "cosh": F.cosh(y), "sinh": F.sinh(y), "acosh": F.acosh(q + 1), "asinh": F.asinh(q), "atanh": F.atanh(y)}.items()],
        (q - 25 < 0).alias("signbit"), finite.alias("finite"), (F.round(q * q + y * y + z * z, 6) + 0.0).alias("lengthsq"),
    )


@query("ax_volume_functions", f"{WITH_CUBE}, {HALF} select i as x, j as y, k as z, {r('i * 0.5::double - 1.0')} as wx, {r('j * 0.5::double - 1.0')} as wy, {r('k * 0.5::double - 1.0')} as wz, active as isactive, coalesce(n.v, 7.0) as above, ((i & 7) << 6) + ((j & 7) << 3) + (k & 7) as leafoffset from half_off left join (select i as pi, j as pj, k - 1 as pk, value as v from half_off) n on pi = i and pj = j and pk = k")
def volume_functions(spark, d):
    g = half_off(spark, d)
    above = g.df.select("i", "j", (F.col("k") - 1).alias("k"), F.col("value").alias("v"))
    inside = [F.col(c).bitwiseAND(7) for c in IJK]
    return shown(
        g.df.join(above, list(IJK), "left").select(*[F.col(c).alias(a) for c, a in zip(IJK, "xyz")], *[(F.col(c) * 0.5 - 1.0).alias(f"w{a}") for c, a in zip(IJK, "xyz")], F.col("active").alias("isactive"), F.coalesce("v", F.lit(7.0)).alias("above"), (F.shiftleft(inside[0], 6) + F.shiftleft(inside[1], 3) + inside[2]).alias("leafoffset"))
    )


@query("tools_segment_sdf")
def segment_sdf(spark, d):
    """Solids of the spheres: connected parts of their inside."""
    return tree.segments(levelset.interior(blobs(spark, d)))
