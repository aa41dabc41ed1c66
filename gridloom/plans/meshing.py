"""Queries of meshes with merged cells and of level sets made anew from their faces, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.model import IJK, LEAF
from gridloom.operators import meshing, soup, surface
from gridloom.plans import tracking
from gridloom.plans.bands import _staged
from gridloom.plans.further import CELLS, CROSSINGS, WITH_BLOBS, _boxes, _vertex, blobs
from gridloom.plans.queries import query, shown
from gridloom.plans.sql import r
from gridloom.plans.tracking import HIT

VERTICES = f"verts as materialized (select *, {', '.join(f'{_vertex(n)} as {a}' for n, a in enumerate('xyz'))} from cells where {CROSSINGS} > 0)"
QUADS = "quads as materialized (" + " union all ".join(f"select {n} as axis, a.i, a.j, a.k, a.value < 0 as looks from blobs a join blobs b on {' and '.join(f'b.{c} = a.{c} + {int(m == n)}' for m, c in enumerate(IJK))} where (a.value < 0) <> (b.value < 0)" for n in range(3)) + ")"
TURN = [(0, 0), (-1, 0), (-1, -1), (0, -1)]


def _ring(n: int, m: int) -> dict[str, int]:
    a, b = TURN[m]
    return {IJK[n]: 0, IJK[(n + 1) % 3]: a, IJK[(n + 2) % 3]: b}


STEPS = ", ".join(str((n, m, *[_ring(n, m)[c] for c in IJK])) for n in range(3) for m in range(4))
RINGS = f"rings as (select q.axis, q.i, q.j, q.k, case when looks then m else 3 - m end as corner, q.i + di as vi, q.j + dj as vj, q.k + dk as vk from quads q join (values {STEPS}) s(axis, m, di, dj, dk) using (axis))"
FOUR = ", ".join(f"max(case when corner = {n} then {a} end) as {a}{n}" for n in range(4) for a in "xyz")
CORNERS = f"four as (select {FOUR} from rings join verts v on v.i = vi and v.j = vj and v.k = vk group by axis, rings.i, rings.j, rings.k having count(*) = 4)"
THREE = "triangles as materialized (" + " union all ".join(f"select {', '.join(f'{a}{n} as {to}{a}' for n, to in zip(of, 'aec') for a in 'xyz')} from four" for of in ((0, 1, 2), (0, 2, 3))) + ")"
NEAREST = f"m as (select i, j, k, min({surface.triangle_distance('p', 'a', 'e', 'c')}) as v from {_boxes('triangles', 'least(a{0}, e{0}, c{0})', 'greatest(a{0}, e{0}, c{0})', '1.5')} group by i, j, k)"


@query(
    "tools_level_set_rebuild",
    f"{WITH_BLOBS}, {CELLS}, {VERTICES}, {QUADS}, {RINGS}, {CORNERS}, {THREE}, {HIT}, {NEAREST}, w as (select m.i, m.j, m.k, m.v, coalesce(sum(turn), 0) as turns from m left join hit on hit.i = m.i and hit.j = m.j and hit.z > m.k where m.v < 1.5 group by all) "
    f"select cast(i as int) as i, cast(j as int) as j, cast(k as int) as k, {r('case when turns > 0 then -v else v end', 5)} as value, true as active from w",
)
def rebuild(spark, d):
    return shown(surface.rebuilt(blobs(spark, d), half=1.5), 5)


TOLERANCE = 0.2


def _levels() -> str:
    sums = ", ".join(f"sum({x}) as {x}" for x in meshing.SUMS)
    parts = [f"own as materialized (select i, j, k, x, y, z, {', '.join(meshing.SUMS)} from {_staged('verts', meshing.planes())})"]
    parts.append(f"level0 as (select i as ni, j as nj, k as nk, {', '.join(meshing.SUMS)} from own)")
    for n in range(1, LEAF + 1):
        up = ", ".join(f"n{c} >> 1 as n{c}" for c in IJK)
        every = f"(select {', '.join(f'{c} >> {n} as n{c}' for c in IJK)}, count(*) as all_ from own group by 1, 2, 3)"
        met = f"(select s.* from (select {up}, {sums} from level{n - 1} group by {', '.join(f'n{c} >> 1' for c in IJK)}) s join {every} e using (ni, nj, nk) where m = all_)"
        parts.append(f"level{n} as materialized (select * from {_staged(met, meshing.placed(n))} where error <= {TOLERANCE * TOLERANCE!r}::double)")
    joins = " ".join(f"left join level{n} l{n} on {' and '.join(f'l{n}.n{c} = o.{c} >> {n}' for c in IJK)}" for n in range(1, LEAF + 1))
    level = " ".join(f"when l{n}.ni is not null then {n}" for n in range(LEAF, 0, -1))
    parts.append(f"node as materialized (select o.i, o.j, o.k, o.x, o.y, o.z, case {level} else 0 end as level from own o {joins})")
    keyed = ", ".join(f"{c} >> level as n{c}" for c in IJK)
    parts.append(f"noded as materialized (select *, {keyed} from node)")
    return ", ".join(parts)


WITH_NODES = f"{WITH_BLOBS}, {CELLS}, {VERTICES}, {_levels()}"
MOVED = ", ".join(f"x{n} + ((n{c} >> ({LEAF} - {{0}})) * {1 << LEAF}) as {a}" for n, (c, a) in enumerate(zip(IJK, "xyz")))
POINTS = " union all ".join(["select 0 as level, ni, nj, nk, x, y, z from noded where level = 0", *[f"select {n} as level, ni, nj, nk, {MOVED.format(n)} from level{n} semi join (select ni, nj, nk from noded where level = {n}) u using (ni, nj, nk)" for n in range(1, LEAF + 1)]])


@query("tools_volume_to_mesh_adaptive_vertices", f"{WITH_NODES}, p as ({POINTS}) select cast(level as int) as level, cast(ni as int) as ni, cast(nj as int) as nj, cast(nk as int) as nk, {', '.join(f'{r(a, 4)} as {a}' for a in 'xyz')} from p")
def adaptive_vertices(spark, d):
    return shown(meshing.adaptive(blobs(spark, d), 0.0, TOLERANCE)[0], 4)


NAMES = "level || ':' || ni || ':' || nj || ':' || nk"
NODED = ", ".join(f"max(case when corner = {n} then {NAMES} end) as c{n}" for n in range(4))


@query(
    "tools_volume_to_mesh_adaptive",
    f"{WITH_NODES}, {QUADS}, {RINGS}, f as (select axis, rings.i, rings.j, rings.k, {NODED} from rings join noded v on v.i = vi and v.j = vj and v.k = vk group by axis, rings.i, rings.j, rings.k having count(*) = 4), "
    "g as (select axis, i, j, k, (case when c1 in (c0) then [c0] else [c0, c1] end) as first, c0, c1, c2, c3 from f), h as (select axis, i, j, k, c0, c1, c2, c3, first || (case when c2 in (c0, c1) then [] else [c2] end) || (case when c3 in (c0, c1, c2) then [] else [c3] end) as corners from g) "
    "select axis, i, j, k, len(corners) as n, array_to_string(corners, ' ') as corners from h where len(corners) = 4 or (len(corners) = 3 and c0 <> c2 and c1 <> c3)",
)
def adaptive(spark, d):
    """Polygons with their corners' nodes as text."""
    polygons = meshing.adaptive(blobs(spark, d), 0.0, TOLERANCE)[1]
    told = F.transform("corners", lambda c: F.concat_ws(":", c["level"], c["ni"], c["nj"], c["nk"]))
    return polygons.select("axis", *IJK, F.size("corners").cast("long").alias("n"), F.array_join(told, " ").alias("corners"))


@query("tools_polygon_soup_to_level_set")
def polygon_soup(spark, d):
    """Octahedra around the vectors, every second triangle seen from inside: no SQL for the flood; see tests/test_soup.py."""
    rows = tracking.triangles(spark, d)
    swap = (F.floor(F.col("ax") + F.col("cz")) % 2) == 0
    names = [p + a for p in "aec" for a in "xyz"]
    other = {"a": "a", "e": "c", "c": "e"}
    flipped = rows.select(*[F.when(swap, F.col(other[n[0]] + n[1])).otherwise(F.col(n)).alias(n) for n in names])
    return shown(soup.level_set(flipped, 1.5), 5)
