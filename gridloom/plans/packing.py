"""Queries of spheres packed into solids and of closest places on surfaces, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.model import Grid
from gridloom.operators import levelset, packing
from gridloom.operators.surface import vertices
from gridloom.plans.further import BLOBS, CELLS, WITH_VECTORS
from gridloom.plans.meshing import VERTICES
from gridloom.plans.queries import query, shown
from gridloom.plans.sql import r
from gridloom.sources import tables

#: The widest sphere around a vector has a radius of 3.75, so rows within 4 of the surface reach through all solids.
DEEP = 4.0
LEAST = 1.5


def solids(spark, d) -> Grid:
    return levelset.particles(tables.vectors(spark, d), F.lit(1.5) + F.col("label") * 0.25, DEEP)


WITH_SOLIDS = f"{WITH_VECTORS}, {BLOBS.replace('2.5', str(DEEP)).replace('blobs as (', 'blobs as materialized (', 1)}, {CELLS}, {VERTICES}"
#: Places and points meet in buckets of 4 voxels: no point of the queries is farther from the surface.
AWAY = "sqrt((p.px - v.x) * (p.px - v.x) + (p.py - v.y) * (p.py - v.y) + (p.pz - v.z) * (p.pz - v.z))"
STEPS = ", ".join(str((x, y, z)) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1))
BUCKETED = f"placed as materialized (select x, y, z, cast(floor(x / 4) as int) + di as bx, cast(floor(y / 4) as int) + dj as by_, cast(floor(z / 4) as int) + dk as bz from verts, (values {STEPS}) o(di, dj, dk))"


def _closest(of: str) -> str:
    return f"(select p.id, min({AWAY}) as distance from {of} p join placed v on v.bx = cast(floor(p.px / 4) as int) and v.by_ = cast(floor(p.py / 4) as int) and v.bz = cast(floor(p.pz / 4) as int) group by p.id)"


CANDIDATES = f"inner_ as (select (i, j, k) as id, i::double as px, j::double as py, k::double as pz from blobs where value < 0), candidates as materialized (select id[1] as i, id[2] as j, id[3] as k, round(distance, 6) as r from {_closest('inner_')} where round(distance, 6) >= {LEAST})"


@query("tools_closest_surface_point", f"{WITH_SOLIDS}, {BUCKETED} select id, {r('distance')} as distance from {_closest('vectors')}")
def closest_surface_point(spark, d):
    points = tables.vectors(spark, d).select("id", "px", "py", "pz")
    return shown(packing.closest_surface(vertices(solids(spark, d)), points).select("id", "distance"))


def _greedy(shrunk: str, where: str) -> str:
    """The spheres chosen one by one: each step has the candidates that are left, the chosen one as its first."""
    top = "(select * from left_ order by r desc, i, j, k limit 1)"
    room = "(sqrt(((s.i - t.i) * (s.i - t.i) + (s.j - t.j) * (s.j - t.j) + (s.k - t.k) * (s.k - t.k))::double) - t.r)"
    step = f"select n + 1, i, j, k, r from (select s.n, s.i, s.j, s.k, s.r as own, {room} as room, {shrunk.format(room=room)} as r from left_ s, {top} t) where {where} and r >= {LEAST}"
    return f"left_ as (select 0 as n, i, j, k, r from candidates union all {step}), chosen as (select n, max((r, -i, -j, -k)) as s from left_ group by n)"


CHOSEN = "select cast(-s[2] as int) as i, cast(-s[3] as int) as j, cast(-s[4] as int) as k, " + r("s[1]") + " as r from chosen"


def _recursive(text: str) -> str:
    return text.replace("with ", "with recursive ", 1)


@query("tools_fill_with_spheres", _recursive(f"{WITH_SOLIDS}, {BUCKETED}, {CANDIDATES}, {_greedy('least(s.r, {room})', 'true')} {CHOSEN}"))
def fill_with_spheres(spark, d):
    """All spheres of at least 1.5 voxels that touch each other at most; radii are rounded before they are compared."""
    found = packing.candidates(solids(spark, d)).withColumn("r", F.round("r", 6))
    return shown(packing.packed(found, min_radius=LEAST))


@query("tools_fill_with_overlapping_spheres", _recursive(f"{WITH_SOLIDS}, {BUCKETED}, {CANDIDATES}, {_greedy('s.r', 'room >= 0')} {CHOSEN}"))
def fill_with_overlapping_spheres(spark, d):
    found = packing.candidates(solids(spark, d)).withColumn("r", F.round("r", 6))
    return shown(packing.packed(found, min_radius=LEAST, overlapping=True))
