"""Queries of neighbourhoods' axes and of level sets of ellipsoids, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.model import IJK
from gridloom.operators import ellipsoids
from gridloom.plans.bands import _staged
from gridloom.plans.further import BAND, WITH_VECTORS
from gridloom.plans.queries import query, shown
from gridloom.plans.sql import r
from gridloom.sources import tables

RADIUS, RATIO, THRESHOLD, AVERAGE = 9.0, 0.3, 5, 0.5
SHAPE = ", ".join([*[f"s{n}" for n in range(3)], *[f"x{p}{n} as u{p}{n}" for p in range(3) for n in range(3)]])
SUMS = ", ".join([f"sum(weight * d{p}) as w{p}" for p in range(3)] + [f"sum(weight * d{p} * d{q}) as w{p}{q}" for p, q in ellipsoids.PAIRS])
NEAR = f"(select a.id, a.px, a.py, a.pz, b.px - a.px as d0, b.py - a.py as d1, b.pz - a.pz as d2, sqrt((b.px - a.px) * (b.px - a.px) + (b.py - a.py) * (b.py - a.py) + (b.pz - a.pz) * (b.pz - a.pz)) / {RADIUS!r}::double as share from vectors a, vectors b)"
SUMMED = f"(select id, px, py, pz, count(*) as n, sum(weight) as w, {SUMS} from (select *, 1 - share * share * share as weight from {NEAR} where share <= 1) group by id, px, py, pz)"
WITH_SHAPES = f"{WITH_VECTORS}, shapes as materialized (select id, n, {', '.join(f'p{a} + m{n} * {AVERAGE} as q{a}' for n, a in enumerate('xyz'))}, {SHAPE} from {_staged(SUMMED, ellipsoids.shaped(RATIO, 1.0, THRESHOLD))})"
#: Axes without their order and signs: the symmetric matrix that stretches a sphere.
STRETCH = {f"t{p}{q}": " + ".join(f"u{p}{n} * u{q}{n} * s{n}" for n in range(3)) for p, q in ellipsoids.PAIRS}


def shapes(spark, d) -> DataFrame:
    return ellipsoids.local_axes(tables.vectors(spark, d), RADIUS, RATIO, 1.0, THRESHOLD, AVERAGE)


@query("points_local_axes", f"{WITH_SHAPES} select id, n, {', '.join(r(c, 5) + f' as {c}' for c in ('qx', 'qy', 'qz', 's0', 's1', 's2'))}, {', '.join(f'{r(e, 5)} as {n}' for n, e in STRETCH.items())} from shapes")
def local_axes(spark, d):
    return shown(shapes(spark, d).selectExpr("id", "n", "qx", "qy", "qz", "s0", "s1", "s2", *[f"{e} as {n}" for n, e in STRETCH.items()]), 5)


def _boxed(of: str, half: float) -> str:
    for m, (c, a) in enumerate(zip(IJK, "xyz")):
        reach = f"(r * sqrt({' + '.join(f'u{m}{n} * s{n} * u{m}{n} * s{n}' for n in range(3))}) + {half})"
        of = f"(select *, {c} - q{a} as d{m} from (select *, unnest(range(cast(ceil(q{a} - {reach}) as int), cast(floor(q{a} + {reach}) as int) + 1)) as {c} from {of}))"
    return of


SOLID = "(select shapes.*, 1.5 + label * 0.25 as r from shapes join vectors using (id))"


@query("points_rasterize_ellipsoids", f"{WITH_SHAPES}, m as (select i, j, k, min(value) as v from {_staged(_boxed(SOLID, 1.5), ellipsoids.distance())} group by i, j, k) {BAND.format(r('v', 4), 1.5)}")
def rasterize_ellipsoids(spark, d):
    return shown(ellipsoids.ellipsoids(shapes(spark, d), F.lit(1.5) + F.col("label") * 0.25, 1.5), 4)
