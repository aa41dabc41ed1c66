"""Queries of solids broken into pieces, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import fracture, levelset
from gridloom.plans.packing import WITH_SOLIDS, solids
from gridloom.plans.queries import query, shown
from gridloom.plans.sql import r

#: Balls that cut: some meet, so that pieces are cut again. Rows of pieces end HALF outside.
RADIUS, WIDE, HALF = 9.3, 10.0, 1.5
PLACES = [(-12, -9, 4), (11, 8, -7), (-6, -5, 1), (14, -13, 10), (3, 16, 9), (10, 2, -3), (-18, 12, -14), (0, 0, 0)]


def broken(spark, d):
    centre = spark.range(1).select(*[F.lit(0.0).alias(p) for p in ("px", "py", "pz")])
    cutter = levelset.particles(centre, F.lit(RADIUS), WIDE)
    return fracture.fractured(solids(spark, d).df.select(F.lit("solid").alias("piece"), "i", "j", "k", "value"), cutter, PLACES, HALF)


def _cuts() -> str:
    out = f"pieces0 as (select 'solid' as piece, i, j, k, value from blobs where value < {HALF})"
    for n, place in enumerate(PLACES):
        away = "sqrt(" + " + ".join(f"({c} - {x}) * ({c} - {x})::double" for c, x in zip("ijk", (f"({x})" for x in place))) + f") - {RADIUS}"
        out += f", met{n} as materialized (select piece, i, j, k, value, case when b < {WIDE} then greatest(value, b) end as inside, case when b < {WIDE} then greatest(value, -b) else value end as outside from (select *, {away} as b from pieces{n}))"
        whole = " and ".join(f"count(*) filter ({v} < {HALF}) >= {fracture.FEWEST} and min({v}) < 0" for v in ("inside", "outside"))
        out += f", good{n} as materialized (select piece from met{n} group by piece having {whole})"
        out += f", pieces{n + 1} as materialized (select * from (select m.piece, i, j, k, case when g.piece is null then value else outside end as value from met{n} m left join good{n} g on g.piece = m.piece union all select m.piece || '/{n}', i, j, k, inside from met{n} m join good{n} g on g.piece = m.piece) where value < {HALF})"
    return out


WITH_PIECES = f"{WITH_SOLIDS}, {_cuts()}"
LAST = f"pieces{len(PLACES)}"


@query("tools_fracture", f"{WITH_PIECES} select piece, cast(i as int) as i, cast(j as int) as j, cast(k as int) as k, {r('value', 4)} as value from {LAST}")
def broken_pieces(spark, d):
    return shown(broken(spark, d).drop("cut"), 4)


@query("tools_fracture_volumes", f"{WITH_PIECES} select piece, count(*) filter (value < 0) as inside, count(*) as n, cast(min(i) as int) as low, cast(max(i) as int) as high from {LAST} group by piece")
def volumes(spark, d):
    """Voxels inside and rows of each piece: the insides of all add up to the solid's."""
    return broken(spark, d).groupBy("piece").agg(F.count(F.when(F.col("value") < 0, 1)).alias("inside"), F.count(F.lit(1)).alias("n"), F.min("i").alias("low"), F.max("i").alias("high"))
