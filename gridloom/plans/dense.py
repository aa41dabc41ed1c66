"""Queries of dense arrays in chunks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.model import Grid
from gridloom.operators import dense
from gridloom.plans.queries import HALF, WITH_CUBE, half_off, query, shown
from gridloom.plans.sql import r
from gridloom.sources import tables

#: The box of all quantities, discounts and taxes.
BOX = ((0, 0, 0), (63, 15, 15))
PART = ((5, 2, 1), (30, 8, 4))


def array(spark, d):
    return dense.dense(tables.cube(spark, d), BOX)


def kept(rows) -> Grid:
    return dense.extracted(rows, lambda v: v != 0)


@query("tools_dense_extract", f"{WITH_CUBE} select i, j, k, {r('sqrt(value)')} as value, true as active from cube where value > 50000")
def extract(spark, d):
    return shown(dense.extracted(array(spark, d), lambda v: v > 50000, F.sqrt))


@query("tools_dense_extract_masked", f"{WITH_CUBE}, {HALF} select i, j, k, {r('value')} as value, true as active from half_off where active")
def extract_masked(spark, d):
    return shown(dense.extracted_with_mask(array(spark, d), half_off(spark, d)))


@query("tools_dense_transform", f"{WITH_CUBE} select i, j, k, {r('case when i between 5 and 30 and j between 2 and 8 and k between 1 and 4 then value / 2 + 1 else value end')} as value, true as active from cube where value <> 0 union all select cast(a.range as int), cast(b.range as int), cast(c.range as int), 1.0::double, true from range(5, 31) a, range(2, 9) b, range(1, 5) c where not exists (select 1 from cube where i = a.range and j = b.range and k = c.range)")
def transform(spark, d):
    return shown(kept(dense.transformed(array(spark, d), PART, lambda v: v / 2 + 1)))


TEXTS = {"over": "u + a * (v - u)", "add": "u + a * v", "sub": "u - a * v", "min": "(1 - a) * u + a * least(u, v)", "max": "(1 - a) * u + a * greatest(u, v)", "mult": "(1 + a * (v - 1)) * u"}
LAID = "laid as (select i, j, k, value as u, case when value > 40000 then value / 200000 * 0.75::double end as a, case when value < 90000 then value * 0.5 else 0 end * 1.5::double as v from cube)"


def composite(spark, d, how: str):
    cube = tables.cube(spark, d)
    source = Grid(cube.df.where("value < 90000").withColumn("value", F.col("value") * 0.5), 0.0)
    alpha = half_off(spark, d).map(F.col("value") / 200000)
    return shown(kept(dense.composited(array(spark, d), source, alpha, how, 1.5, 0.75)), 3)


for way, text in TEXTS.items():
    query(f"tools_dense_composite_{way}", f"{WITH_CUBE}, {LAID} select * from (select i, j, k, {r(f'case when a is null then u else {text} end', 3)} as value, true as active from laid) where value <> 0")(lambda spark, d, way=way: composite(spark, d, way))
