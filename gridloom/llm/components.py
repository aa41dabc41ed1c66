"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, drop


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each id of (a, b) links; a component is named by its smallest id.

    Large star: each node links its larger neighbours to the smallest of its neighbourhood; small star: its smaller
    ones. The links become stars around the smallest ids in a number of rounds that grows with the logarithm of the
    links. Each round is two sums by node and two joins, so a hot node is summed before it is shuffled, and its
    links are split by Spark's skew handling. Null ids are ignored; repeated links and loops do no harm.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = cut(small)
        drop(edges)
        edges = new
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(now):
            break
        before = tuple(now)
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return stars.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
