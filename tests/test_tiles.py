"""Chunks of buckets, and sums over all pairs of a bucket that holds several chunks."""

import numpy as np
from pyspark.sql import functions as F

from gridloom.model import Grid
from gridloom.operators import ellipsoids, points, tiles
from gridloom.operators.tree import _looked_up


def test_sums_over_several_chunks_of_a_bucket(spark):
    at = np.random.default_rng(3).uniform(0.0, 6.0, (2600, 3))
    df = spark.createDataFrame([(n, *map(float, p)) for n, p in enumerate(at)], "id long, px double, py double, pz double")
    chunks = tiles.chunked(df.drop("id"), ["px", "py", "pz"], 9.0, [F.xxhash64("px")])
    sizes = [x[0] for x in chunks.select(F.size("px")).collect()]
    assert sum(sizes) == len(at) and max(sizes) <= tiles.CHUNK and len(sizes) > 2
    found = ellipsoids.local_axes(df, 2.0, 0.25, 1.0, 5, 1.0).select("id", "n", "qx", "qy", "qz").collect()
    assert len(found) == len(at)
    for x in found[::50]:
        away = np.sqrt(((at - at[x["id"]]) ** 2).sum(1))
        weight = np.where(away <= 2.0, 1 - (away / 2.0) ** 3, 0.0)
        assert x["n"] == (away <= 2.0).sum()
        assert np.allclose(tuple(x)[2:], weight @ at / weight.sum())


def test_points_of_one_voxel_are_made_in_many_tasks(spark):
    g = Grid(spark.createDataFrame([(1, 2, 3, 20000.0, True), (1, 2, 4, 0.0, True), (1, 2, 5, 9.0, False)], "i int, j int, k int, value double, active boolean"))
    rows = points.scattered_by_value(g, 1.0).withColumn("task", F.spark_partition_id())
    found = rows.agg(F.count("*"), F.countDistinct("k", "n"), F.min("n"), F.max("n"), F.countDistinct("task")).first()
    assert found[:4] == (20000, 20000, 1, 20000) and found[4] > 4


def test_labels_are_shuffled_to_their_rows(spark):
    """Only the few large values' rows are broadcast, not a whole table whose files are small."""
    rows = spark.range(200).selectExpr("cast(id as int) as at", "cast(id % 40 as int) as label")
    table = spark.range(40).selectExpr("cast(id as int) as label", "cast(id * 2 as int) as next")
    found = _looked_up(rows, "label", table, "next", F.col("at"), 1000)
    joined = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert any("SortMergeJoin" in line for line in joined)
    assert {tuple(x) for x in found.collect()} == {(n, n % 40, n % 40 * 2) for n in range(200)}
