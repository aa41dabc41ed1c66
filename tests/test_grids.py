"""Small grids with known answers."""

import math

import pytest
from gridloom.model import Grid, cell, leaf_key
from gridloom.operators import combine, levelset, points, sample, stats, stencil, tree
from gridloom.sources import store
from gridloom.streaming import voxels
from pyspark.sql import functions as F

SCHEMA = "i int, j int, k int, value double, active boolean"


def made(spark, rows, background=0.0):
    return Grid(spark.createDataFrame(rows, SCHEMA), background)


def values(g):
    return {(r["i"], r["j"], r["k"]): (r["value"], r["active"]) for r in g.df.collect()}


def test_replace_and_backgrounds(spark):
    bg = 9.0
    a = made(spark, [(0, 0, 0, 3.0, True), (0, 0, 1, 3.0, True), (0, 1, 2, bg, True), (1, 0, 0, 3.0, False), (1, 0, 1, 3.0, False)], bg)
    b = made(spark, [(0, 0, 0, -1.0, True), (0, 1, 0, 4.0, True), (0, 1, 2, -2.0, True), (1, 0, 0, -1.0, False), (1, 1, 0, 4.0, False)], 0.0)
    got = values(combine.over(a, b))
    assert got[0, 0, 0] == (-1.0, True) and got[0, 1, 0] == (4.0, True) and got[0, 0, 1] == (3.0, True) and got[0, 1, 2] == (-2.0, True)
    assert got[1, 0, 0] == (3.0, False) and got[1, 1, 0] == (bg, False)
    assert combine.add(a, b).background == 9.0 and values(combine.add(a, b))[0, 1, 0] == (13.0, True)


def test_order_of_operands(spark):
    a, b = made(spark, [(0, 0, 0, 1.0, True)], 5.0), made(spark, [(0, 0, 1, 2.0, False)], 7.0)
    got = values(combine.combine(a, b, lambda x, y: x + y * 100, 705.0))
    assert got == {(0, 0, 0): (701.0, True), (0, 0, 1): (205.0, False)}


def test_division_by_zero(spark):
    a = made(spark, [(n, 0, 0, v, True) for n, v in enumerate((1.0, -1.0, 0.0))])
    b = made(spark, [(n, 0, 0, 0.0, True) for n in range(3)])
    got = [values(combine.divide(a, b))[n, 0, 0][0] for n in range(3)]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2])


def test_cells_of_negative_halves(spark):
    df = spark.createDataFrame([(-2.5,), (-0.5,), (0.5,), (2.49,)], "x double").select(cell(F.col("x")).alias("c"))
    assert [r["c"] for r in df.collect()] == [-2, 0, 1, 2]
    keys = spark.createDataFrame([(-1, -8, 7), (-8, -1, 0)], "i int, j int, k int").select(leaf_key().alias("l")).distinct()
    assert keys.count() == 1


def test_gradient_of_a_distance_is_one(spark):
    ball = levelset.sphere(spark, 32, (15.8, 15.2, 15.7), 10.0)
    inner = ball.df.where("abs(value) < 1.5")
    steep = stencil.norm(ball).df.join(inner.select("i", "j", "k"), ["i", "j", "k"]).agg(F.min("value"), F.max("value")).first()
    assert 0.97 < steep[0] <= steep[1] < 1.01
    bend = stencil.mean_curvature(ball).df.join(inner.where("abs(value) < 0.5").select("i", "j", "k"), ["i", "j", "k"]).agg(F.avg("value")).first()[0]
    assert bend == pytest.approx(1 / 10, rel=0.03)
    m = stats.measure(ball).first()
    assert m["area"] == pytest.approx(4 * math.pi * 100, rel=0.03) and m["volume"] == pytest.approx(4 / 3 * math.pi * 1000, rel=0.03)


def test_dilation_counts(spark):
    one = made(spark, [(0, 0, 0, 5.0, True)])
    assert [stencil.dilate(one, n).on.count() for n in (6, 18, 26)] == [7, 19, 27]
    assert stencil.dilate(one, 6, 2).on.count() == 25
    back = stencil.erode(stencil.dilate(one, 26), 26)
    assert [(r["i"], r["value"]) for r in back.on.collect()] == [(0, 5.0)]


def test_population_variance(spark):
    rows = [(n, 0, 0, 1.0, True) for n in range(50)] + [(n, 9, 0, -3.0, True) for n in range(50)]
    s = stats.statistics(made(spark, rows)).first()
    assert (s["mean"], s["variance"], s["least"], s["most"]) == (-1.0, 4.0, -3.0, 1.0)


def test_samples_of_a_plane(spark):
    rows = [(i, j, k, 2.0 * i - j + 0.5 * k, True) for i in range(-3, 4) for j in range(-3, 4) for k in range(-3, 4)]
    g = made(spark, rows)
    at = spark.createDataFrame([(1, 0.25, -0.5, 1.75), (2, -1.5, 1.125, -0.75)], "id long, x double, y double, z double")
    for f in (sample.trilinear, sample.quadratic):
        got = {r["id"]: r["value"] for r in f(g, at).collect()}
        assert got == pytest.approx({1: 0.5 + 0.5 + 0.875, 2: -3.0 - 1.125 - 0.375})


def test_segments(spark):
    rows = [(n, 0, 0, 1.0, True) for n in range(40)] + [(n, 2, 0, 1.0, True) for n in range(5)] + [(n, 1, 0, 1.0, False) for n in range(5)]
    got = {(r["j"], r["si"], r["sj"], r["n"]) for r in tree.segments(made(spark, rows)).collect()}
    assert got == {(0, 0, 0, 40), (2, 0, 2, 5)}


def test_store_and_dense(spark, tmp_path):
    g = made(spark, [(-9, 0, 3, 1.5, True), (4, 4, 4, 2.0, False), (100, 5, 5, 3.0, True)], 7.0)
    store.write(g, str(tmp_path / "g"), 2)
    assert values(store.read(spark, str(tmp_path / "g"))) == values(g) and store.read(spark, str(tmp_path / "g")).background == 7.0
    assert list(values(store.read(spark, str(tmp_path / "g"), (0, 0, 0), (50, 50, 50)))) == [(4, 4, 4)]
    dense = store.to_dense(g)
    back = store.from_dense(dense.select(F.col("ni").alias("i"), F.col("nj").alias("j"), F.col("nk").alias("k"), "values"), (8, 8, 8), 7.0)
    assert {k: v[0] for k, v in values(back).items()} == {k: v[0] for k, v in values(g).items()}
    (tmp_path / "m.obj").write_text("# mesh\nv 1 2 3\nv -1.5 0 2\nf 1 2 1\n")
    assert {tuple(r) for r in store.read_obj(spark, str(tmp_path / "m.obj")).collect()} == {(1.0, 2.0, 3.0), (-1.5, 0.0, 2.0)}
    (tmp_path / "p.xyz").write_text("1 2 3\nheader\n4,5,6\n")
    assert store.read_xyz(spark, str(tmp_path / "p.xyz")).count() == 2


def test_points_of_one_voxel(spark):
    p = spark.createDataFrame([(1, 0.2, 0.0, 0.0, 10.0), (2, -0.5, 0.0, 0.0, 20.0)], "id long, px double, py double, pz double, v double")
    assert values(points.count(p)) == {(0, 0, 0): (2.0, True)}
    raster = values(points.raster(p, "v", False))
    assert raster[0, 0, 0][0] == pytest.approx(18.0) and raster[-1, 0, 0][0] == pytest.approx(10.0)
    assert points.scattered(points.mask(p), 5).count() == 5
    assert {(r["id"], r["other"]) for r in points.within(p, p, 0.7).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_stream_equals_batch(spark, tiny, tmp_path):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = voxels.windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "40 days")
    q = stream.writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("windowed").collect())) == sorted(map(tuple, voxels.windowed(events).collect()))
