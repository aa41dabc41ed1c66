"""The hierarchy above voxels: tiles, pyramids, segments and flood fills."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.model import IJK, LEAF, Grid, node
from gridloom.operators.stencil import CUBE, FACES, NEAR, Offset


#: Parts above one in this many voxels are looked up in a broadcast table, which so has at most as many rows.
LARGE_PARTS = 1000


def prune(g: Grid, bits: int = LEAF, tolerance: float = 0.0) -> DataFrame:
    """(i, j, k, level, value, active): full nodes whose voxels agree become a tile of their median; others stay."""
    keyed = g.df.select(*IJK, "value", "active", *node(bits))
    names = [f"n{c}" for c in IJK]
    told = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("a"), F.max("value").alias("b"), F.min("active").alias("s"), F.max("active").alias("t"), F.percentile("value", 0.5).alias("median"))
    told = told.withColumn("tile", (F.col("n") == 1 << 3 * bits) & (F.col("b") - F.col("a") <= tolerance) & (F.col("s") == F.col("t")))
    tiles = told.where("tile").select(*[F.col(n).alias(c) for n, c in zip(names, IJK)], F.lit(bits // LEAF).alias("level"), F.col("median").alias("value"), F.col("s").alias("active"))
    rest = keyed.join(told.where("tile").select(*names), names, "left_anti")
    return tiles.unionByName(rest.select(*IJK, F.lit(0).alias("level"), "value", "active"))


def voxelize(tiles: DataFrame, background: float = 0.0, bits: int = LEAF) -> Grid:
    """Tiles of one level spelt out as voxels."""
    out = tiles.where("level > 0")
    for c in IJK:
        out = out.withColumn(c, F.explode(F.sequence(F.col(c), F.col(c) + ((1 << bits) - 1))))
    whole = out.select(*IJK, "value", "active").unionByName(tiles.where("level = 0").select(*IJK, "value", "active"))
    return Grid(whole, background)


def coarser(g: Grid) -> Grid:
    """Restriction to voxels twice as large: 27 voxels weighed 8, 4, 2 and 1 by how many axes they differ in."""
    sent = [F.struct(*[F.lit(x).alias(f"d{c}") for c, x in zip(IJK, o)], F.lit(8.0 / 2 ** sum(map(abs, o)) / 64).alias("w")) for o in [(0, 0, 0), *CUBE]]
    rows = g.df.select(*IJK, "value", "active", F.inline(F.array(*sent)))
    moved = rows.select(*[(F.col(c) + F.col(f"d{c}")).alias(c) for c in IJK], "value", "active", "w", F.when((F.col("di") == 0) & (F.col("dj") == 0) & (F.col("dk") == 0), F.col("active")).alias("own"))
    even = reduce(lambda a, b: a & b, [F.col(c).bitwiseAND(1) == 0 for c in IJK])
    summed = moved.where(even).groupBy(*[F.shiftright(c, 1).alias(c) for c in IJK]).agg(F.sum(F.col("w") * (F.col("value") - g.background)).alias("d"), F.max("own").alias("own"))
    return Grid(summed.where("own").select(*IJK, (F.col("d") + g.background).alias("value"), F.lit(True).alias("active")), g.background)


def finer(g: Grid) -> Grid:
    """Prolongation to voxels half as large: values between voxels are the mean of the two, four or eight around."""
    sent = [F.struct(*[F.lit(x).alias(f"d{c}") for c, x in zip(IJK, o)], F.lit(0.5 ** sum(map(abs, o))).alias("w")) for o in [(0, 0, 0), *CUBE]]
    rows = g.df.select(*IJK, "value", "active", F.inline(F.array(*sent)))
    moved = rows.groupBy(*[(F.col(c) * 2 + F.col(f"d{c}")).alias(c) for c in IJK]).agg(F.sum(F.col("w") * (F.col("value") - g.background)).alias("d"), F.max("active").alias("active"))
    return Grid(moved.select(*IJK, (F.col("d") + g.background).alias("value"), "active"), g.background)


#: Names of the folders that :func:`_written` has made in this process; :func:`_forget` deletes no other.
_OWN: set[str] = set()


def _written(df: DataFrame) -> DataFrame:
    """Cut lineage through a table in the shared folder."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    where = (shared or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch").rstrip("/")
    name = f"grid-{uuid.uuid4().hex}"
    path = f"{where}/{name}"
    _OWN.add(name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(df: DataFrame) -> None:
    """Delete the files of a table that :func:`_written` has made and that nothing reads any more."""
    spark = df.sparkSession
    for path in {p.rpartition("/")[0] for p in df.inputFiles()}:
        if path.rpartition("/")[2] in _OWN:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def segments(g: Grid, near: int = 6, by: tuple[str, ...] = ()) -> DataFrame:
    """(i, j, k, si, sj, sk, n): a part is named by its least coordinate; n voxels are connected in it.

    Columns ``by`` of the grid's rows tell grids apart that lie in one table: only voxels of the same are connected.

    In a round each label points to the least label that its voxels touch, pointers are followed to their ends, and
    voxels take the label at the end. So at most half of the labels that can merge stay, and the rounds grow with the
    logarithm of the voxels. Each round is written to the shared folder.
    """
    at = (*by, *IJK)
    state = _written(g.on.select(*at, F.struct(*at).alias("label")))
    most = max(1, state.count() // LARGE_PARTS)
    offsets: list[Offset] = [(0, 0, 0), *NEAR[near]]
    while True:
        sent = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"d{c}") for c, x in zip(IJK, o)], F.lit(n == 0).alias("own")) for n, o in enumerate(offsets)]))
        spread = state.select(*at, "label", sent.alias("o")).select(*by, *[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in IJK], "label", F.col("o.own").alias("own"))
        met = spread.groupBy(*at).agg(F.min("label").alias("least"), F.max(F.when(F.col("own"), F.col("label"))).alias("label")).where("label is not null")
        to = _written(met.groupBy("label").agg(F.min("least").alias("next")))
        if to.where("next < label").isEmpty():
            _forget(to)
            break
        while True:
            further = _written(_looked_up(to, "next", to.select(F.col("label").alias("next"), F.col("next").alias("end")), "end", F.col("label"), most).select("label", F.col("next").alias("before"), F.col("end").alias("next")))
            _forget(to)
            to = further.select("label", "next")
            if further.where("next < before").isEmpty():
                break
        old, state = state, _written(_looked_up(state, "label", to, "next", F.struct(*at), most).select(*at, F.col("next").alias("label")))
        _forget(old)
        _forget(to)
    sizes = state.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return _looked_up(state, "label", sizes, "n", F.struct(*at), most).select(*at, *[F.col("label")[c].alias(f"s{c}") for c in IJK], "n")


def _looked_up(rows: DataFrame, by: str, table: DataFrame, name: str, own: Column, most: int) -> DataFrame:
    """Rows with what a table (one row for each value of ``by``) says of theirs.

    Values of more than ``most`` rows, a share of all and so at most LARGE_PARTS of them, are broadcast. Their rows go to
    the join by ``own``, so that no task gets all rows of a value; what they find there gives way. The table itself is
    shuffled, however small its files are, so the driver sees no more than the large values.
    """
    large = rows.groupBy(by).agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > most).select(by)
    told = rows.join(F.broadcast(table.join(F.broadcast(large), by).select(by, F.col(name).alias("of_large"))), by, "left")
    keyed = told.withColumn("key", F.when(F.col("of_large").isNull(), F.col(by)).otherwise(own))
    return keyed.join(table.select(F.col(by).alias("key"), F.col(name).alias("of_key")).hint("merge"), "key", "left").select(*rows.columns, F.coalesce("of_large", "of_key").alias(name))


def flood_signs(g: Grid) -> Grid:
    """Inactive voxels take the sign of the last active voxel before them on their line, or of the first after them.

    Lines run along k first; what has no active voxel on its line takes the signs that were found along j, then along i.
    """
    df = g.df.withColumn("sign", F.when(F.col("active"), F.signum("value")))
    for along in reversed(IJK):
        line = Window.partitionBy(*[c for c in IJK if c != along]).orderBy(along)
        last = F.last("sign", True).over(line.rowsBetween(Window.unboundedPreceding, 0))
        first = F.first("sign", True).over(line.rowsBetween(0, Window.unboundedFollowing))
        df = df.withColumn("sign", F.coalesce(last, first))
    sign = F.when(F.coalesce("sign", F.lit(1.0)) < 0, -1.0).otherwise(1.0)
    return g.with_df(df.withColumn("value", F.when(F.col("active"), F.col("value")).otherwise(F.abs("value") * sign)))


def faces(g: Grid) -> DataFrame:
    """(i, j, k, axis, side): sides of active voxels that look at an inactive one; the skin of a voxel mesh."""
    sides = F.inline(F.array(*[F.struct(F.lit(next(n for n in range(3) if o[n])).alias("axis"), F.lit(sum(o)).alias("side"), *[F.lit(x).alias(f"d{c}") for c, x in zip(IJK, o)]) for o in FACES]))
    rows = g.on.select(*IJK, sides)
    beyond = g.on.select(*[F.col(c).alias(f"b{c}") for c in IJK])
    met = [F.col(c) + F.col(f"d{c}") == F.col(f"b{c}") for c in IJK]
    return rows.join(beyond, met, "left_anti").select(*IJK, "axis", "side")


