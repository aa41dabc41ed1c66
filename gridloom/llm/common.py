"""Helpers shared by the training-data operators: tables, shared scratch space and worker imports."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of one word: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BATCH = 500  # rows of an Arrow batch
#: Names of the folders that :func:`cut` has written in this process; :func:`drop` deletes no other.
_OWN: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store works."""
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package where it isn't installed, and keep their batches small.

    Rows hold whole texts, so a batch of Spark's usual 10,000 rows would take too much memory on both sides.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine doesn't name one (tests), a folder in the warehouse is used; a cluster must name it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write rows to the shared folder and read them again: later stages start from files that survive lost executors."""
    spark = df.sparkSession
    name = f"cut-{uuid.uuid4().hex}"
    path = f"{scratch(spark)}/{name}"
    _OWN.add(name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`cut` has written and that nothing reads any more.

    Files that a table reads from elsewhere, whatever their folder is called, stay.
    """
    for df in tables:
        spark = df.sparkSession
        for path in {p.rpartition("/")[0] for p in df.inputFiles()}:
            name = path.rpartition("/")[2]
            if name in _OWN:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
                _OWN.discard(name)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; extra ones, whatever they are called, play no part."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; rows of fold 2 are held out. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
