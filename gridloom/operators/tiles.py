"""Pairs of near rows by tiles: rows of a bucket lie in chunks, and chunks of neighbouring buckets meet.

Chunks come from a range partitioning by bucket and a hash, so many rows in one bucket are many chunks in many tasks. A
chunk has at most ``CHUNK`` rows, whatever the bucket holds; a tile is one pair of chunks, a NumPy matrix inside a task.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from gridloom.operators.tree import _written
from gridloom.workers import ready

KEY = ["bx", "by", "bz"]
CHUNK = 1024
#: Tiles of an Arrow batch.
TILES = 32


def finite(columns: list[str]) -> Column:
    """Whether no column is null, NaN or infinite."""
    return ~F.array_contains(F.array(*[F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in columns]), False)


def _runs(batches):
    """Rows, sorted by bucket, as lists of the rows of one bucket."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in range(3)])
        turns = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        at = np.union1d(np.arange(0, batch.num_rows, CHUNK), turns).astype(np.int32)
        ends = pa.array(np.append(at, batch.num_rows).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, batch.column(n)) for n in range(3, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([*[batch.column(n).take(pa.array(at)) for n in range(3)], *lists], names=batch.schema.names)


def chunked(rows: DataFrame, places: list[str], side: float, order: list[Column]) -> DataFrame:
    """(bx, by, bz, lists of the rows' columns), written; ``order`` tells rows of one bucket apart and sorts them."""
    ready(rows.sparkSession)
    keyed = rows.select(*[F.floor(F.col(p) / side).cast("long").alias(b) for p, b in zip(places, KEY)], "*")
    sorted_ = keyed.repartitionByRange(*KEY, *order).sortWithinPartitions(*KEY, *order)
    schema = StructType([*[StructField(b, LongType()) for b in KEY], *[StructField(f.name, ArrayType(f.dataType)) for f in rows.schema.fields]])
    return _written(sorted_.mapInArrow(_runs, schema))


def tiled(left: DataFrame, right: DataFrame) -> DataFrame:
    """Chunks of two tables side by side where their buckets are the same or touch, with the number of the left one.

    The right one's chunks go to the 27 buckets around; rows of the left one stay in theirs. Names differ but for the key's.
    """
    steps = F.inline(F.array(*[F.struct(*[F.lit(x).alias(f"d{b}") for b, x in zip(KEY, o)]) for o in product((-1, 0, 1), repeat=3)]))
    sent = right.select("*", steps)
    sent = sent.select(*[(F.col(b) + F.col(f"d{b}")).alias(b) for b in KEY], *[c for c in right.columns if c not in KEY])
    return left.withColumn("chunk", F.monotonically_increasing_id()).join(sent.hint("merge"), KEY).drop(*KEY)


def values(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    """A list of numbers as an array."""
    return batch.column(column)[row].values.to_numpy(zero_copy_only=False)


def matrix(batch: pa.RecordBatch, columns: list[str], row: int) -> np.ndarray:
    """Lists of numbers as the columns of a matrix."""
    return np.stack([values(batch, c, row) for c in columns], 1)
