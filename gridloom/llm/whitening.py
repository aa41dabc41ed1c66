"""Whitening of embeddings by their principal components, from a matrix-free block Lanczos iteration.

The covariance is never formed. A pass over the written integer vectors gives V B for a block B of up to ``BLOCK``
columns: each task centres its rows, multiplies twice, and sends one row for each dimension, which are summed by
dimension before the driver reads them: dimensions x BLOCK numbers, whatever the rows and tasks.

Blocks are orthogonalised against all earlier ones, twice. As the images of the basis are kept, Ritz pairs and their true
residuals cost no pass. Columns that vanish under orthogonalisation (breakdown) are replaced by random ones, so a
multiple eigenvalue or an invariant space hides nothing. A basis at its limit restarts from its best Ritz vectors and
goes on. It ends when all wanted residuals are within ``TOLERANCE`` of the largest eigenvalue, or when the basis is the
whole space.

Centring is exact: entries are whole numbers, of which the quotient of the sum is taken away as a whole number and then
the rest's fraction. Deviations are whole numbers too: of 64 bits where they must fit, else Python's.

Defined results: a row is left out if its vector is null or empty, holds null or non-finite entries or one of 2 ** 46 or
more (whose 64-fold no double and long hold alike), or hasn't the most frequent length (the longest among equals).
Components whose eigenvalue is 0 to double precision can't be whitened and are left out, so fewer than 32 may come.
A deviation that a long can't hold is null. Repeated rows all count; null ids are kept; an empty table, or one of equal
vectors, gives no rows; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import cut, ready, table

COMPONENTS, BLOCK, TOLERANCE, SEED = 32, 16, 1e-13, 7
SCALE, SHIFT = 64, 1_000_000
#: Bits of a whole number's lower part, which is summed apart from the upper one.
LOW = 26


def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the usable vectors of (vec_id, embedding) as whole numbers, written."""
    e = F.transform(F.col("`embedding`"), lambda c: c.cast("double"))
    rows = vectors.select(F.col("`vec_id`").alias("vec_id"), e.alias("e")).where(F.size("e") > 0)
    rows = rows.where(F.forall("e", lambda c: F.coalesce(F.abs(c) < float(1 << 46), F.lit(False))))  # nan is above all numbers
    found = cut(rows.select("vec_id", F.transform("e", lambda c: F.floor(c * SCALE) + SHIFT).alias("x")))
    usual = found.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return found.where(F.size("x") == (usual["d"] if usual else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """A batch's vectors as rows of one matrix."""
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], integer: bool = False) -> np.ndarray:
    """The sum over all rows of a matrix that ``part`` makes of each batch; tasks add up their own first."""
    first = rows.select("x").first()
    if first is None:
        return np.zeros((0, 0))
    width = part(np.array([first["x"]])).shape[1]
    kind, arrow = ("long", pa.int64()) if integer else ("double", pa.float64())

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                found = part(_matrix(batch))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *[pa.array(c, arrow) for c in total.T]], names=["at", *[f"c{n}" for n in range(width)]])

    parts = rows.select("x").mapInArrow(run, ", ".join(["at int", *[f"c{n} {kind}" for n in range(width)]]))
    found = parts.groupBy("at").agg(*[F.sum(f"c{n}").alias(f"c{n}") for n in range(width)]).orderBy("at").collect()
    return np.array([tuple(r)[1:] for r in found], dtype=np.int64 if integer else np.float64)


def split(x: np.ndarray) -> np.ndarray:
    """Sums of the upper and lower parts of each dimension, and rows: columns that 64 bits hold for any table."""
    return np.stack([(x >> LOW).sum(0), (x & ((1 << LOW) - 1)).sum(0), np.full(x.shape[1], len(x))], 1)


@dataclass(frozen=True)
class Centre:
    """Number of rows, and each dimension's exact sum."""

    n: int
    sums: list[int]

    def take(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean."""
        whole_, rest = np.array([s // self.n for s in self.sums]), np.array([s % self.n / self.n for s in self.sums])
        return (x - whole_).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - sum) squared, exact."""
        low, high = (f(0).tolist() for f in (x.min, x.max))
        most = max(max(abs(self.n * a - s), abs(self.n * b - s)) for a, b, s in zip(low, high, self.sums))
        if most**2 * len(self.sums) < 1 << 63 and self.n * max(map(abs, low + high)) < 1 << 63:
            return ((x * self.n - np.array(self.sums)) ** 2).sum(1).tolist()
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]


def _orthogonal(new: np.ndarray, basis: np.ndarray, rng: np.random.Generator, room: int) -> np.ndarray:
    """Orthonormal columns from ``new``, orthogonal to the basis; those that vanish are drawn anew, up to ``room``."""
    out = np.zeros((len(basis), 0))
    for v in new.T[:room]:
        size = np.linalg.norm(v)
        while True:
            for _ in range(2):
                v = v - basis @ (basis.T @ v)
                v = v - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if left > 1e-10 * size and left > 0:
                break
            v = rng.normal(size=len(basis))
            size = np.linalg.norm(v)
        v = v / left
        v = v - basis @ (basis.T @ v)
        v = v - out @ (out.T @ v)
        out = np.column_stack([out, v / np.linalg.norm(v)])
    return out


def lanczos(apply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int = COMPONENTS, block: int = BLOCK, tolerance: float = TOLERANCE, limit: int | None = None, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric map and their unit vectors as columns. ``apply`` is asked for blocks."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, d)
    limit = min(d, max(limit or 4 * wanted, wanted + 2 * block))
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    new = _orthogonal(rng.normal(size=(d, min(block, d))), basis, rng, d)
    while True:
        image = apply(new)
        basis, images = np.column_stack([basis, new]), np.column_stack([images, image])
        small = basis.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        best = basis @ turns[:, :wanted]
        if basis.shape[1] >= wanted:
            residuals = np.linalg.norm(images @ turns[:, :wanted] - best * values[:wanted], axis=0)
            if basis.shape[1] == d or residuals.max() <= tolerance * max(values[0], 0.0):
                return values[:wanted], best
        if basis.shape[1] + block > limit < d:  # thick restart: the best Ritz vectors and their images go on
            keep = turns[:, : wanted + block // 2]
            basis, images = basis @ keep, images @ keep
        new = _orthogonal(image, basis, rng, d - basis.shape[1])


@dataclass(frozen=True)
class Whitening:
    """What is fitted: the centre, eigenvalues, unit vectors as columns, the covariance's trace and the check's error."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self.centre.take(x) @ self.vectors) / np.sqrt(self.values)


def fit(rows: DataFrame, wanted: int = COMPONENTS) -> Whitening | None:
    """Principal components of the rows (vec_id, x); None if they have none."""
    ready(rows.sparkSession)
    told = summed(rows, split, True)
    if not len(told):
        return None
    n = int(told[0, 2])
    centre = Centre(n, [(int(h) << LOW) + int(low) for h, low, _ in told])
    d = len(told)
    trace = float(summed(rows, lambda x: np.array([[sum(float(v) for v in centre.deviations(x)) / n**2]]))[0, 0]) / n
    if trace == 0:
        return None

    def apply(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centre.take(x)
            return c.T @ (c @ block)

        return summed(rows, part) / n

    values, vectors = lanczos(apply, d, wanted)
    held = values > values[0] * d * np.finfo(float).eps * 8
    made = Whitening(centre, values[held], vectors[:, held], trace, 0.0)

    def second(x: np.ndarray) -> np.ndarray:
        w = made(x)
        return np.column_stack([w.T @ w, w.sum(0)])

    moments = summed(rows, second) / n
    covariance = moments[:, :-1] - np.outer(moments[:, -1], moments[:, -1])
    return Whitening(centre, made.values, made.vectors, trace, float(np.abs(covariance - np.eye(len(covariance))).max()))


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and component."""
    k = len(model.values)
    shares = model.values / model.trace

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                each = np.repeat(np.arange(len(x)), k)
                deviations = pa.array([v if v < 1 << 63 else None for v in model.centre.deviations(x)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), deviations.take(pa.array(each)), pa.array(model(x).ravel()), pa.array(np.tile(shares, len(x)))],
                    names=["vec_id", "component", "deviation", "whitened", "explained"],
                )

    kind = dict(rows.dtypes)["vec_id"]
    out = rows.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, component int, deviation long, whitened double, explained double")
    return out.select("vec_id", "component", F.lit(model.centre.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(model.identity_error).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings, whitened by components of all of them."""
    rows = whole(table(spark, sf_dir, "embeddings"))
    model = fit(rows)
    if model is None:
        kind = dict(rows.dtypes)["vec_id"]
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return whitened(rows, model)
