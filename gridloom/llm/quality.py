"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Units are words in lower case and their shapes (runs of upper case, lower case, digits and each other character).
Random indexing: each unit has a sparse ternary index vector, drawn from a hash of its name; the vector of a unit is
the sum of the index vectors of its neighbours, of its shape and of its own over the training sample. These sums are
whole numbers, so their order doesn't matter. A word outside the vocabulary has its shape's vector.

A document is the mean of its words' vectors, the mean over its distinct words, and three numbers of length and
variety. Two layers (tanh, then logistic) are trained by full-batch Adam; a temperature fitted on a part of the
sample that the network hasn't seen calibrates the probabilities.

Only fitting uses a sample: at most ``ROWS`` labelled rows outside the held-out fold, the first by a hash of doc_id. The
vocabulary is their ``VOCABULARY`` most frequent words and ``SHAPES`` most frequent shapes. Every text is scored whole.

Defined results: null and empty texts are zero vectors and get the score of these; labels of a document that is
labelled twice are averaged; rows without labels or with null labels teach nothing; with no labels of both kinds every
score is the share of label 1 (0.5 if there are none); rows are scored one by one; extra columns aren't read by
:func:`score`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import cut, fold, ready, table

ROWS, VOCABULARY, SIZE, DARTS, REACH = 4_000, 8_192, 48, 6, 2
BLOCK = 4_096  # words whose neighbours are summed at once
SHAPES = 4_096
HIDDEN, STEPS, RATE, DECAY = 24, 400, 0.02, 1e-4
THRESHOLD = 0.7
PIECE = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = "".join(map(chr, [32, *range(9, 14)]))


def shape(word: str) -> str:
    """Runs of A, a and 0; other characters as they are, each once in a row."""
    out = ""
    for c in word[:40]:
        s = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdecimal() else c
        if not out.endswith(s):
            out += s
    return "\0" + out[:12]


def index_vector(unit: str) -> np.ndarray:
    """The unit's sparse ternary vector."""
    raw = hashlib.blake2b(unit.encode("utf-8", "surrogatepass"), digest_size=2 * DARTS).digest()
    out = np.zeros(SIZE, np.int64)
    for n in range(DARTS):
        out[raw[2 * n] % SIZE] += 1 if raw[2 * n + 1] & 1 else -1
    return out


def split(text: str | None) -> list[str]:
    return PIECE.findall(text) if text else []


@dataclass
class Vectors:
    """Vectors of units, one row each; row 0 is of unknown shapes."""

    rows: dict[str, int]
    matrix: np.ndarray
    seen: dict[str, int] = field(default_factory=dict)

    def row(self, word: str) -> int:
        """Row of a word, its lower case, or its shape."""
        if (found := self.seen.get(word)) is None:
            own = self.rows.get(word.lower()) if word[:1].islower() or word[1:].islower() else None
            found = own if own is not None else self.rows.get(shape(word), 0)
            if len(self.seen) >= 50_000:
                self.seen.clear()
            self.seen[word] = found
        return found

    def pool(self, text: str | None) -> np.ndarray:
        """The vector of a text."""
        found = Counter(split(text))
        if not found:
            return np.zeros(2 * SIZE + 3, np.float32)
        at = np.fromiter(map(self.row, found), np.int64, len(found))
        times = np.fromiter(found.values(), np.float64, len(found))
        total = times.sum()
        weight = np.bincount(at, times, minlength=0)
        kinds = np.bincount(at, minlength=0)
        used = np.flatnonzero(kinds)
        m = self.matrix[used]
        numbers = [math.log1p(total) / 5, len(found) / total, math.log1p(sum(map(len, found)) / len(found)) / 2]
        return np.concatenate([weight[used] @ m / total, kinds[used] @ m / len(found), numbers]).astype(np.float32)


def vectors(sample: DataFrame, text: str = "text") -> Vectors:
    """Word vectors of a bounded sample; sums are made on the executors."""
    ready(sample.sparkSession)
    word = F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    top = sample.select(word.alias("word")).where(F.length("word") <= 40).groupBy("word").count().orderBy(F.desc("count"), "word").limit(VOCABULARY)
    known = sorted(r["word"] for r in top.collect())
    shared = sample.sparkSession.sparkContext.broadcast(set(known))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        times: Counter[str] = Counter()
        cache: dict[str, np.ndarray] = {}

        def vector(unit):
            if (v := cache.get(unit)) is None:
                v = cache[unit] = index_vector(unit)
            return v

        names = shared.value
        for batch in batches:
            for t in batch.column(0).to_pylist():
                ws = split(t)
                shapes = [shape(w) for w in ws]
                units = [w.lower() for w in ws]
                units = [u if u in names else s for u, s in zip(units, shapes)]
                if not ws:
                    continue
                codes = {u: n for n, u in enumerate({*units, *shapes})}
                times.update(shapes)
                table_ = np.stack([vector(u) for u in codes])
                u, s = np.array([codes[x] for x in units]), np.array([codes[x] for x in shapes])
                local = np.zeros((len(codes), SIZE), np.int64)
                for at in range(0, len(ws), BLOCK):
                    left, end = max(0, at - REACH), min(len(ws), at + BLOCK)
                    near = table_[u[left : end + REACH]]
                    total = table_[u[at:end]] + table_[s[at:end]]
                    for step in range(-REACH, REACH + 1):
                        lo, hi = max(0, at + step), min(len(ws), end + step)
                        if step and lo < hi:
                            total[lo - step - at : hi - step - at] += near[lo - left : hi - left]
                    np.add.at(local, u[at:end], total)
                    apart = s[at:end] != u[at:end]
                    np.add.at(local, s[at:end][apart], total[apart])
                for name, n in codes.items():
                    if local[n].any():
                        sums[name] = sums[name] + local[n] if name in sums else local[n].copy()
        keys = list(sums)
        for at in range(0, len(keys), 2000):
            part = keys[at : at + 2000]
            flat = np.concatenate([sums[k] for k in part])
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([times[k] for k in part], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * SIZE), pa.array(flat))], names=["unit", "n", "v"])

    parts = sample.select(F.col(text)).mapInArrow(run, "unit string, n bigint, v array<bigint>")
    rows = parts.groupBy("unit").agg(F.sum("n").alias("n"), *[F.sum(F.col("v")[n]).alias(f"v{n}") for n in range(SIZE)])
    # Words come first, as shapes begin with the least character and only these are counted; both are bounded.
    kept = sorted(rows.orderBy(F.col("unit").startswith("\0"), F.desc("n"), "unit").limit(VOCABULARY + SHAPES).drop("n").collect())
    matrix = np.array([[0.0] * SIZE, *[[float(x) for x in r[1:]] for r in kept]])
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return Vectors({r["unit"]: n + 1 for n, r in enumerate(kept)}, (matrix / np.where(norm == 0, 1, norm)).astype(np.float32))


@dataclass
class Network:
    """Two layers over standardised inputs; the temperature divides the last one's output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return (h * self.w2).sum(axis=-1) + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Fit on four of five rows, the temperature on the fifth."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    rng = np.random.default_rng(0)
    net = Network(mean, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    share = float(y.mean()) if len(y) else 0.5
    if len(set(y)) < 2:  # nothing to tell apart
        net.w2[:] = 0
        net.b2 = math.log((share + 1e-3) / (1 - share + 1e-3))
        return net
    last = np.arange(len(x)) % 5 == 4
    if len(x) < 50 or len(set(y[~last])) < 2:
        last[:] = False
    a, t = (x[~last] - mean) / scale, y[~last]
    weight = np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean()))  # both classes count alike
    parameters = [net.w1, net.b1, net.w2, np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    for step in range(1, STEPS + 1):
        h = np.tanh(a @ parameters[0] + parameters[1])
        p = 1 / (1 + np.exp(-np.clip(h @ parameters[2] + parameters[3], -30, 30)))
        d = (p - t) * weight / len(t)
        back = np.outer(d, parameters[2]) * (1 - h * h)
        grads = [a.T @ back + DECAY * parameters[0], back.sum(axis=0), h.T @ d + DECAY * parameters[2], np.array([d.sum()])]
        for n, g in enumerate(grads):
            m, v = moments[n]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            parameters[n] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(parameters[3][0])
    if last.any() and 0 < y[last].mean() < 1:
        z, t = net.logit(x[last]), y[last]
        weight = np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean()))

        def loss(temperature):
            q = np.clip(z / temperature, -30, 30)
            return float((weight * (np.logaddexp(0, q) - t * q)).sum())

        net.temperature = min((0.25 * 1.1**n for n in range(40)), key=loss)
    return net


@dataclass
class Model:
    vectors: Vectors
    network: Network


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """At most ``rows`` (doc_id, text, label) outside the held-out fold, the first by a hash."""
    known = labels.where(F.col("`quality`").isNotNull() & F.col("`doc_id`").isNotNull() & (fold(F.col("`doc_id`")) != 2)).groupBy(F.col("`doc_id`").cast("long").alias("doc_id")).agg(F.avg("`quality`").alias("label"))
    key = F.md5(F.concat(F.lit("quality:"), F.col("doc_id").cast("string")))
    # Half of the sample for each label, as far as there are rows: junk may be rare.
    some = [known.where(which).orderBy(key, "doc_id").limit(rows // 2) for which in (F.col("label") >= 0.5, F.col("label") < 0.5)]
    chosen = cut(some[0].unionByName(some[1]))
    texts = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    # The sample's size is bounded by a parameter, so it may be sent to all.
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.when(F.col("label") >= 0.5, 1).otherwise(0).alias("label"))


def fit(sample: DataFrame) -> Model:
    """A model of (doc_id, text, label)."""
    sample = cut(sample).repartition(12, "doc_id")
    v = vectors(sample)
    shared = sample.sparkSession.sparkContext.broadcast(v)

    def run(batches):
        for batch in batches:
            pooled = [shared.value.pool(t) for t in batch.column(1).to_pylist()]
            flat = np.concatenate(pooled) if pooled else np.zeros(0, np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(np.arange(len(pooled) + 1, dtype=np.int32) * (2 * SIZE + 3)), pa.array(flat))], names=["doc_id", "label", "x"])

    rows = sample.select("doc_id", "text", "label").mapInArrow(run, "doc_id bigint, label int, x array<float>").collect()
    rows.sort(key=lambda r: (hashlib.md5(str(r["doc_id"]).encode()).digest(), r["label"], r["x"]))
    x = np.array([r["x"] for r in rows], np.float64).reshape(len(rows), 2 * SIZE + 3)
    return Model(v, train(x, np.array([r["label"] for r in rows])))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """All columns, and the probability that the text is good."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(model)
    at, names = docs.columns.index(text), docs.columns

    def run(batches):
        m = shared.value
        for batch in batches:
            x = [m.vectors.pool(t) for t in batch.column(at).to_pylist()]
            p = m.network.probability(np.stack(x).astype(np.float64)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*names, into])

    return docs.mapInArrow(run, ", ".join([*[f"`{c}` {t}" for c, t in docs.dtypes], f"`{into}` double"]))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; labels of the held-out fold teach nothing."""
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model).drop("text")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
