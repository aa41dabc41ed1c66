"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1 bits. For each bit a linear n-gram classifier tells which half of the
languages a text is in; a text's language is the one whose codeword loses least: the sum over bits of the logistic loss
of codeword times margin, weighted by how well that bit was told on rows left out of its fit. With up to six languages
the code has all 2^(n-1) - 1 splits, beyond that ``BITS`` random ones, kept apart by choosing them greedily.

Features are counts of 1-, 2- and 3-grams of code points in lower case, hashed to ``BUCKETS``, as square roots of their
shares. Whatever is no letter counts as a space and runs of spaces as one, so punctuation and digits tell nothing.

Only fitting uses a sample: at most ``ROWS`` documents of each language outside the held-out fold, chosen by a hash of
doc_id; with more than ``SAMPLE`` / ``ROWS`` languages each has an equal part of ``SAMPLE``, at least one. Every text is
read whole, in blocks.

Defined results: ``und`` and score 0 for null, empty and letterless texts; with nothing to learn from, all texts are
``und``; the score is the winner's share of exp(-loss), and ``ambiguous`` is set where the second codeword's loss is
nearer than ``MARGIN``; rows are handled one by one; rows with null lang teach nothing; extra columns aren't read.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import cut, fold, ready, table

BUCKETS, ROWS, BITS, STEPS, RATE, MARGIN = 1 << 12, 400, 31, 150, 0.05, 0.5
SAMPLE = 4_800  # rows of all languages, of 16 KB each
BLOCK = 1 << 18  # characters read at once
SALTS = 256  # parts of a language among which the sample is first sought


def grams(text: str | None) -> np.ndarray | None:
    """Feature vector of a text; None if it has no letter."""
    if not text:
        return None
    total, letters = np.zeros(BUCKETS, np.int64), 0
    for at in range(0, len(text), BLOCK):
        low = text[max(0, at - 2) : at + BLOCK].lower()
        c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        ascii_letter = (c >= 97) & (c <= 122)
        letter = ascii_letter.copy()
        high = np.flatnonzero(c >= 128)
        if len(high):
            kinds, back = np.unique(c[high], return_inverse=True)
            letter[high] = np.array([chr(x).isalpha() for x in kinds])[back]
        letters += int(letter.sum())
        c = np.where(letter, c, 32)
        gap = c == 32
        c = c[~(gap & np.concatenate([[True], gap[:-1]]))]
        c = np.concatenate([c, np.full(1, 32, np.uint32)]) if len(c) and c[-1] != 32 else c
        if len(c) < 3:
            c = np.concatenate([c, np.full(3 - len(c), 32, np.uint32)])
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
        three = two[:-1] * np.uint32(0x85EBCA6B) + c[2:]
        for h in (c * np.uint32(0xC2B2AE35), two * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)):
            total += np.bincount((h >> np.uint32(7)) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    if not letters:
        return None
    return np.sqrt(total / total.sum())


def codewords(n: int) -> np.ndarray:
    """Codewords of n languages, one row each."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, np.int8).T
    rng = np.random.default_rng(0)
    drawn = rng.choice(np.array([1, -1], np.int8), (n, 64 * BITS))
    kept = [c for c in drawn.T if 0.3 <= (c == 1).mean() <= 0.7] or list(drawn.T)
    out = [kept[0]]
    while len(out) < max(BITS, 2 * int(np.ceil(np.log2(n)))):
        out.append(min(kept, key=lambda c: max(abs(int(c.astype(int) @ o)) for o in out)))
    return np.array(out, np.int8).T


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (BUCKETS + 1, bits), the last row is the offset
    trust: np.ndarray  # of each bit

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether another is nearly as near."""
        x = grams(text) if self.languages else None
        if x is None:
            return "und", 0.0, True
        margin = x @ self.weights[:-1] + self.weights[-1]
        loss = (np.logaddexp(0, -self.code * margin) * self.trust).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        share = np.exp(-(loss - loss[order[0]]))
        close = len(order) > 1 and loss[order[1]] - loss[order[0]] < MARGIN
        return self.languages[order[0]], float(1 / share.sum()), bool(close)


def train(x: np.ndarray, lang: list[str]) -> Model:
    """Fit each bit on four of five rows by full-batch Adam; the fifth tells how far to trust it."""
    languages = sorted(set(lang))
    code = codewords(len(languages))
    number = np.array([languages.index(v) for v in lang], np.int64)
    if len(languages) < 2:
        return Model(languages, code, np.zeros((BUCKETS + 1, code.shape[1])), np.ones(code.shape[1]))
    x = np.hstack([x, np.ones((len(x), 1))])
    y = code[number].astype(np.float64)
    last = np.arange(len(x)) % 5 == 4
    fitted = ~last if len(x) >= 50 else np.ones(len(x), bool)
    a, t = x[fitted], y[fitted]
    share = np.bincount(number[fitted], minlength=len(languages)) / fitted.sum()
    weight = (1 / np.maximum(share, 1e-9) / len(languages))[number[fitted]][:, None] / len(a)
    w = np.zeros((x.shape[1], code.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        g = -a.T @ (t / (1 + np.exp(np.clip(t * (a @ w), -30, 30))) * weight) + 1e-6 * w
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    right = ((x[last] @ w > 0) == (y[last] > 0)).mean(axis=0) if last.any() else np.ones(code.shape[1])
    trust = np.log((right + 0.02) / (1.02 - right))
    return Model(languages, code, w, np.maximum(trust, 0.01) / max(np.maximum(trust, 0.01).mean(), 1e-9))


def fit(docs: DataFrame, rows: int = ROWS) -> Model:
    """A model of (doc_id, text, lang) outside the held-out fold."""
    ready(docs.sparkSession)
    own = docs.select(F.col("`doc_id`").cast("string").alias("doc_id"), F.col("`text`").cast("string").alias("text"), F.col("`lang`").cast("string").alias("lang")).where(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 2))
    rows = max(1, min(rows, SAMPLE // max(1, own.select("lang").distinct().count())))
    place = F.crc32(F.concat(F.lit("langid:"), F.coalesce("doc_id", F.lit("")))) / F.lit(2.0**32)
    # The first of each of SALTS parts of a language, then the first of these: a common language isn't one task's.
    ids = own.select("doc_id", "lang", place.alias("place"), (F.crc32(F.concat(F.lit("salt:"), F.coalesce("doc_id", F.lit("")))) % SALTS).alias("salt"))
    for keys in (["lang", "salt"], ["lang"]):
        ids = ids.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("place", "doc_id"))).where(F.col("r") <= rows)
    chosen = cut(ids.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct())
    # The sample's size is bounded by SAMPLE, or by one row a language.
    sample = own.join(F.broadcast(chosen), own["doc_id"].eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("doc_id", "lang", "text")

    def run(batches):
        for batch in batches:
            found = [(d, v, x) for d, v, t in zip(*[c.to_pylist() for c in batch.columns]) if (x := grams(t)) is not None]
            data = [x.astype(np.float32).tobytes() for _, _, x in found]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in found], pa.string()), pa.array([v for _, v, _ in found], pa.string()), pa.array(data, pa.binary())], names=["doc_id", "lang", "x"])

    found = sample.mapInArrow(run, "doc_id string, lang string, x binary").collect()
    found.sort(key=lambda r: (hash_of(r["doc_id"]), r["lang"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in found], np.float32).reshape(len(found), BUCKETS)
    return train(x, [r["lang"] for r in found])


def hash_of(text: str | None) -> int:
    import zlib

    return zlib.crc32(f"order:{text}".encode())


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, lang_pred, score and ambiguous of every row."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], names=[*keep, "lang_pred", "score", "ambiguous"])

    kept = docs.select(F.col(f"`{text}`").cast("string").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    return kept.mapInArrow(run, ", ".join([*[f"`{c}` {t}" for c, t in kept.dtypes[1:]], "lang_pred string, score double, ambiguous boolean"]))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
