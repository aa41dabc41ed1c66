"""From raw documents to token ids: quality, near duplicates, personal data, mixture, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet, and the next stage reads that.
All but the last return the columns of ``documents``: doc_id, text, lang, source, n_chars.

Defined results: columns beyond these are dropped at the start; null and empty texts are scored, and linked to nothing;
an empty table gives no rows; a document that the mixture takes twice comes out twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, mixing, neardup, pii, quality
from gridloom.llm.common import cut, drop, only, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose calibrated probability of being good is below this go.
LEAST_QUALITY = 0.5


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    docs = only(docs, *COLUMNS)
    model = quality.fit(quality.training_rows(docs, table(spark, sf_dir, "labels")))
    return quality.score(docs, model, into="_score").where(F.col("_score") >= LEAST_QUALITY).select(*COLUMNS)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.deduplicate(only(docs, *COLUMNS))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(only(docs, *COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mix(only(docs, *COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256) of every row."""
    coded = bpe.decode(bpe.encode(docs, keep=("doc_id", "lang", "source")))
    return bpe.digests(coded, keep=("doc_id", "lang", "source", "ids")).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", good),
    ("MinHash near-dedup", unique),
    ("PII", private),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", tokens),
]
#: SQL can't express a trained classifier or sketches; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each over what the one before it has written."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = cut(docs)
            if n:  # the first stage has read the input
                drop(before)
    return docs
