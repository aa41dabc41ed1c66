"""Exact duplicates: a persistent index of digests, bucketed and sorted by them, that new rows are joined against.

Texts are equal when they are identical without ASCII white space; their digest is the SHA-256 of that. The index is a
table (digest, keep_id, n_chars, batch) in a folder, clustered by digest into a fixed number of buckets, each sorted by
it. A batch is summed by digest first, so a group of copies, however large, sends one row a task to the shuffle. Its
digests go to the index by a sort-merge anti-join that reads the buckets as they lie, without shuffling them, and those
that no batch has brought yet are appended. So a round costs the new rows' shuffle and one sequential read of the index.

A row learns what became of its group by a join on the digest. Groups above one in a thousand rows, which can't be more
than a thousand, are looked up in a broadcast table, so no task gets all rows of a large group.

Batches are labelled. What a batch has appended itself doesn't count as known to it, so a batch that is run again, after
a lost driver too, gets the same answers and appends nothing twice. Batches of one index must run one after another.

Defined results: a null text counts as empty, and empty or blank texts are copies of each other. Of a group of new rows
the one with the longest text stays, then that with the smallest doc_id (null last), then the first as read; a digest
that an earlier batch has brought keeps none. group_size counts rows of the batch. Repeated rows are copies like others.
An empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import cut, drop, fresh, only, scratch, table

BLANKS = " \t\n\x0b\x0c\r"
#: Groups above one in so many rows are broadcast: at most so many groups.
LARGE = 1000


def normal(text: str = "text") -> F.Column:
    """The text without ASCII white space; null is empty."""
    return F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), BLANKS, "")


def digests(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_chars, digest) of each document; texts are read once and go no further."""
    text = F.coalesce(F.col("`text`").cast("string"), F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("`doc_id`").alias("doc_id"), F.length(text).cast("long").alias("n_chars"),
        F.unhex(F.sha2(normal(), 256)).alias("digest"),
    )


@dataclass(frozen=True)
class Index:
    """Digests that were seen, in a folder that all can reach."""

    spark: SparkSession
    path: str
    name: str
    buckets: int

    @staticmethod
    def open(spark: SparkSession, path: str, buckets: int | None = None) -> Index:
        """The index in a folder, made there if there is none; its number of buckets is fixed by the first to open it.

        A bucket should hold some 100 MB: 40 bytes a text.
        """
        path = path.rstrip("/")
        wanted = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.range(1).select(F.lit(wanted).alias("buckets")).write.mode("ignore").parquet(f"{path}/about")
        buckets = spark.read.parquet(f"{path}/about").first()["buckets"]
        name = f"digests_{hashlib.md5(path.encode()).hexdigest()}"
        where = f"{path}/digests".replace("'", "\\'")
        spark.sql(f"create table if not exists {name} (digest binary, keep_id bigint, n_chars bigint, batch string) using parquet clustered by (digest) sorted by (digest) into {buckets} buckets location '{where}'")
        spark.catalog.refreshTable(name)
        return Index(spark, path, name, buckets)

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, new: DataFrame) -> None:
        """Add (digest, keep_id, n_chars, batch) rows; dealt as the buckets are, a task writes one of them."""
        dealt = new.select("digest", F.col("keep_id").cast("long").alias("keep_id"), "n_chars", "batch").repartition(self.buckets, "digest")
        dealt.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def judge(docs: DataFrame, index: Index, batch: str) -> DataFrame:
    """(row, doc_id, digest, keep_id, group_size, kept) for each document; its new digests are in the index afterwards."""
    rows = cut(digests(docs))
    # Of a group of copies the longest text stays; minima and counts are taken before the shuffle, too.
    first = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = cut(rows.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")))
    earlier = index.rows.where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("old"))
    found = groups.join(earlier.hint("merge"), "digest", "left")
    found = cut(found.select("digest", "group_size", F.when(F.col("old"), F.col("old_id")).otherwise(F.col("first.doc_id")).alias("keep_id"), F.when(F.col("old").isNull(), F.col("first.row")).alias("keep_row")))
    new = groups.join(index.rows.hint("merge"), "digest", "left_anti")
    index.append(new.select("digest", F.col("first.doc_id").alias("keep_id"), (-F.col("first.less")).alias("n_chars"), F.lit(batch).alias("batch")))
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    drop(groups)
    large = F.broadcast(found.where(F.col("group_size") * LARGE > total))
    of_large = rows.join(large, "digest")
    of_rest = rows.join(large.select("digest"), "digest", "left_anti").join(found.hint("merge"), "digest")
    told = of_large.unionByName(of_rest)
    return told.select("row", "doc_id", "digest", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"))


def unique(docs: DataFrame, index: Index, batch: str) -> DataFrame:
    """The documents, with all their columns, that bring a text that the index hasn't seen.

    Rows are found again by doc_id and digest; only where rows share both are they told apart by a second shuffle.
    """
    verdict = cut(judge(docs, index, batch).select("doc_id", "digest", "kept"))
    digest = fresh(docs, "_digest")
    stay = verdict.where("kept").select(F.col("doc_id").alias("_keep"), F.col("digest").alias("_of"))
    out = docs.withColumn(digest, F.unhex(F.sha2(normal(), 256)))
    out = out.join(stay, (F.col(digest) == stay["_of"]) & out["`doc_id`"].eqNullSafe(stay["_keep"]), "left_semi")
    twice = verdict.groupBy("digest", "doc_id").agg(F.count_if("kept").alias("k"), F.count(F.lit(1)).alias("n")).where("k > 0 and n > 1")
    return (out if twice.isEmpty() else out.dropDuplicates([digest, "doc_id"])).drop(digest)


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the first batch of a new index."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    home = f"{scratch(spark)}/index-{hashlib.md5(f'{sf_dir}:{spark.sparkContext.applicationId}:{spark.sparkContext.startTime}'.encode()).hexdigest()}"
    told = judge(docs, Index.open(spark, home), "documents")
    return told.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
with d as (
  select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as t from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by t) as group_size, row_number() over w = 1 as kept, sha256(t) as text_sha256
from d window w as (partition by t order by n desc, doc_id)
"""
