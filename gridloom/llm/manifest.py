"""A Merkle manifest of a dataset: a hash tree for each source and one above them, with a proof for each document.

A leaf is the hash of a document's fields. Per source, leaves ascend by doc_id, and every ``BASE`` consecutive nodes
become their hash until one is left; the sources' roots, in order of the sources, likewise give the dataset's.

Ranks without a global sort: a document's place in its source is the number of smaller ids. Digits of ``BITS`` bits of
the id make a hierarchy of nodes; their counts are summed upwards, level by level, until a source has one node, and go
down again as starts: a node's start is its parent's and the counts of its smaller siblings, at most 2 ** BITS of them.
Inside the lowest node, rows are numbered in order. No task sorts more than a node's rows.

The tree: the digits of a rank to ``BASE`` are the path from the root, so nodes that share all but the last ``DEPTH``
digits are one run of at most BASE ** DEPTH rows. A run is one row of a table and gives ``DEPTH`` levels at once; tables
shrink by that factor from tier to tier, and are written. Proofs go down the tiers the same way: an item's siblings in
its run come before those of its run's own path. A hot source is many runs.

Sources are ranked as a list of one row each: dealt out in order by Spark's range partitioning, and numbered within a
part after the sizes of the parts before it.

Defined results: null fields are ``-``; a null doc_id comes after all others in its source and counts as empty text for
its checksum; a null source is a source of its own, the first one; rows with equal doc_id come in order of their leaves,
and equal rows are interchangeable (rows of one id stand in one task's sort, which spills); a source of one document has
its leaf as root; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import cut, drop, ready, table

BASE, DEPTH, BITS = 3, 5, 8
RUN = BASE**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """Hash of fields: ``-`` for null, else the number of bytes, a colon, and the value."""
    shown = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*shown), 256)


def ranked(rows: DataFrame) -> DataFrame:
    """Rows (key, id, leaf, ...) with ``place`` in the order of their key's ids, from 0, and the number ``n`` of the key's rows."""
    at = F.coalesce(F.col("id"), F.lit((1 << 63) - 1).cast("long"))
    rows = rows.withColumn("node", F.shiftright(at, BITS))
    steps = [cut(rows.groupBy("key", "node").agg(F.count(F.lit(1)).alias("many")))]
    # After 56 bits at most 256 nodes are left for a key, whatever the ids.
    while len(steps) * BITS < 56 and not steps[-1].groupBy("key").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1").isEmpty():
        steps.append(cut(steps[-1].groupBy("key", F.shiftright("node", BITS).alias("node")).agg(F.sum("many").alias("many"))))

    def before(*by: str) -> Column:
        return F.coalesce(F.sum("many").over(Window.partitionBy(*by).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    starts = steps[-1].select("key", "node", before("key").alias("start"), F.sum("many").over(Window.partitionBy("key")).alias("n"))
    for step in reversed(steps[:-1]):
        children = step.withColumn("above", F.shiftright("node", BITS)).join(starts.withColumnRenamed("node", "above"), ["key", "above"])
        starts = children.select("key", "node", (F.col("start") + before("key", "above")).alias("start"), "n")
    within = Window.partitionBy("key", "node").orderBy(at, F.col("id").isNull(), "leaf")
    return rows.join(starts, ["key", "node"]).withColumn("place", F.col("start") + F.row_number().over(within) - 1).drop("node", "start")


def _above(nodes: str) -> Column:
    """Hashes of every BASE consecutive nodes of an array."""
    return F.transform(F.sequence(F.lit(0), ((F.size(nodes) - 1) / BASE).cast("int")), lambda t: F.sha2(F.array_join(F.slice(nodes, t * BASE + 1, BASE), ""), 256))


def tiers(items: DataFrame) -> list[DataFrame]:
    """Tables (key, run, n, items, node) of runs of items (key, place, n, hash, id, given), from the leaves up.

    A run's items are an array in order; ``n`` is the number of items of its key in this tier. A key ends in the tier in
    which its items fit one run; that run's node is its root.
    """
    found = []
    while True:
        run = F.array_sort(F.collect_list(F.struct("place", "hash", "id", "given")))  # at most RUN of them
        rows = items.groupBy("key", F.expr(f"place div {RUN}").alias("run"), "n").agg(run.alias("items"))
        rows = rows.withColumn("_0", F.col("items.hash"))
        for d in range(DEPTH):
            done = (F.col("n") <= RUN) & (F.size(f"_{d}") == 1)
            rows = rows.withColumn(f"_{d + 1}", F.when(done, F.col(f"_{d}")).otherwise(_above(f"_{d}"))).drop(*[f"_{d}"] * (d > 0))
        found.append(cut(rows.select("key", "run", "n", "items", F.col(f"_{DEPTH}")[0].alias("node"))))
        more = found[-1].where(F.col("n") > RUN)
        if more.isEmpty():
            return found
        items = more.select("key", F.col("run").alias("place"), F.ceil(F.col("n") / RUN).alias("n"), F.col("node").alias("hash"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("given"))


def levels(hashes: list[str], whole: bool) -> list[list[str]]:
    """A run's nodes, level by level: DEPTH of them above it, or, if it is whole, until one node is left."""
    found = [hashes]
    while len(found[-1]) > 1 if whole else len(found) <= DEPTH:
        last = found[-1]
        found.append([hashed("".join(last[k : k + BASE])) for k in range(0, len(last), BASE)])
    return found


PATH = "key string, place long, hash string, id long, given string, root string, lefts array<string>, rights array<string>"


def _paths(batches):
    """Items of runs with what stands left and right of them on each level up to the root."""
    text = pa.string()
    for batch in batches:
        for row in batch.to_pylist():
            tree = levels([x["hash"] for x in row["items"]], row["n"] <= RUN)
            lefts, rights = [], []
            for t in range(len(row["items"])):
                left, right = [], []
                for level in tree[:-1]:
                    first = t - t % BASE
                    left.append("".join(level[first:t]))
                    right.append("".join(level[t + 1 : first + BASE]))
                    t //= BASE
                lefts.append(left + row["lefts"])
                rights.append(right + row["rights"])
            of, many = row["items"], len(row["items"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["key"]] * many, text), pa.array([x["place"] for x in of], pa.int64()), pa.array([x["hash"] for x in of], text), pa.array([x["id"] for x in of], pa.int64()), pa.array([x["given"] for x in of], text), pa.array([row["root"]] * many, text), pa.array(lefts, pa.list_(text)), pa.array(rights, pa.list_(text))],
                names=["key", "place", "hash", "id", "given", "root", "lefts", "rights"],
            )


def paths(of: list[DataFrame], tops: DataFrame | None) -> DataFrame:
    """Items of the lowest tier (key, place, hash, id, given, root, lefts, rights): their siblings up to the root.

    ``tops`` has a row (key, root, lefts, rights) for each key: what follows above its own root. None stands above one tree.
    """
    ready(of[0].sparkSession)
    none = F.array().cast("array<string>")
    lower, made = None, []
    for n, tier in reversed(list(enumerate(of))):
        rows = tier.where(F.col("n") <= RUN)
        rows = rows.join(tops, "key") if tops is not None else rows.select("*", F.col("node").alias("root"), none.alias("lefts"), none.alias("rights"))
        if lower is not None:
            rows = rows.unionByName(tier.where(F.col("n") > RUN).join(lower.select("key", F.col("place").alias("run"), "root", "lefts", "rights"), ["key", "run"]))
        lower = rows.select("key", "n", "items", "root", "lefts", "rights").mapInArrow(_paths, PATH)
        if n:
            lower = cut(lower)
            made.append(lower)
    drop(*made[:-1])
    return lower


def listed(keys: DataFrame) -> DataFrame:
    """Rows (key, ...), one for each key, with ``place`` in the order of the keys and their number ``n``."""
    dealt = cut(keys.repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("many"))  # one row a task
    order = Window.orderBy("part")
    starts = parts.select("part", (F.sum("many").over(order) - F.col("many")).alias("start"), F.sum("many").over(Window.partitionBy()).alias("n"))
    return dealt.join(F.broadcast(starts), "part").withColumn("place", F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1).drop("part", "start")


@dataclass(frozen=True)
class Manifest:
    """Tiers of the documents' trees and of the tree above them, and the root of all."""

    documents: list[DataFrame]
    sources: list[DataFrame]
    root: str | None


def build(rows: DataFrame) -> Manifest:
    """The manifest of rows (key, id, leaf, given): their source, id, hash, and whatever text is to be carried along."""
    lower = tiers(ranked(rows).withColumnRenamed("leaf", "hash"))
    roots = reduce(DataFrame.unionByName, [t.where(F.col("n") <= RUN).select("key", "node") for t in lower])
    upper = tiers(listed(roots).select(F.lit("").alias("key"), "place", "n", F.col("node").alias("hash"), F.lit(None).cast("long").alias("id"), F.col("key").alias("given")))
    last = upper[-1].where(F.col("n") <= RUN).first()
    return Manifest(lower, upper, last and last["node"])


def proofs(of: Manifest) -> DataFrame:
    """(key, place, hash, id, given, root, lefts, rights) for each row: ``root`` is its source's, and what stands left and
    right of it on each level leads through that to the root of all."""
    sources = cut(paths(of.sources, None).select(F.col("given").alias("key"), F.col("hash").alias("root"), "lefts", "rights"))
    return paths(of.documents, sources)


def folded(start: Column) -> Column:
    """The root that a hash leads to by a row's proof."""
    return F.aggregate(F.arrays_zip("lefts", "rights"), start, lambda acc, x: F.sha2(F.concat(x["lefts"], acc, x["rights"]), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(key, id, leaf, given) of documents; ``given`` is the leaf of a tampered copy, null where that is the same."""
    fields = {c: F.col(f"`{c}`") for c in FIELDS}
    number = F.crc32(F.coalesce(fields["doc_id"].cast("string"), F.lit("")))
    spoilt = fields | {"text": F.translate(fields["text"].cast("string"), "\n", "")}
    source = fields["source"].cast("string")
    rows = docs.select(F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("key"), fields["doc_id"].cast("long").alias("id"), leaf(*fields.values()).alias("leaf"), F.when((number % 2 == 0) & (F.instr(fields["text"], "\n") > 0), leaf(*spoilt.values())).alias("given"))
    return cut(rows)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, checked with copies that are tampered with where a checksum says so."""
    whole = build(leaves(table(spark, sf_dir, "documents")))
    every = F.transform(F.arrays_zip("lefts", "rights"), lambda x: F.concat(x["lefts"], x["rights"]))
    told = proofs(whole).select(
        F.col("id").alias("doc_id"), F.col("hash").alias("leaf"), F.col("root").alias("subroot"), F.lit(whole.root).cast("string").alias("root"),
        F.sha2(F.array_join(every, ""), 256).alias("proof_sha256"), folded(F.coalesce("given", "hash")).alias("folded_root"),
    )
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels_: int = 14) -> str:
    """Level by level: nodes, then each node's siblings, then every document's way up. Enough for BASE ** levels_ nodes."""
    field = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    head = " || ".join(field(c) for c in FIELDS[:-1])
    crc = "xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint)), lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295), 4294967295)"
    parts = [f"leaf as materialized (select doc_id, case when source is null then '' else '=' || source end as s, sha256({head} || {field('text')}) as h, case when {crc} % 2 = 0 then sha256({head} || {field("replace(text, chr(10), '')")}) else sha256({head} || {field('text')}) end as given from documents)"]
    parts.append("placed as materialized (select *, row_number() over (partition by s order by doc_id) - 1 as p, count(*) over (partition by s) as n from leaf)")

    def tree(t: str, first: str) -> None:
        parts.append(f"{t}0 as materialized ({first})")
        for k in range(levels_):
            side = "coalesce(string_agg(h, '' order by p) over (partition by s, p // 3 order by p rows between {0}), '')"
            parts.append(f"{t}s{k} as materialized (select s, p, n, case when n = 1 then '' else {side.format('unbounded preceding and 1 preceding')} end as l, case when n = 1 then '' else {side.format('1 following and unbounded following')} end as r from {t}{k})")
            parts.append(f"{t}{k + 1} as materialized (select s, p // 3 as p, (n + 2) // 3 as n, case when n = 1 then min(h) else sha256(string_agg(h, '' order by p)) end as h from {t}{k} group by s, p // 3, n)")

    def climb(d: str, t: str, first: str) -> None:
        parts.append(f"{d}0 as materialized ({first})")
        for k in range(levels_):
            parts.append(f"{d}{k + 1} as materialized (select d.* exclude (p, acc, proof), d.p // 3 as p, case when n = 1 then acc else sha256(l || acc || r) end as acc, proof || l || r as proof from {d}{k} d join {t}s{k} t on t.s = d.key and t.p = d.p)")

    tree("t", "select s, p, n, h from placed")
    tree("u", f"select '' as s, row_number() over (order by s) - 1 as p, count(*) over () as n, h from t{levels_}")
    parts.append(f"sub as materialized (select s, h, row_number() over (order by s) - 1 as p from t{levels_})")
    climb("d", "t", "select doc_id, h as leaf, s as key, s, p, given as acc, '' as proof from placed")
    climb("e", "u", f"select doc_id, leaf, '' as key, sub.h as subroot, sub.p as p, acc, proof from d{levels_} d join sub using (s)")
    root = f"(select h from u{levels_})"
    return f"with {', '.join(parts)} select doc_id, leaf, subroot, {root} as root, sha256(proof) as proof_sha256, acc as folded_root, acc = {root} as verified from e{levels_}"


SQL = _sql()
