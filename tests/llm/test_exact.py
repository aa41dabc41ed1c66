import hashlib
import re
from collections import Counter, defaultdict

import duckdb
from gridloom.llm import common, exact
from pyspark.sql import functions as F


def plain(text):
    return hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", text or "").encode()).hexdigest()


def by_hand(rows):
    """(doc_id, keep_id, group_size, kept, digest) of (doc_id, text) rows with different ids."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[plain(t)].append((-len(t or ""), d is None, d or 0, d))
    return sorted(((d, min(g)[3], len(g), min(g)[3] == d, k) for k, g in groups.items() for _, _, _, d in g), key=str)


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_hot_group_and_sql(spark, documents):
    rows = [(n, "the  same text" + " " * (n % 5) if n % 3 == 0 else f"text {n % 400}\n" + "\t" * (n % 7)) for n in range(3000)]
    path = documents(rows)
    got = shown(exact.op13_exact(spark, path))
    assert got == by_hand(rows)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(exact.SQL).fetchall(), key=str)
    # A second run finds its own batch in the index and changes nothing.
    assert shown(exact.op13_exact(spark, path)) == got


def test_odd_rows(spark, documents, odd):
    got = shown(exact.op13_exact(spark, documents(odd, clash=True)))
    assert len(got) == len(odd)
    assert Counter(r[4] for r in got) == Counter(plain(r[1]) for r in odd)
    assert all(sum(r[3] for r in got if r[4] == k) == 1 for k in {r[4] for r in got})
    assert {r[1] for r in got if r[4] == plain("")} == {3}  # the longest of the blank texts
    assert exact.op13_exact(spark, documents([])).count() == 0
    assert shown(exact.op13_exact(spark, documents([(None, "a"), (2, "a"), (1, None)]))) == sorted([(None, 2, 2, False, plain("a")), (2, 2, 2, True, plain("a")), (1, 1, 1, True, plain(""))], key=str)


def test_batches(spark, documents, tmp_path):
    path = documents([(n, f"text {n % 50}" + " " * (n % 3)) for n in range(200)], clash=True)
    docs = spark.read.parquet(path + "/documents.parquet")
    index = exact.Index.open(spark, f"{tmp_path}/index", 4)
    seen = set()
    for turn in range(2):
        for k in range(4):  # the second time every batch is run again
            part = docs.where(F.col("doc_id") % 4 == k).where(F.col("doc_id") < 50 + 50 * k)
            kept = exact.unique(part, index, f"batch {k}").collect()
            assert part.columns == list(kept[0].asDict()) if kept else True
            texts = {plain(r["text"]) for r in kept}
            assert len(texts) == len(kept)
            if turn == 0:
                assert not texts & seen and texts == {plain(r["text"]) for r in part.collect()} - seen
                seen |= texts
    assert index.rows.count() == len(seen) == index.rows.select("digest").distinct().count()
    again = exact.Index.open(spark, f"{tmp_path}/index")
    assert again.buckets == 4
    # Another process finds the index in its folder: here, after the session has forgotten the table.
    spark.sql(f"drop table {index.name}")
    assert exact.Index.open(spark, f"{tmp_path}/index").rows.count() == len(seen)
    plan = docs.withColumn("digest", F.unhex(F.sha2(exact.normal(), 256))).join(index.rows.hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_rows_that_share_id_and_text(spark, documents, tmp_path):
    docs = spark.read.parquet(documents([(1, "a"), (1, "a "), (1, "b"), (2, "a")]) + "/documents.parquet")
    kept = exact.unique(docs, exact.Index.open(spark, f"{tmp_path}/i", 2), "x").collect()
    assert sorted((r["doc_id"], r["text"].strip()) for r in kept) == [(1, "a"), (1, "b")]


def test_only_own_tables_are_dropped(spark, tmp_path):
    for name in ("cut-1", "cut-0123456789abcdef0123456789abcdef"):
        spark.range(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.range(3).write.parquet(f"{tmp_path}/{name}/cut-2")
        for of in ("documents.parquet", "cut-2"):
            df = spark.read.parquet(f"{tmp_path}/{name}/{of}")
            made = common.cut(df)
            common.drop(df, made, df.union(made))
            assert df.count() == 3
    made = common.cut(spark.range(5))
    where = made.inputFiles()[0].removeprefix("file://")
    common.drop(made)
    import os

    assert not os.path.exists(where)
