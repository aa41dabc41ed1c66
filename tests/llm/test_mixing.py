from collections import Counter

import duckdb
import pytest
from gridloom.llm import mixing


def by_sql(path):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/documents.parquet/*.parquet')")
    return sorted(con.execute(mixing.SQL).fetchall(), key=str)


def plan(spark, path):
    return sorted((tuple(r) for r in mixing.op3_mixing(spark, path).collect()), key=str)


def test_hot_source_and_null_source(spark, documents):
    rows = [(n, "w " * (n % 37), "en", "hot" if n % 3 else None if n % 2 else f"s{n % 11}") for n in range(1500)]
    path = documents(rows)
    got = plan(spark, path)
    assert got == by_sql(path)
    taken, target = Counter(), {}
    for _, size, source_size, goal, words in got:
        assert words <= 2 * size
        taken[source_size] += words
        target[source_size] = goal
    assert all(abs(taken[s] - target[s]) <= 18 for s in target)
    total = sum(s for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * total) and all(t <= 2 * s + 1e-6 for s, t in target.items())


def test_copies_of_rows(spark, documents):
    path = documents([(n, "a b c", "en", "xyz"[n % 3]) for n in range(60)], clash=True)
    docs = spark.read.parquet(path + "/documents.parquet")
    want = {r["doc_id"]: r["copies"] for r in mixing.plan(docs).collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = Counter(r["doc_id"] for r in mixed.collect())
    assert got == Counter({k: v for k, v in want.items() if v})


def test_odd_rows(spark, documents, odd):
    path = documents(odd, clash=True)
    assert [r[:2] for r in plan(spark, path)] == [r[:2] for r in by_sql(path)]
    assert mixing.op3_mixing(spark, documents([])).count() == 0
    assert all(r["taken"] == 0 for r in mixing.op3_mixing(spark, documents([(1, None), (2, "")])).collect())
