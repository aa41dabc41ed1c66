import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from gridloom.llm import manifest
from pyspark.sql import functions as F


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(hashes):
    """Levels of nodes, and each place's siblings as (left, right) pairs."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    ways = []
    for p in range(len(hashes)):
        way = []
        for level in levels[:-1]:
            first = p - p % 3
            way.append(("".join(level[first:p]), "".join(level[p + 1 : first + 3])))
            p //= 3
        ways.append(way)
    return levels[-1][0], ways


def by_hand(rows):
    """Rows are (doc_id, text, lang, source, n_chars)."""
    groups = defaultdict(list)
    for d, text, lang, source, n in rows:
        one = leaf((d, source, lang, n, text))
        spoilt = zlib.crc32(str("" if d is None else d).encode()) % 2 == 0
        given = leaf((d, source, lang, n, text.replace("\n", ""))) if spoilt and text is not None else one
        groups[(source is not None, source or "")].append(((d is None, d or 0, one), d, one, given))
    order = sorted(groups, key=lambda s: (s[0], s[1].encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])]) for s in order}
    root, above = tree([trees[s][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for (_, d, one, given), way in zip(sorted(groups[s]), trees[s][1]):
            acc = given
            for left, right in way + above[n]:
                acc = h(left, acc, right)
            out.append((d, one, trees[s][0], root, h(*[x for pair in way + above[n] for x in pair]), acc, acc == root))
    return sorted(out, key=str)


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def write(tables):
    def of(rows, clash=False):
        return tables(clash, documents=("doc_id long, text string, lang string, source string, n_chars long", rows))

    return of


def test_hot_source_and_sql(spark, write):
    rng = random.Random(1)
    ids = rng.sample(range(-3000, 9000), 900) + rng.sample(range(1 << 40, 1 << 41), 60)
    rows = [(d, f"text {d}\nof {d % 7}\n" if d % 3 else None if d % 2 else "one line", rng.choice(["en", None]), rng.choice(["hot", "hot", "hot", None, "", "é", "z", "a"]) if n > 20 else f"s{n}", rng.choice([None, n])) for n, d in enumerate(ids)]
    path = write(rows)
    got = shown(manifest.op12_merkle(spark, path))
    assert got == by_hand(rows)
    assert 0 < sum(r[6] for r in got) < len(got)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(manifest.SQL).fetchall(), key=str)


def test_sizes(spark, write):
    rows = [(n * 10_000 + 7 * d, f"a\n{d}", "en", f"of {n}", d) for n in (1, 2, 3, 4, 9, 10, 242, 243, 244, 729, 730) for d in range(n)]
    assert shown(manifest.op12_merkle(spark, write(rows))) == by_hand(rows)
    assert shown(manifest.op12_merkle(spark, write(rows[:1]))) == by_hand(rows[:1])


def test_many_sources(spark, write):
    rows = [(d, f"a\n{d}", "en", f"site{d % 500}", d) for d in range(700)]
    assert shown(manifest.op12_merkle(spark, write(rows))) == by_hand(rows)


def test_odd_rows(spark, write, odd):
    rows = [(*r, None if n % 2 else n) for n, r in enumerate(odd)] + [(None, "x\n", "en", "a", 1), (None, "y", "en", "a", 1), (3, "other", "en", "a", 1), ((1 << 63) - 1, "m", None, "a", 2), (-(1 << 63), "l", None, "a", 2)]
    assert shown(manifest.op12_merkle(spark, write(rows, clash=True))) == by_hand(rows)
    assert manifest.op12_merkle(spark, write([])).count() == 0


def test_ranks(spark):
    rng = random.Random(3)
    rows = [("ab"[n % 3 == 0], rng.choice([rng.randrange(50_000), rng.randrange(-(1 << 62), 1 << 62)])) for n in range(2000)]
    df = spark.createDataFrame([(k, d, str(d)) for k, d in rows], "key string, id long, leaf string")
    got = sorted((r["key"], r["place"], r["id"], r["n"]) for r in manifest.ranked(df).collect())
    many = {k: sum(x == k for x, _ in rows) for k in "ab"}
    assert got == [(k, p, d, many[k]) for k in "ab" for p, d in enumerate(sorted(d for x, d in rows if x == k))]


def test_proofs_lead_to_the_root(spark, small):
    whole = manifest.build(manifest.leaves(spark.read.parquet(f"{small}/documents.parquet")))
    rows = manifest.proofs(whole).where(F.col("id") % 50 == 0).collect()
    for r in rows:
        acc = r["hash"]
        for left, right in zip(r["lefts"], r["rights"]):
            acc = h(left, acc, right)
        assert acc == whole.root
