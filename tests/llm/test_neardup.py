import random
import re
from collections import Counter, defaultdict

import numpy as np
from gridloom.llm import neardup
from gridloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text):
    w = WORD.findall(text or "")
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def similarity(a, b):
    """Weighted Jaccard similarity of two counters."""
    return (a & b).total() / max(1, (a | b).total())


def brute(docs):
    """Class of each id by comparing all pairs that share a shingle."""
    of = {i: sets(t) for i, t in docs.items()}
    parent = {i: i for i in of}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in of.items():
        for x in s:
            holders[x].append(i)
    seen = set()
    for ids in holders.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if similarity(of[a], of[b]) >= 0.8:
                        a_, b_ = sorted((root(a), root(b)))
                        parent[b_] = a_
    return {i: root(i) for i in of}


def test_every_document(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r["doc_id"]: r["class_id"] for r in neardup.op5_minhash(spark, small).collect()}
    assert got == brute(docs)


def star(rng):
    """Variants that are similar to one text, but not to each other, and others."""
    words = [f"w{n}" for n in range(20_000)]
    base = [rng.choice(words) for _ in range(220)]
    rows = [(900, " ".join(base))]
    for n in range(300):
        own = list(base)
        for at in rng.sample(range(5, 215), 4):
            own[at] = rng.choice(words)
        rows.append((n, " ".join(own)))
    return rows + [(2_000 + n, " ".join(rng.choice(words) for _ in range(200))) for n in range(100)]


def family(rng):
    """Texts that are similar only to one other, among many that share a template with them."""
    words = [f"v{n}" for n in range(20_000)]

    def some(n):
        return [rng.choice(words) for _ in range(n)]

    base = some(150)
    rows = [(10_000 + 10 * n, " ".join(base + some(24))) for n in range(300)]
    for n in range(0, 300, 5):  # a second text with a part of the first one's own words
        rows.append((10_005 + 10 * n, " ".join(base + rows[n][1].split()[150:158] + some(16))))
    return rows


def repeats(rng):
    """A passage said once and said nine times: alike as sets, but not by weight."""
    a, b = ([f"r{rng.randrange(10**6)}" for _ in range(n)] for n in (30, 200))
    return [(20_000, " ".join(b + a)), (20_001, " ".join(b + a * 9)), (20_002, " ".join(b + a * 8)), (20_003, " ".join(b[:-2] + a))]


def large_family(rng):
    """400 pairs just above 0.8 in texts that share most words: all of these meet in the same buckets."""

    def own(n):
        return [f"x{rng.randrange(1 << 40)}" for _ in range(n)]

    base, rows = own(760), []
    for n in range(400):
        mine = own(120)
        at = rng.randrange(0, 101)
        rows += [(30_000 + 2 * n, " ".join(base + mine)), (30_001 + 2 * n, " ".join(base + mine[:at] + own(19) + mine[at + 19 :]))]
    return rows


def test_hard_groups(spark, documents):
    rng = random.Random(3)
    rows, large = star(rng) + family(rng) + repeats(rng), large_family(rng)
    want = brute(dict(rows))
    of = {i: sets(t) for i, t in large}
    assert all(similarity(of[n], of[n + 1]) >= 0.8 for n in range(30_000, 30_800, 2))
    assert all(similarity(of[30_000], of[n]) < 0.8 for n in range(30_002, 30_800))
    want |= {i: i - i % 2 for i in of}
    assert want[20_001] == want[20_002] != want[20_000] == want[20_003] and want[299] == want[0]
    got = {r["doc_id"]: r["class_id"] for r in neardup.op5_minhash(spark, documents(rows + large)).collect()}
    assert got == want


def test_weighted_set_as_single_items():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 30, 200).astype(np.uint64), return_counts=True) for _ in "ab")
        x, y = (set(neardup.single(*s).tolist()) for s in (a, b))
        ca, cb = (Counter(dict(zip(s[0].tolist(), s[1].tolist()))) for s in (a, b))
        assert len(x) == ca.total() and len(x & y) == (ca & cb).total()


def test_large_buckets_are_compared_in_tiles(monkeypatch, spark):
    """However buckets and classes are dealt out, all nodes that links join end in one class, and few pairs are given."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    sets, met, named = [], [], []
    for n in range(90):
        own = np.where(rng.random(200) < rng.uniform(0.06, 0.14), rng.integers(0, 1 << 62, 200).astype(np.uint64), base)
        sets.append(own)
        met += [(n, int(v), 90) for v in range(3) if rng.random() < 0.8]
        if n < 50:
            named.append((n, 0))
    of = {n: {v for m, v, _ in met if m == n} for n in range(90)}
    similar = {(a, b) for b in range(90) for a in range(b) if len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})}
    want = {(a, b) for a, b in similar if of[a] & of[b] and b >= 50}
    assert len(want) > 20 and 3 < len(set(components_of(want | {(0, n) for n in range(50)}, 90))) < 40
    sketches = spark.createDataFrame([(n, [int(x) for x in neardup.sketch(s)]) for n, s in enumerate(sets)], "id long, s array<int>")
    met_, named_ = spark.createDataFrame(met, "id long, value long, size long"), spark.createDataFrame(named, "id long, component long")
    for tile, big in ((8, 4), (8, 1_000), (1_000, 4)):
        monkeypatch.setattr(neardup, "TILE", tile)
        monkeypatch.setattr(neardup, "BIG", big)
        got = {(r["a"], r["b"]) for r in neardup.crossing(met_, named_, lambda ids: sketches).collect()}
        classes = components_of(got | {(0, n) for n in range(50)}, 90)
        assert got <= similar and all(classes[a] == classes[b] for a, b in want)
        assert len(got) < 90 * (3 if tile == 1_000 else 12)


def components_of(links, n):
    of = list(range(n))
    for a, b in links:
        x, y = sorted((of[a], of[b]))
        of = [x if v == y else v for v in of]
    return of


def test_cut_sketches_leave_no_link_out(monkeypatch):
    monkeypatch.setattr(neardup, "SKETCH", 256)
    monkeypatch.setattr(neardup, "DOUBT", 5 * 0.4 / 16)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 62, 3_000).astype(np.uint64)
    sets = [np.where(rng.random(3_000) < 0.002 * n, rng.integers(0, 1 << 62, 3_000).astype(np.uint64), base)[: 3_000 if n % 3 else 2_500] for n in range(40)] + [base[:200]]
    items = [neardup.sketch(s).view(np.uint32) for s in sets]
    ids = np.arange(41)
    for low, own in ((True, np.ones(41, bool)), (False, ids < 15)):
        got = components_of(neardup._joined(low, own, ids, ids, items, 0.8), 41)
        want = {(a, b) for b in range(41) for a in range(b) if (low or own[a] != own[b]) and len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})}
        assert want and all(got[a] == got[b] for a, b in want)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    items = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    a, b = rng.uniform(0.1, 5, 300), rng.uniform(0.1, 5, 300)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    x, y = neardup.signature(items, a, 2_000), neardup.signature(items, b, 2_000)
    assert abs((x == y).mean() - want) < 0.05
    assert (neardup.signature(items, a, 200) == neardup.signature(items[::-1], a[::-1], 200)).all()


def test_words_of_long_texts_dont_depend_on_blocks(monkeypatch):
    text = "alpha beta\tgamma\n" * 4_000
    whole = neardup.word_hashes(text)
    monkeypatch.setattr(neardup, "BLOCK", 1_000)
    assert (neardup.word_hashes(text) == whole).all() and len(whole) == 12_000


def test_odd_rows(spark, documents, odd):
    rows = [(r["doc_id"], r["class_id"]) for r in neardup.op5_minhash(spark, documents(odd, clash=True)).collect()]
    assert sorted(rows, key=str) == sorted([(1, 1), (2, 2), (None, None), (3, 3), (4, 4), (5, 5), (5, 5), (6, 6), (7, 7), (8, 7)], key=str)
    assert neardup.op5_minhash(spark, documents([])).count() == 0
    kept = neardup.deduplicate(spark.read.parquet(documents(odd, clash=True) + "/documents.parquet"))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, None, 3, 4, 5, 5, 6, 7], key=str)


def test_components_of_a_long_path(spark):
    links = spark.range(0, 500).selectExpr("id + 1 as a", "id as b").union(spark.createDataFrame([(1000, 1001), (7, 7), (None, 4)], "a long, b long"))
    got = {r["id"]: r["component"] for r in components(links).collect()}
    assert got == {**{n: 0 for n in range(501)}, 1000: 1000, 1001: 1000}
