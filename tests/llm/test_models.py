"""Held-out accuracy of the trained operators, and their odd rows."""

import zlib

from gridloom.llm import langid, quality

SF = "/root/testdata/sf0.1"


def test_language_of_held_out_documents(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = langid.op6_langid(spark, SF).collect()
    assert len(rows) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and langs[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    right = sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) / len(held)
    print("language accuracy", right, len(held))
    assert right > 0.95


def test_quality_of_held_out_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] is not None}
    rows = quality.op4_quality(spark, SF).collect()
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    print("quality auc", auc, "accuracy", sum((s >= 0.7) == (q == 1) for s, q in held) / len(held), len(good), len(bad))
    assert auc > 0.9


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 20):
        code = langid.codewords(n)
        least = min((code[a] != code[b]).sum() for a in range(n) for b in range(a))
        assert len(code) == n and least >= 1 + (n > 2) + 4 * (n > 6)


def test_odd_rows(spark, documents, odd):
    path = documents(odd, [(1, None, None), (None, 1, 1), (7, 1, 0), (7, 1, 0), (8, 0, 0), (6, 0, None)], clash=True)
    rows = langid.op6_langid(spark, path).collect()
    assert len(rows) == len(odd) and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    rows = quality.op4_quality(spark, path).collect()
    assert len(rows) == len(odd) and all(0 <= r["score"] <= 1 for r in rows)
    nothing = documents([])
    assert langid.op6_langid(spark, nothing).count() == quality.op4_quality(spark, nothing).count() == 0
    unlabelled = documents([(1, "some text", None), (2, "more text", None)])
    assert {r["lang_pred"] for r in langid.op6_langid(spark, unlabelled).collect()} == {"und"}
    assert {r["score"] for r in quality.op4_quality(spark, unlabelled).collect()} == {0.5}
