import hashlib

import corpus_pipeline
from gridloom.llm import bpe, pii
from tokenizers import Tokenizer


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = [docs]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], small).write.parquet(f"{tmp_path}/{n}")
        seen.append(spark.read.parquet(f"{tmp_path}/{n}"))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert seen[-1].dtypes == docs.dtypes, name
    good, unique, private, mixed, tokens = [{r["doc_id"]: r for r in df.collect()} for df in seen[1:]]
    assert set(unique) <= set(good) <= {r["doc_id"] for r in docs.select("doc_id").collect()} and len(unique) < len(good)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    clean = [d for d, q in labels.items() if q == 1]
    assert sum(d in good for d in clean) >= 0.97 * len(clean)
    assert set(private) == set(unique)
    for d, r in private.items():
        assert r["text"] == pii.replaced(unique[d]["text"]) and r["n_chars"] == (None if r["text"] is None else len(r["text"]))
        assert not any(k < 4 and k != 2 for _, k, _ in pii.spans(r["text"]))
    assert set(mixed) <= set(private)
    library = Tokenizer.from_file(bpe.default_path())
    for d, r in tokens.items():
        ids = library.encode(mixed[d]["text"] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert seen[-1].count() == seen[-2].count()


def test_odd_rows(spark, documents, odd):
    path = documents(odd, [(7, 1, 0), (6, 0, 0)], clash=True)
    assert corpus_pipeline.run(spark, path).columns[0] == "doc_id"
    rows = corpus_pipeline.run(spark, path).collect()
    kept = {r["doc_id"] for r in rows}
    assert kept <= {r[0] for r in odd} and not {7, 8} <= kept and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert corpus_pipeline.run(spark, documents([])).count() == 0
