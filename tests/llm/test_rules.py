import duckdb
from gridloom.llm import rules


def both(spark, path):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/documents.parquet/*.parquet')")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    theirs = con.execute(f"select {', '.join(columns)} from ({rules.SQL})").fetchall()
    return sorted(map(tuple, rules.op8_rules(spark, path).select(*columns).collect()), key=str), sorted(theirs, key=str)


def test_verdicts(spark, documents):
    words = [f"word{n}" for n in range(80)]
    texts = [
        " ".join(words), " ".join(words[:19]), " ".join(words[:10] * 6), " ".join(words + words[:8]), "\n".join(["same line of words here"] * 5 + words), "# $ % & | < > * " * 9 + " ".join(words),
        "SHOUTING WORDS " * 3 + " ".join(w.upper() + "ABC" for w in words), "! " * 50 + " ".join(words[:40]), "... … " * 30 + " ".join(words[:50]), "a b c d e f g h " * 2 + "i", " ".join(w * 6 for w in words), " ".join(chr(97 + n % 26) for n in range(60)),
    ]
    mine, theirs = both(spark, documents([(n, t) for n, t in enumerate(texts)]))
    assert mine == theirs
    assert {r[0]: r[-1] for r in mine}[0] and sum(r[-1] for r in mine) < 5


def test_order_follows_rejections_per_cost(spark):
    from pyspark.sql import functions as F

    sample = spark.range(1000)
    assert rules.order(sample, {"never": F.col("id") < 0, "often": F.col("id") > 100})[0] == "often"
    assert rules.order(sample.where("id < 0"), {"b": F.lit(True), "a": F.lit(True)}) == ["b", "a"]


def test_odd_rows(spark, documents, odd):
    mine, theirs = both(spark, documents(odd, clash=True))
    assert mine == theirs and len(mine) == len(odd)
    assert rules.op8_rules(spark, documents([])).count() == 0
