import uuid

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
#: Columns whose names the operators use for themselves.
CLASH = ["score", "_text", "spans", "ids", "copies", "size", "place", "media", "sig", "bands", "_id", "_source", "_gone", "_copy", "label", "key", "digest"]


@pytest.fixture
def tables(spark, tmp_path):
    """Write rows as tables of a folder; gives the folder."""

    def write(clash=False, **of):
        path = tmp_path / uuid.uuid4().hex
        for name, (schema, rows) in of.items():
            df = spark.createDataFrame(rows, schema)
            if clash:
                from pyspark.sql import functions as F

                df = df.withColumns({c: F.lit(c) for c in CLASH if c not in df.columns})
            df.coalesce(2).write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return write


@pytest.fixture
def documents(tables):
    """Write (doc_id, text[, lang, source]) rows as documents, with labels where given."""

    def write(rows, labels=(), clash=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "web", None) for r in rows]
        return tables(clash, documents=(DOCUMENTS, full), labels=(LABELS, list(labels)))

    return write


@pytest.fixture
def odd():
    """Rows with nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long = "lorem ipsum dolor sit amet " * 20_000
    return [(1, "", None, None), (2, None, None, "web"), (None, "some words here", "en", None), (3, " \n\t ", "en", "a"), (4, "x" * 300_000, "en", "a"), (5, long, "en", "b"), (5, long, "en", "b"), (6, "éß \U0001f600 ퟿ 123", "de", "b"), (7, "same text of a few words", "en", "a"), (8, "same text of a few words", "en", "a")]
