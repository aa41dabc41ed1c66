import base64
import hashlib

from gridloom.llm import warc
from gridloom.llm.common import cut
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string"


def wanted(rows):
    first = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if raw not in first or (page is not None and (first[raw] is None or page < first[raw])):
            first[raw] = page
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        to = first[raw]
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if page == to else "revisit", None if page == to else to))
    return sorted(out, key=str)


def got(spark, path):
    return sorted((tuple(r) for r in warc.op2_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip_with_segments(spark, tables):
    rows = [(n, f"http://h/{n}", "é<p>\r\n\r\n" * (7 ** (n % 7))) for n in range(40)] + [(90, None, "x" * 2_000_000), (91, "u\r\nInjected: 1", None), (92, "", ""), (93, "u", "HTTP/1.1 200\r\n\r\n0\r\n\r\n")]
    assert got(spark, tables(pages=(SCHEMA, rows))) == wanted(rows)


def test_odd_rows(spark, tables):
    rows = [(5, "a", "same"), (3, "b", "same"), (3, "b", "same"), (4, None, "same"), (9, None, None)]
    assert got(spark, tables(True, pages=(SCHEMA, rows))) == wanted(rows)
    unnamed = got(spark, tables(pages=(SCHEMA, [(None, None, None), (1, "u", "x")])))
    assert [(r[0], r[3]) for r in unnamed] == [(1, "response"), (None, "response")]
    assert warc.op2_warc(spark, tables(pages=(SCHEMA, []))).count() == 0


def test_repeated_long_pages(spark, tables):
    """Rows repeated with a page_id and payload are all responses, also where their records have segments."""
    long = "é long page " * 20_000
    rows = [(3, "b", long), (3, "b", long), (3, None, long), (4, "c", long), (4, "c", long), (1, "d", "short"), (1, "d", "short"), (None, "e", "x" * 40_000), (None, "e", "x" * 40_000)]
    path = tables(pages=(SCHEMA, rows))
    assert got(spark, path) == wanted(rows)
    found = warc.read(warc.write(spark.read.parquet(path + "/pages.parquet"))).collect()
    ids = {r["record_id"]: r for r in found}
    assert len(found) == len(ids) == len(rows)
    assert all(ids[r["refers_to_id"]]["page_id"] == 3 for r in found if r["record_type"] == "revisit")


def test_lost_and_repeated_segments(spark, tables):
    path = tables(pages=(SCHEMA, [(1, "u", "y" * 200_000)]))
    all_ = cut(warc.records(warc.write(spark.read.parquet(path + "/pages.parquet"))).where("segment is not null"))
    assert all_.count() > 5
    whole = warc.decoded(warc.reassemble(all_.unionByName(all_.where("segment = 2")))).first()
    assert bytes(whole["payload"]) == b"y" * 200_000
    for lost in (1, 3, all_.count()):
        assert warc.decoded(warc.reassemble(all_.where(F.col("segment") != lost))).first()["payload_bytes"] is None


def test_framing():
    assert warc.unchunked(b"5;ext=1\r\nhello\r\n0\r\n\r\n") == b"hello"
    assert warc.unchunked(b"5\r\nhel") is None and warc.unchunked(b"zz\r\nhello\r\n0\r\n\r\n") is None and warc.unchunked(b"") is None
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain" and warc.payload_of(b"no head") is None
    plain = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nbody\r\n\r\nWARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert [(f["warc-type"], b) for f, b in warc.parse(plain)] == [("response", b"body"), ("warcinfo", b"")]
