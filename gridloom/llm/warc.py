"""WARC archives: segmented records with chunked HTTP bodies, their reassembly, and revisits.

Writing: one record for each page, gzip members of WARC/1.1. A response whose HTTP message is longer than
``SEGMENT`` bytes is split: its first record has segment number 1, ``continuation`` records name it by
WARC-Segment-Origin-ID, and the last one gives WARC-Segment-Total-Length. HTTP bodies are framed in chunks.
A revisit record has no body and names the response it refers to.

Archives are rows of bytes (name, content), a few MB each, kept as a Parquet table in the shared folder: any
executor can read them, also again after a loss. :func:`records` takes rows of Spark's ``binaryFile`` source
(column ``content``) as well.

Reading: whole records are decoded where they are parsed; only segments are shuffled, grouped by the record
they belong to, ordered by number, checked against the total length, joined, and their framing decoded.

Defined results: a null html is an empty payload; equal payloads (also empty ones) have one response, that of
the smallest page_id (null: last); rows repeated with that page_id and payload are all responses; a record whose
segments are missing or whose framing is broken has null payload columns; repeated segments count once; extra
columns aren't read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import cut, ready, table

SEGMENT = 32_768  # bytes of a block in one record
CHUNK = 8_192  # bytes of an HTTP chunk
ARCHIVE = 4 << 20  # bytes of an archive, after which another begins
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None, digest: str, copy: int = 0) -> str:
    """The id of a page's record; rows repeated with a page_id and payload are numbered copies with ids of their own."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}/{digest}' + (f'/copy {copy}' if copy else ''))}>"


def chunked(payload: bytes) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [payload[n : n + CHUNK] for n in range(0, len(payload), CHUNK)]
    return b"".join([b"%x\r\n%b\r\n" % (len(p), p) for p in parts]) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a framed body; None where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end > at else -1
        except ValueError:
            size = -1
        if size < 0 or (size and len(body) < end + 4 + size):
            return None
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def payload_of(block: bytes | None) -> bytes | None:
    """The payload of an HTTP response message."""
    if block is None:
        return None
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def response(key: int | None, url: str | None, payload: bytes, copy: int = 0) -> list[bytes]:
    """The records of a page: one, or a first segment and its continuations."""
    digest = base32_sha1(payload)
    own = record_id(key, digest, copy)
    block = HEAD + chunked(payload)
    parts = [block[n : n + SEGMENT] for n in range(0, len(block), SEGMENT)]
    many = len(parts) > 1
    shared = [("WARC-Target-URI", _line(url)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *shared, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("X-Page-ID", key), ("WARC-Segment-Number", 1 if many else None)]
    out = [_record(first, parts[0])]
    for n, part in enumerate(parts[1:], 2):
        rest = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(key, f"{digest}/{n}", copy)), *shared, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)]
        out.append(_record(rest, part))
    return out


def revisit(key: int | None, url: str | None, digest: str, refers_to: int | None, copy: int = 0) -> bytes:
    fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(key, f"{digest}/revisit", copy)), ("WARC-Target-URI", _line(url)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Profile", PROFILE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Page-ID", key)]
    return _record(fields, b"")


def _line(value: str | None) -> str | None:
    """A header's value: one line."""
    return None if value is None else " ".join(value.split())


def parse(content: bytes):
    """Fields (names in lower case) and block of each record of an archive, gzip members or plain."""
    data = io.BytesIO(content)
    stream = gzip.GzipFile(fileobj=data) if content[:2] == b"\x1f\x8b" else data
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields.get("content-length", 0)))


def write(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives (name, content) with a record for each row of (page_id, url, html).

    Of rows with equal payloads of at least ``least`` bytes, that with the smallest page_id is a response and
    the others revisit it. What decides is joined as 20-byte digests; hot groups of equal payloads are split
    by Spark's skew handling, as nothing needs them together. Only payloads with a row repeated in page_id are summed
    by page and url, so that the copies can be numbered; revisits refer to copy 0.
    """
    ready(pages.sparkSession)
    raw = F.encode(F.coalesce(F.col("`html`").cast("string"), F.lit("")), "UTF-8")
    own = pages.select(F.col("`page_id`").cast("long").alias("page_id"), F.col("`url`").cast("string").alias("url"), raw.alias("payload")).withColumn("digest", F.sha1("payload"))
    first = cut(own.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.min("page_id").alias("first_page"), F.max(F.col("n") > 1).alias("repeated")))
    same = F.col("page_id").eqNullSafe(F.col("first_page")) | (F.length("payload") < least)
    rows = own.join(first, "digest").select("page_id", "url", "digest", F.when(same, F.col("payload")).alias("payload"), F.when(~same, F.col("first_page")).alias("refers_to"), "repeated")
    single = rows.where("not repeated").select("page_id", "url", "digest", "payload", "refers_to", F.lit(0).cast("long").alias("copy"))
    if first.where("repeated").isEmpty():  # the usual case: payloads are shuffled once
        rows = single
    else:
        copies = rows.where("repeated").groupBy("page_id", "url", "digest").agg(F.first("payload").alias("payload"), F.first("refers_to").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.partitionBy("digest", "page_id").orderBy("url").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        copies = copies.withColumn("before", before).select("page_id", "url", "digest", "payload", "refers_to", F.explode(F.sequence("before", F.col("before") + F.col("n") - 1)).alias("copy"))
        rows = single.unionByName(copies)

    def run(batches):
        from pyspark import TaskContext

        part, number, members, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                key, url, sha, payload, to, copy = (batch.column(n)[at].as_py() for n in range(6))
                made = response(key, url, payload, copy) if payload is not None else [revisit(key, url, base64.b32encode(bytes.fromhex(sha)).decode(), to, copy)]
                members += made
                size += sum(map(len, made))
                if size >= ARCHIVE:
                    yield pa.RecordBatch.from_arrays([pa.array([f"{part:05d}-{number:05d}.warc.gz"]), pa.array([b"".join(members)], pa.binary())], names=["name", "content"])
                    number, members, size = number + 1, [], 0
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([f"{part:05d}-{number:05d}.warc.gz"]), pa.array([b"".join(members)], pa.binary())], names=["name", "content"])

    return rows.mapInArrow(run, "name string, content binary")


FIELDS = ("warc-type", "warc-record-id", "x-page-id", "warc-target-uri", "warc-refers-to", "warc-segment-origin-id", "warc-segment-number", "warc-segment-total-length")
RECORD = "record_type string, record_id string, page_id bigint, url string, refers_to_id string, origin_id string, segment int, total bigint, block binary"
DECODED = "payload_bytes bigint, payload_digest string"


def _decoded(kind: str | None, block: bytes | None) -> tuple[bytes | None, int | None, str | None]:
    """Payload of a whole record's block, its length and its digest."""
    found = payload_of(block) if kind == "response" else None
    return (None, None, None) if found is None else (found, len(found), base32_sha1(found))


def records(archives: DataFrame, payload: bool = True) -> DataFrame:
    """The records of archives. Those that are whole are decoded: payload (if asked for), its length and digest; segments
    have a number and keep their blocks."""
    ready(archives.sparkSession)
    schema = f"{RECORD}, payload binary, {DECODED}" if payload else f"{RECORD}, {DECODED}"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), *[pa.binary()] * payload, pa.int64(), pa.string()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for content in batch.column(0):
                for fields, block in parse(content.as_py() or b""):
                    kind, own, page, url, to, origin, number, total = (fields.get(k) for k in FIELDS)
                    found, length, digest = _decoded(kind, block) if number is None else (None, None, None)
                    kept = block if number is not None else None
                    rows.append((kind, own, int(page) if page else None, url, to, origin or (own if number else None), int(number) if number else None, int(total) if total else None, kept, *[found] * payload, length, digest))
                    size += len(kept or b"") + len(found or b"") * payload + 500
                    if size > ARCHIVE:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return archives.select("content").mapInArrow(run, schema)


def reassemble(segments: DataFrame) -> DataFrame:
    """Whole records of segments, with their blocks in order; blocks are null unless all are there and their length is
    the stated total.

    A group has the segments of one record, so it is as large as one cell of the result.
    """
    groups = segments.groupBy("origin_id").agg(F.collect_set(F.struct("segment", "block")).alias("parts"), F.max("total").alias("total"), *[F.first(c, True).alias(c) for c in ("page_id", "url")], F.max(F.when(F.col("segment") == 1, F.col("record_type"))).alias("record_type"))
    number = F.size("parts")
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))
    whole = (F.element_at(F.col("parts"), -1)["segment"] == number) & (F.col("parts")[0]["segment"] == 1) & (length == F.col("total"))
    return groups.withColumn("parts", F.array_sort("parts")).select("record_type", F.col("origin_id").alias("record_id"), "page_id", "url", F.lit(None).cast("string").alias("refers_to_id"), F.when(whole, F.col("parts")["block"]).alias("blocks"))


def decoded(whole: DataFrame, payload: bool = True) -> DataFrame:
    """Payloads of reassembled records: their bytes (if asked for), length and digest."""
    ready(whole.sparkSession)
    names = [c for c in whole.columns if c != "blocks"]
    extra = [("payload", pa.binary())] * payload + [("payload_bytes", pa.int64()), ("payload_digest", pa.string())]

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index("blocks")
            kinds = batch.column(batch.schema.names.index("record_type")).to_pylist()
            found = [_decoded(k, b"".join(b.as_py()) if b.is_valid else None) for k, b in zip(kinds, batch.column(at))]
            columns = [c for n, c in enumerate(batch.columns) if n != at]
            columns += [pa.array([f[n] for f in found], t) for n, (_, t) in zip(range(0 if payload else 1, 3), extra)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *[k for k, _ in extra]])

    kept = [f"`{c}` {t}" for c, t in whole.dtypes if c != "blocks"]
    return whole.mapInArrow(run, ", ".join([*kept, *["payload binary"] * payload, DECODED]))


def read(archives: DataFrame, payload: bool = True) -> DataFrame:
    """Every response and revisit of archives with its payload, revisits without.

    Archives are parsed once if no payloads are asked for: then what is parsed is written, and is small but for segments.
    """
    names = ["record_type", "record_id", "page_id", "url", "refers_to_id", *["payload"] * payload, "payload_bytes", "payload_digest"]
    all_ = records(archives, payload)
    all_ = all_ if payload else cut(all_)
    return all_.where("segment is null").select(*names).unionByName(decoded(reassemble(all_.where("segment is not null")), payload).select(*names))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back; revisits get the payload of the response they refer to."""
    archives = cut(write(table(spark, sf_dir, "pages")))
    found = cut(read(archives, payload=False).drop("url"))
    responses = found.where("record_type = 'response'")
    to = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d")).dropDuplicates(["refers_to_id"])
    revisits = found.where("record_type <> 'response'").drop("payload_bytes", "payload_digest").join(to, "refers_to_id", "left")
    shown = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*shown).unionByName(revisits.select("page_id", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to"))


# Four base32 characters for each five hexadecimal digits.
SQL = """
with p as (select page_id, encode(coalesce(html, '')) as raw from pages),
d as (select page_id, octet_length(raw) as payload_bytes, sha1(raw) as hex from p),
f as (select hex, min(page_id) as first_page from d group by hex)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda n:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + cast((cast('0x' || substr(hex, cast(1 + 5 * (n // 4) as integer), 5) as integer) >> cast(15 - 5 * (n % 4) as integer)) & 31 as integer), 1)), '') as payload_digest,
  case when page_id = first_page then 'response' else 'revisit' end as record_type,
  case when page_id = first_page then null else first_page end as refers_to
from d join f using (hex)
"""
