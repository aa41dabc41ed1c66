"""AVI motion-JPEG: lossless frames, RIFF parsing, shots and timed clips.

Frames are intra-coded JPEG images of the lossless process (SOF3, predictor 1, 8 bits). Their Huffman table
gives a difference of category s a code of 9 - s bits, so each sample takes exactly 9 bits with its s extra
bits, and numpy codes whole frames at once. The code of nine ones stays free, as the standard asks.

Bytes are laid out as rows of 192 samples, 16 rows a frame; the last frame of a film may have fewer rows, as
its own header says. An index (``idx1``) tells where frames are; without one, the ``movi`` list is walked.

Shots: the histogram difference of successive frames (16 bins, half the L1 distance, 0 to 1) begins a shot if
it is above ``FLOOR`` and above mean + 3 deviations of the previous ``MEMORY`` differences.

Defined results: null and empty texts become one row of 192 spaces; media that are null or no AVI give null
features; rows are handled one by one, so repeated rows give repeated rows; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import ready, table

WIDTH, HEIGHT, FPS = 192, 16, 25
BATCH = 256  # frames coded at once
BINS, MEMORY, FLOOR = 16, 8, 0.05


# --- lossless JPEG -----------------------------------------------------------------------------------------
@lru_cache(1)
def _codes() -> tuple[np.ndarray, np.ndarray]:
    """9-bit code of each difference -255..255, and the difference of each code."""
    differences = np.arange(-255, 256)
    category = np.array([int(abs(d)).bit_length() for d in differences])
    extra = np.where(differences >= 0, differences, differences + (1 << category) - 1)
    prefix = (1 << (9 - category)) - 2  # 0, 10, 110 ... : category 8 has the shortest
    code = (prefix << category | extra).astype(np.uint16)
    back = np.zeros(512, np.int16)
    back[code] = differences
    return code, back


def _head(rows: int, width: int = WIDTH) -> bytes:
    """Markers of a frame before its entropy-coded bytes."""
    lengths = bytes([1] * 9 + [0] * 7)
    return (
        b"\xff\xd8"
        + b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, rows, width, 1) + bytes([1, 0x11, 0])
        + b"\xff\xc4" + struct.pack(">HB", 2 + 1 + 16 + 9, 0) + lengths + bytes(range(8, -1, -1))
        + b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0, 1, 0, 0])
    )


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG images of uint8 samples (frames, rows, WIDTH)."""
    n, rows, width = samples.shape
    s = samples.astype(np.int16)
    d = np.empty_like(s)
    d[:, :, 1:] = s[:, :, 1:] - s[:, :, :-1]
    d[:, 1:, 0] = s[:, 1:, 0] - s[:, :-1, 0]
    d[:, 0, 0] = s[:, 0, 0] - 128
    c = _codes()[0][(d + 255).reshape(n, -1, 8)]
    out = np.empty((n, c.shape[1], 9), np.uint8)
    out[:, :, 0] = c[:, :, 0] >> 1
    for k in range(1, 8):
        out[:, :, k] = (c[:, :, k - 1] << (8 - k) | c[:, :, k] >> (k + 1)) & 255
    out[:, :, 8] = c[:, :, 7] & 255
    head = _head(rows, width)
    return [head + x.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for x in out]


def decode_frame(image: bytes) -> np.ndarray:
    """Samples of a lossless JPEG that :func:`encode_frames` has written; other tables or predictors raise."""
    at, size = 2, None
    if image[:2] != b"\xff\xd8":
        raise ValueError("no JPEG image")
    while True:
        marker, length = struct.unpack_from(">HH", image, at)
        body = image[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xFFC3:
            depth, rows, width, parts = struct.unpack_from(">BHHB", body)
            size = (rows, width)
            if depth != 8 or parts != 1:
                raise ValueError("only 8-bit samples of one component")
        elif marker == 0xFFC4:
            if body[1:17] != bytes([1] * 9 + [0] * 7) or body[17:26] != bytes(range(8, -1, -1)):
                raise ValueError("another Huffman table")
        elif marker == 0xFFDA:
            break
    raw = np.frombuffer(image[at:-2].replace(b"\xff\x00", b"\xff"), np.uint8).astype(np.uint16).reshape(-1, 9)
    c = np.empty((len(raw), 8), np.uint16)
    for k in range(8):
        c[:, k] = (raw[:, k] << (k + 1) | raw[:, k + 1] >> (7 - k)) & 511
    d = _codes()[1][c].reshape(size).astype(np.int32)
    d[0, 0] += 128
    d[:, 0] = np.cumsum(d[:, 0])
    return np.cumsum(d, axis=1).astype(np.uint8)


# --- RIFF --------------------------------------------------------------------------------------------------
def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """An AVI file whose frames hold the payload; its length must be a positive multiple of WIDTH."""
    step = WIDTH * HEIGHT
    whole = len(payload) // step
    frames: list[bytes] = []
    for at in range(0, whole, BATCH):
        n = min(BATCH, whole - at)
        frames += encode_frames(np.frombuffer(payload, np.uint8, n * step, at * step).reshape(n, HEIGHT, WIDTH))
    if len(payload) > whole * step:
        frames += encode_frames(np.frombuffer(payload, np.uint8, offset=whole * step).reshape(1, -1, WIDTH))
    main = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, len(frames), 0, 1, 0, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = b"vids" + b"MJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    shape = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", step, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", shape)))
    index, at, body = [], 4, [b"movi"]
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(_chunk(b"00dc", f))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of the body of each chunk."""
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        yield name, at + 8, min(end, at + 8 + size)
        at += 8 + size + (size & 1)


def read_avi(data: bytes) -> tuple[float, Iterator[bytes]]:
    """Frames a second and the stored images, by the index where there is one."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    rate, movi, index = float(FPS), None, []
    for name, start, end in _walk(data, 12, len(data)):
        kind = data[start : start + 4]
        if name == b"LIST" and kind == b"hdrl":
            for inner, s, _ in _walk(data, start + 4, end):
                if inner == b"avih":
                    rate = 1e6 / max(1, struct.unpack_from("<I", data, s)[0])
        elif name == b"LIST" and kind == b"movi":
            movi = (start, end)
        elif name == b"idx1":
            index = list(struct.iter_unpack("<4sIII", data[start : end - (end - start) % 16]))
    if movi is None:
        return rate, iter(())
    if index:
        places = [(movi[0] + offset + 8, size) for name, _, offset, size in index if name[2:] in (b"dc", b"db")]
    else:
        places = [(s, e - s) for name, s, e in _walk(data, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")]
    return rate, (data[s : s + n] for s, n in places)


# --- shots -------------------------------------------------------------------------------------------------
def shots(differences: list[float]) -> list[int]:
    """Frames at which a shot begins; differences[n] is between frames n and n + 1."""
    begins, past = [0], []
    for n, d in enumerate(differences):
        recent = past[-MEMORY:]
        mean = sum(recent) / len(recent) if recent else 0.0
        spread = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if d > max(FLOOR, mean + 3 * spread):
            begins.append(n + 1)
            past = []
        else:
            past.append(d)
    return begins


def examine(media: bytes | None) -> dict:
    """Payload digests and clips of a film, one frame in memory at a time besides the file itself."""
    nothing = {k: None for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips")}
    if media is None or media[:4] != b"RIFF":
        return nothing
    rate, images = read_avi(media)
    digest, size, tail, before, gaps = hashlib.sha256(), 0, b"", None, []
    for image in images:
        samples = decode_frame(image)
        raw = samples.tobytes()
        digest.update(raw)
        size += len(raw)
        tail = (tail + raw)[-16:]
        now = np.bincount(samples.ravel() >> 4, minlength=BINS) / max(1, samples.size)
        if before is not None:
            gaps.append(float(np.abs(now - before).sum()) / 2)
        before = now
    n = len(gaps) + (before is not None)
    begins = shots(gaps) if n else []
    clips = [{"clip": k, "first_frame": a, "last_frame": b - 1, "start_s": round(a / rate, 3), "end_s": round(b / rate, 3)} for k, (a, b) in enumerate(zip(begins, [*begins[1:], n]))]
    return {"payload_bytes": size, "payload_sha256": digest.hexdigest(), "tail_crc32": zlib.crc32(tail), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "clips": clips}


CLIPS = "array<struct<clip: int, first_frame: int, last_frame: int, start_s: double, end_s: double>>"


def store(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), into: str = "media") -> DataFrame:
    """The columns ``keep``, n_bytes, and the UTF-8 bytes of ``text``, padded with spaces, as an AVI film."""
    ready(df.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                raw = [x or b"" for x in part.column(0).to_pylist()]
                films = [write_avi(x + b" " * (WIDTH if not x else -len(x) % WIDTH)) for x in raw]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(map(len, raw), pa.int64()), pa.array(films, pa.binary())], names=[*keep, "n_bytes", into])

    kept = df.select(F.encode(F.col(f"`{text}`").cast("string"), "UTF-8").alias("_raw"), *[F.col(f"`{c}`") for c in keep])
    return kept.mapInArrow(run, ", ".join([*[f"`{c}` {t}" for c, t in kept.dtypes[1:]], "n_bytes bigint", f"`{into}` binary"]))


def features(df: DataFrame, media: str = "media") -> DataFrame:
    """All columns but the film, what is read back from it, and its clips."""
    ready(df.sparkSession)
    names = [c for c in df.columns if c != media]
    fields = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())]
    clip = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index(media)
            found = [examine(x.as_py()) for x in batch.column(at)]
            columns = [c for n, c in enumerate(batch.columns) if n != at]
            columns += [pa.array([f[k] for f in found], t) for k, t in [*fields, ("clips", clip)]]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *[k for k, _ in fields], "clips"])

    kept = [f"`{c}` {t}" for c, t in df.dtypes if c != media]
    return df.mapInArrow(run, ", ".join([*kept, "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string", f"clips {CLIPS}"]))


def clips(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row for each shot of each film, with its times."""
    return features(df, media).select(key, F.inline("clips"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a film and read back; feature lists its shots in seconds."""
    seen = features(store(table(spark, sf_dir, "documents")))
    told = F.transform("clips", lambda c: F.concat(c["first_frame"], F.lit("-"), c["last_frame"], F.lit("@"), c["start_s"], F.lit("-"), c["end_s"]))
    return seen.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.array_join(told, ",").alias("feature"))
