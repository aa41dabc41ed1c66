import hashlib
import zlib

import numpy as np
import pytest
from gridloom.llm import media


def padded(text):
    raw = (text or "").encode()
    return raw + b" " * (192 if not raw else -len(raw) % 192)


def test_frames_round_trip():
    rng = np.random.default_rng(0)
    for rows in (1, 5, 16):
        x = rng.integers(0, 256, (7, rows, media.WIDTH)).astype(np.uint8)
        x[0], x[1], x[2, :, ::2] = 0, 255, 255
        assert all((media.decode_frame(f) == y).all() for f, y in zip(media.encode_frames(x), x))
    with pytest.raises(Exception):
        media.decode_frame(b"GIF89a")


def test_film_without_index_and_shots():
    payload = b"a" * (16 * 192 * 10) + bytes(range(128, 224)) * 2 * 16 * 9 + b"a" * (16 * 192 * 9)
    film = media.write_avi(payload)
    seen = media.examine(film)
    assert seen["payload_sha256"] == hashlib.sha256(payload).hexdigest()
    assert [c["first_frame"] for c in seen["clips"]] == [0, 10, 19] and seen["clips"][-1]["end_s"] == pytest.approx(28 / 25)
    cut = film[: film.rindex(b"idx1")]
    assert media.examine(cut)["payload_sha256"] == seen["payload_sha256"]
    assert media.examine(None)["clips"] is None and media.examine(b"RIFX")["payload_bytes"] is None


def test_every_document(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = media.op7_media(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = padded(docs[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((docs[r["doc_id"]] or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]))
        assert r["media_sha256"] == hashlib.sha256(media.write_avi(raw)).hexdigest() and r["feature"].startswith("0-")


def test_odd_rows(spark, documents, odd):
    rows = media.op7_media(spark, documents(odd, clash=True)).collect()
    assert len(rows) == len(odd) and len({r["feature"] for r in rows if r["doc_id"] == 5}) == 1
    assert {(r["n_bytes"], r["payload_bytes"]) for r in rows if r["doc_id"] in (1, 2)} == {(0, 192)}
    assert media.op7_media(spark, documents([])).count() == 0
    path = documents([(1, "some text")])
    clips = media.clips(media.store(spark.read.parquet(path + "/documents.parquet"))).collect()
    assert [(r["doc_id"], r["clip"], r["first_frame"], r["last_frame"]) for r in clips] == [(1, 0, 0, 0)]
