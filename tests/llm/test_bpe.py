import hashlib
import random
import time
import tracemalloc

import numpy as np
import pytest
from gridloom.llm import bpe
from tokenizers import Tokenizer

TEXTS = [
    "Hello world, it's  a test\n\n  of 123 numbers.", "", " ", "\n \t", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "café naïve \U0001f468‍\U0001f469‍\U0001f467", "你好，世界", "a" * 50_000, "ab" * 30_000,
    "don't DON'T we'll 'quoted' x'y", "1²½Ⅰ١", "\x1c\x1d\x1e\x1f\x85\xa0　a", "tabs\t\tand\r\nlines  \n", "_under_score_ __", "́combining é", " " * 5_000, "   x", ("word " * 30_000), "ภาษาไทย", "=" * 9_000 + "-" * 9_000, "\U00010348\U0001d54f", "x​z",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_and_text_equal_the_librarys(library):
    encoder = bpe.Encoder(bpe.vocabulary(bpe.default_path()))
    for text in TEXTS:
        want = library.encode(text, add_special_tokens=False).ids
        got = encoder.encode(text).tolist()
        assert got == want, text[:40]
        machine = bpe.Decoder(encoder.vocabulary)
        assert "".join([*[machine.feed([i]) for i in got], machine.feed([], True)]) == library.decode(want, skip_special_tokens=False)


def test_lookahead_suffices():
    """What is settled while bytes arrive is what merging a piece at once gives, with a list and with a heap."""
    v = bpe.vocabulary(bpe.default_path())
    assert 0 < v.lookahead < 2_000
    rng = random.Random(1)
    letters = bytes(rng.choice(b"aeinorst") for _ in range(9_000))
    for piece in (b"a" * 7_000, b"-=" * 4_000, bytes(range(33, 127)) * 60, b"internationalization" * 300, letters):
        want = v._merge_long(piece)
        for size in (1 << 20, 1_000, 5_000):
            machine, parts = bpe.Transducer(v), [piece[n : n + size] for n in range(0, len(piece), size)]
            got = b"".join(x for n, part in enumerate(parts) for x in machine.feed(part, n == len(parts) - 1))
            assert np.frombuffer(got, np.int32).tolist() == want
            assert len(machine.open) == 0
    for n in range(300):
        piece = bytes(rng.choice(b"aeinorst ehlo") for _ in range(rng.randrange(1, bpe.SHORT)))
        assert v.merge(piece) == v._merge_long(piece)


@pytest.mark.parametrize("chunk", [4, 7, 64])
def test_chunks_dont_matter(monkeypatch, library, chunk):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    encoder = bpe.Encoder(bpe.vocabulary(bpe.default_path()))
    rng = random.Random(chunk)
    for _ in range(600):
        text = "".join(rng.choice(["a", "word", " ", "  ", "'", "'re", "'s", "1", "\n", "é", "你好", "=", "_", "\x85", "²", "<|endoftext|>", "\U0001f600"]) for _ in range(rng.randrange(40)))
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_texts_without_spaces(library):
    rng = random.Random(2)
    for chars, size in (([chr(n) for n in range(0x4E00, 0x9FA5)], 200_000), ([chr(n) for n in range(0x3041, 0x3097)], 100_000), (list("abcdefghijklmnopqrstuvwxyz"), 200_000)):
        text = "".join(rng.choices(chars, k=size))
        began = time.perf_counter()
        got = bpe.Encoder(bpe.vocabulary(bpe.default_path())).encode(text)
        assert time.perf_counter() - began < 10
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids


def test_memory_of_a_long_piece_is_bounded():
    """Beside the text and its ids, a long piece takes as much as a shorter one."""
    encoder, peaks = bpe.Encoder(bpe.vocabulary(bpe.default_path())), []
    run = "".join(random.Random(5).choices([chr(n) for n in range(0x3041, 0x3097)], k=1 << 20))
    encoder.encode(run)  # what is cached doesn't count
    for size in (1 << 18, 1 << 20):
        text = run[:size]
        tracemalloc.start()
        assert sum(len(part) for part in encoder._plain(text, 0, size))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] < 8 << 20


def test_every_document(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in bpe.op9_bpe(spark, small).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark, documents, odd):
    rows = bpe.op9_bpe(spark, documents(odd, clash=True)).collect()
    assert len(rows) == len(odd)
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (0, empty, empty) for r in rows if r["doc_id"] in (1, 2))
    assert bpe.op9_bpe(spark, documents([])).count() == 0
