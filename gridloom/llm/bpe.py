"""Byte-level BPE as a bounded-lookahead streaming transducer, and an incremental decoder.

A text is cut into pieces chunk by chunk, as the pre-tokenizer cuts it; a piece longer than a chunk is fed to the
transducer in parts. This keeps the bytes that are not settled yet: a token is emitted once the bytes after it can't
change it any more. :func:`sufficient_lookahead` derives from the merge list alone how many bytes that takes, and
between two bytes that stand side by side in no token nothing can change at all. So the working memory depends on neither
the length of a text nor that of a piece.

Decoding is a state machine over bytes: it keeps the open UTF-8 sequence between tokens.

Defined results: null text counts as empty and has no tokens; the vocabulary's special strings in a text
become their ids, as the ``tokenizers`` library does it by default; null ids decode to empty text, unknown
ids raise; rows are never merged, so repeated rows stay; extra columns aren't read.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import ready, table

SHIFT = 20  # of the first id in the key of a pair
MASK = (1 << SHIFT) - 1
NEVER = 1 << 62
WINDOW = 4096  # bytes of a piece that are merged at once, besides the lookahead
CHUNK = 1 << 16  # characters of a text that are split into pieces at once
MARGIN = 3  # characters after a piece's end that the pattern may look at
SHORT = 96  # bytes of a piece whose best pair is sought by looking at all pairs
CACHE = 150_000  # pieces of at most 64 bytes that a worker keeps in each of two generations

# The pre-tokenizer's pattern, and white space as that pattern means it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = r"\t-\r \x85\xa0  -     　"
# The same pattern for the standard library, which is faster; right for texts without ODD characters.
PLAIN = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]++|_++)++|\s+(?!\S)|\s+"


@lru_cache(1)
def _patterns() -> tuple[frozenset[str], re.Pattern, regex.Pattern]:
    """Odd characters, pieces of texts without them, pieces of any text."""
    numbers = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No")]
    letters = [c for c in range(sys.maxunicode + 1) if chr(c).isnumeric() and not chr(c).isdecimal()]
    marks = [c for c in range(sys.maxunicode + 1) if (chr(c).isalnum() or chr(c) == "_") != (unicodedata.category(chr(c))[0] in "LN" or chr(c) == "_")]
    odd = frozenset(map(chr, {*numbers, *letters, *marks, *range(0x1C, 0x20)}))
    exact = PIECES.replace(r"[^\s\p{L}", rf"[^{SPACE}\p{{L}}").replace(r"\s+(?!\S)|\s+", rf"[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
    return odd, re.compile(PLAIN), regex.compile(exact)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def sufficient_lookahead(merges: list[tuple[int, int, int]], length: dict[int, int]) -> int:
    """Bytes after a token that decide it, whatever follows them.

    merges: (left, right, merged) in order of priority. A merge fails at a place only if its right part, or
    a part on the right edge of that, is taken by an earlier merge with what follows. That merge in turn
    depends on still earlier ones, so one pass in order of priority bounds the chain of bytes.
    """
    formed: dict[int, int] = {}  # bytes beyond a token's end that decide whether it is formed
    taken: dict[int, int] = {}  # the same for the merges so far that take it as their left part
    for left, right, merged in merges:
        reach = max(formed.get(right, 0), taken.get(right, 0))
        formed[merged] = max(formed.get(merged, 0), reach)
        taken[left] = max(taken.get(left, 0), length[right] + reach)
    return max([0, *formed.values(), *taken.values()])


class Vocabulary:
    """A byte-level BPE vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        alphabet, ids = byte_alphabet(), data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        top = max([*ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes | None] = [None] * top
        for token, i in ids.items():
            if token not in self.special:
                self.bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        merges = []
        for m in data["model"]["merges"]:
            left, right = m if isinstance(m, list) else m.split(" ")
            merges.append((ids[left], ids[right], ids[left + right]))
        self.rank = {left << SHIFT | right: n << SHIFT | new for n, (left, right, new) in reversed(list(enumerate(merges)))}
        self.of_byte = [0] * 256
        for c, b in alphabet.items():
            self.of_byte[b] = ids[c]
        self.beside = np.zeros((256, 256), bool)  # bytes that stand side by side in some token
        for b in self.bytes:
            for x, y in zip(b or b"", (b or b"")[1:]):
                self.beside[x, y] = True
        self.lookahead = sufficient_lookahead(merges, {i: len(b) for i, b in enumerate(self.bytes) if b is not None})
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: the best pair is merged, leftmost first, until none is left."""
        if len(piece) > SHORT:
            return self._merge_long(piece)
        ids = list(map(self.of_byte.__getitem__, piece))
        get = self.rank.get
        ranks = [get(a << SHIFT | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            at = ranks.index(best)
            ids[at] = new = best & MASK
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << SHIFT | new, NEVER)
            if at < len(ranks):
                ranks[at] = get(new << SHIFT | ids[at + 1], NEVER)
        return ids

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs over linked positions: n log n steps for n bytes."""
        get, size = self.rank.get, len(piece)
        ids: list[int] = list(map(self.of_byte.__getitem__, piece))
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        # Entries are rank, position, merged id in one integer; they are stale if the pair there is another by now.
        pairs = [get(a << SHIFT | b) for a, b in zip(ids, ids[1:])] + [None]
        heap = [(r >> SHIFT) << 32 | n for n, r in enumerate(pairs) if r is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            at = top & 0xFFFFFFFF
            pair = pairs[at]
            if pair is None or pair >> SHIFT != top >> 32:
                continue
            gone = after[at]
            ids[at] = new = pair & MASK
            ids[gone] = -1
            pairs[gone] = None
            after[at] = next_ = after[gone]
            if next_ < size:
                before[next_] = at
                pairs[at] = r = get(new << SHIFT | ids[next_])
                if r is not None:
                    push(heap, (r >> SHIFT) << 32 | at)
            else:
                pairs[at] = None
            if (left := before[at]) >= 0:
                pairs[left] = r = get(ids[left] << SHIFT | new)
                if r is not None:
                    push(heap, (r >> SHIFT) << 32 | left)
        return [i for i in ids if i >= 0]


class Transducer:
    """Ids of the bytes of one piece that arrive bit by bit; the state is what isn't settled yet."""

    def __init__(self, vocabulary: Vocabulary, pieces: dict | None = None):
        self.vocabulary, self.open = vocabulary, b""
        self.pieces = Pieces(vocabulary, {}) if pieces is None else pieces

    def feed(self, more: bytes, last: bool = False) -> Iterator[bytes]:
        """Ids, as int32 bytes, that are settled now."""
        v, data = self.vocabulary, self.open + more
        b = np.frombuffer(data, np.uint8)
        edges = (np.flatnonzero(~v.beside[b[:-1], b[1:]]) + 1).tolist() if len(b) > 1 else []
        start = 0
        for end in [*edges, *([len(data)] if last else [])]:
            if end - start > WINDOW + v.lookahead:
                at, parts = self._windows(data[start:end])
                yield from parts
                start += at
            if end - start <= SHORT:
                yield self.pieces[data[start:end]]
            else:
                yield np.asarray(v.merge(data[start:end]), np.int32).tobytes()
            start = end
        at, parts = self._windows(data[start:])
        yield from parts
        self.open = data[start + at :]

    def _windows(self, data: bytes) -> tuple[int, list[bytes]]:
        """Stable ids of data that goes on, and how many bytes they cover."""
        v, start, out = self.vocabulary, 0, []
        while len(data) - start > WINDOW + v.lookahead:
            ids = v.merge(data[start : start + WINDOW + v.lookahead])
            stable, end = 0, 0
            while end + len(v.bytes[ids[stable]]) <= WINDOW:
                end += len(v.bytes[ids[stable]])
                stable += 1
            out.append(np.asarray(ids[:stable], np.int32).tobytes())
            start += end
        return start, out


class Pieces(dict):
    """Ids, as int32 bytes, by piece; a piece that isn't kept yet is encoded when it is asked for."""

    def __init__(self, vocabulary: Vocabulary, before: dict[str | bytes, bytes]):
        super().__init__()
        self.vocabulary, self.before = vocabulary, before

    def __missing__(self, piece: str | bytes) -> bytes:
        found = self.before.get(piece)
        if found is None:
            raw = piece.encode() if isinstance(piece, str) else piece
            if len(raw) > SHORT:  # long pieces are rare and would fill the cache
                return b"".join(Transducer(self.vocabulary, self).feed(raw, True))
            found = np.asarray(self.vocabulary.merge(raw), np.int32).tobytes()
        if len(self) < CACHE:
            self[piece] = found
        return found


class Encoder:
    """Encodes texts one after another; keeps recent pieces in two bounded generations."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pieces = Pieces(vocabulary, {})

    def _plain(self, text: str, start: int, stop: int) -> Iterator[bytes]:
        """Ids, as int32 bytes, of a part of a text in which no special string stands."""
        odd, plain, exact = _patterns()
        pattern = plain if all(odd.isdisjoint(text[n : min(stop, n + CHUNK)]) for n in range(start, stop, CHUNK)) else exact
        while start < stop:
            if len(self.pieces) >= CACHE:
                self.pieces = Pieces(self.vocabulary, dict(self.pieces))
            end = min(stop, start + CHUNK)
            found = pattern.findall(text, start, end)
            if end < stop:  # the last pieces may go on or be cut in another way
                while found and end > start + CHUNK - MARGIN:
                    end -= len(found.pop())
                if not found:
                    end = pattern.match(text, start, stop).end()
                    machine = Transducer(self.vocabulary, self.pieces)
                    for n in range(start, end, CHUNK):
                        yield from machine.feed(text[n : min(end, n + CHUNK)].encode(), n + CHUNK >= end)
            yield b"".join(map(self.pieces.__getitem__, found))
            start = end

    def encode(self, text: str | None) -> np.ndarray:
        out, start = bytearray(), 0
        text = text or ""
        split, special = self.vocabulary.split_special, self.vocabulary.special
        for m in split.finditer(text) if split else ():
            out += b"".join(self._plain(text, start, m.start()))
            out += np.asarray([special[m[0]]], np.int32).tobytes()
            start = m.end()
        for part in self._plain(text, start, len(text)):
            out += part
        return np.frombuffer(bytes(out), np.int32)


class Decoder:
    """Text of ids that arrive bit by bit; the state is an open UTF-8 sequence of at most three bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes = vocabulary.bytes
        self.open = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        return self.open.decode(b"".join(map(self.bytes.__getitem__, ids)), last)


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One encoder a worker: later tasks find the pieces of earlier ones."""
    return Encoder(vocabulary(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, text: str = "text", into: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The columns ``keep``, and the ids of ``text`` as an array of integers."""
    ready(df.sparkSession)
    path = path or default_path()

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                ids = [encoder.encode(x) for x in part.column(0).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], names=[*keep, into])

    kept = df.select(F.col(f"`{text}`").cast("string").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    schema = ", ".join([*[f"`{c}` {t}" for c, t in kept.dtypes[1:]], f"`{into}` array<int>"])
    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """All columns, and the text of ``ids``."""
    ready(df.sparkSession)
    path = path or default_path()
    names = df.columns

    def run(batches):
        known = vocabulary(path)
        for batch in batches:
            column = batch.column(names.index(ids))
            texts = []
            for at in range(batch.num_rows):
                machine, values = Decoder(known), column[at].values
                values = values.to_numpy() if values is not None else np.zeros(0, np.int32)
                parts = [machine.feed(values[n : n + CHUNK].tolist()) for n in range(0, len(values), CHUNK)]
                texts.append("".join([*parts, machine.feed([], True)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, into])

    return df.mapInArrow(run, ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes], f"`{into}` string"]))


def digests(df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, the number of ids, and digests of ids and decoded text."""
    return df.select(
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return digests(decode(encode(table(spark, sf_dir, "documents"))))
