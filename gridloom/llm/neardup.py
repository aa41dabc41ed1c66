"""Near-duplicates with DartMinHash signatures, banded joining and an exact check.

Shingles are the distinct runs of ``SHINGLE`` words of a text (of all its words, if it has fewer), weighted by how often
they occur in it. Each shingle throws hashed darts: a Poisson process over weight and rank, drawn from the shingle's hash
alone. Darts below the shingle's weight and below rank theta count; each falls on one of K coordinates, and the earliest
of a coordinate is its value in the signature. theta is set so that some K ln K + 2 K darts count, and doubled while a
coordinate is empty. Two texts agree in a coordinate with the probability of their weighted Jaccard similarity: the sum
of the lesser weights over the sum of the greater ones. For texts without repeated shingles that is the similarity of sets.

Texts with equal weighted shingles are one node, brought together by a sum of keys, not by comparing. Nodes meet in
``BANDS`` bands of K / BANDS coordinates: pairs as similar as 0.8 miss each other in all bands once in ten million. First
each node of a bucket is paired with the bucket's centre, and the links found make first classes. Then all nodes of a
bucket that are in different classes are compared: those outside its largest class with each other, and with that class
as a whole, once for all buckets. This is done in tiles of some ``TILE`` nodes, so that no task holds a bucket, on
sketches of the texts: their ``SKETCH`` least shingles, which are all of most texts. A tile gives only links that join
two of its classes, and pairs that a sketch can't decide. A hot text's variants are one class by then and cost no
comparison; a bucket of many texts of as many classes costs all its pairs in time, but not in rows. All pairs that give
links are compared exactly in the end, by all their weighted shingles. Classes are the connected components of the links.

Defined results: class_id is the smallest doc_id of a class; null, empty and wordless texts are linked to nothing; rows
that share a doc_id are one document; rows with null doc_id come back with null class_id; repeated rows come back
repeated; extra columns aren't read by :func:`classes`.
"""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import cut, drop, fresh, ready, table
from gridloom.llm.components import components

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 30, 4
K = BANDS * ROWS
HOPELESS = 0.62  # a share of equal coordinates 4.9 deviations below 0.8: such pairs aren't compared
TILE = 1_024  # nodes that are compared with as many others at once
BIG = 32  # nodes of a bucket's largest class, beyond which it is compared as a whole
SKETCH = 2_048  # shingles of a sketch
DOUBT = 5 * 0.4 / SKETCH**0.5  # five deviations of a similarity near 0.8 that a cut sketch estimates
SENT = 2_000_000  # ids of 8 bytes that may be broadcast
FAN = 4_096  # pairs of a text that meet one copy of its shingles; texts in more pairs are copied
BLOCK = 1 << 20  # bytes of a text hashed at once
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    one, back = np.full(BLOCK + 1, base, U), np.full(BLOCK + 1, inverse, U)
    one[0] = back[0] = 1
    return np.cumprod(one), np.cumprod(back)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of a text."""
    raw, out, at = (text or "").encode("utf-8", "surrogatepass"), [], 0
    power, inverse = _powers()
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        if end < len(raw):  # a block ends between words; a longer word is cut, everywhere alike
            gap = max(raw.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r"))
            end = gap + 1 if gap >= at else end
        b = np.frombuffer(raw, np.uint8, end - at, at)
        word = ~((b == 32) | ((b >= 9) & (b <= 13)))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], word.view(np.int8), [0]])))
        starts, ends = edge[::2], edge[1::2]
        total = np.concatenate([np.zeros(1, U), np.cumsum((b.astype(U) + U(1)) * power[: len(b)])])
        out.append(mix((total[ends] - total[starts]) * inverse[starts] ^ ((ends - starts).astype(U) << U(48))))
        at = end
    return np.concatenate(out) if out else np.zeros(0, U)


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of a text, sorted, and how often each occurs."""
    w = word_hashes(text)
    if not len(w):
        return w, np.zeros(0, np.int64)
    size = min(size, len(w))
    n = len(w) - size + 1
    total = np.full(n, size, U)
    for k in range(size):
        total = mix(total * U(0x9E3779B97F4A7C15) + w[k : k + n])
    return np.unique(total, return_counts=True)


def single(items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set whose Jaccard similarity is the weighted one of the items: the n-th occurrence of an item is an item."""
    if not len(items) or counts.max() == 1:
        return items
    again = np.repeat(np.flatnonzero(counts > 1), counts[counts > 1] - 1)
    start = np.concatenate([[0], np.flatnonzero(np.diff(again)) + 1])
    number = np.arange(len(again)) - np.repeat(start, np.diff(np.concatenate([start, [len(again)]]))) + 1
    return np.concatenate([items, mix(items[again] + number.astype(U) * U(0x94D049BB133111EB))])


def darts(items: np.ndarray, weights: np.ndarray | None, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """Ranks and names of the darts of weighted items below rank theta."""
    ranks, names = [], []
    top = 1.0 if weights is None else float(weights.max())
    low, high, layer = 0.0, 1.0, 0
    while low < top:  # layers of weight: 0 to 1, to 2, to 4 ...
        own = np.arange(len(items)) if weights is None else np.flatnonzero(weights > low)
        rate = high - low
        seed = mix(items[own] + U(layer * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        rank, at = np.zeros(len(own)), 0
        width = 1 if len(own) > 256 else int(theta * rate + 5 * math.sqrt(theta * rate) + 8)
        while len(seed):
            step = np.arange(at + 1, at + width + 1, dtype=U) * U(0x9E3779B97F4A7C15)
            h = mix(seed[:, None] + step[None, :])
            r = rank[:, None] + np.cumsum(-np.log(((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53), axis=1) / rate
            hit = r < theta
            name = mix(h ^ U(0xA0761D6478BD642F))
            if weights is not None:
                where = low + rate * ((mix(h ^ U(0xE7037ED1A0B428DB)) >> U(11)).astype(np.float64) * 2.0**-53)
                taken = hit & (where < weights[own][:, None])
            else:
                taken = hit
            ranks.append(r[taken])
            names.append(name[taken])
            more = hit[:, -1]
            seed, rank, own, at = seed[more], r[more, -1], own[more], at + width
        low, high, layer = high, 2 * high, layer + 1
    return np.concatenate(ranks), np.concatenate(names)


def signature(items: np.ndarray, weights: np.ndarray | None = None, k: int = K) -> np.ndarray:
    """Names of the earliest darts of k coordinates; weights of None are all 1."""
    theta = (k * math.log(k) + 2 * k) / float(len(items) if weights is None else weights.sum())
    while True:
        rank, name = darts(items, weights, theta)
        coordinate = (name % U(k)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        out, full = np.zeros(k, U), np.zeros(k, bool)
        out[coordinate[order]] = name[order]
        full[coordinate] = True
        if full.all():
            return out
        theta *= 2


SIGNED = "doc_id bigint, n int, k1 bigint, k2 bigint, sig array<int>"


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n, k1, k2, sig): number of shingles with repeats, key of the weighted set, and signature of each text."""
    ready(docs.sparkSession)

    def run(batches):
        nothing = np.zeros(K, U)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                number, key1, key2, sigs = [], [], [], []
                for text in part.column(1).to_pylist():
                    items, counts = shingles(text)
                    weights = None if not len(items) or counts.max() == 1 else counts.astype(np.float64)
                    sig = signature(items, weights) if len(items) else nothing
                    s = single(items, counts)
                    number.append(len(s))
                    key1.append(np.add.reduce(mix(s + U(1))))
                    key2.append(np.bitwise_xor.reduce(mix(s ^ U(0xE7037ED1A0B428DB))) if len(s) else U(0))
                    sigs.append((sig >> U(8)).astype(np.uint32).view(np.int32))
                ends = np.arange(len(sigs) + 1, dtype=np.int32) * K
                columns = [part.column(0), pa.array(number, pa.int32()), pa.array(np.array(key1, U).view(np.int64)), pa.array(np.array(key2, U).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sigs)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "k1", "k2", "sig"])

    return docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text")).mapInArrow(run, SIGNED)


def buckets(nodes: DataFrame) -> DataFrame:
    """(id, band, value, size): the buckets of at least two nodes (id, sig). A value is a hash of a band's number and coordinates."""
    value = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(b, *[F.get("sig", b * ROWS + n) for n in range(ROWS)]).alias("value")))
    rows = nodes.select("id", F.inline(value))
    sizes = rows.groupBy("value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return rows.join(sizes, "value").select("id", "band", "value", "size")


def central(met: DataFrame) -> DataFrame:
    """Pairs a < b of each node of a bucket with the bucket's centre.

    The centre of a bucket is the node whose buckets are largest in sum: the text that most others are variants of
    is in the largest bucket of every band, while each variant leaves some. So a star of variants keeps all its
    links, also where the variants aren't similar to each other.
    """
    fame = met.groupBy("id").agg(F.sum("size").alias("fame"))
    centres = met.join(fame, "id").groupBy("value").agg(F.max(F.struct("fame", (-F.col("id")).alias("id"))).alias("top"))
    pairs = met.join(centres, "value").select("id", (-F.col("top")["id"]).alias("other")).where("id <> other")
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _of_texts(docs: DataFrame, ids: DataFrame, made, schema: str) -> DataFrame:
    """(id, *schema): what ``made`` gives for the weighted shingles of each text with one of the ids, written."""
    # Where the ids are known to be few, they are sent to the texts; else both are shuffled.
    sent = F.broadcast(ids) if ids.count() <= SENT else ids.hint("merge")
    texts = docs.select(F.col("`doc_id`").cast("long").alias("id"), F.col("`text`").cast("string").alias("text")).join(sent, "id", "left_semi")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [made(single(*shingles(t))) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["id", "s"])

    return cut(texts.select("id", "text").mapInArrow(run, f"id bigint, s {schema}"))


def sketch(items: np.ndarray) -> np.ndarray:
    """The least shingles as 32-bit numbers in order."""
    return np.sort((items >> U(32)).astype(np.uint32))[:SKETCH].view(np.int32)


def _joined(low: bool, own: np.ndarray, ids: np.ndarray, classes_: np.ndarray, items: list[np.ndarray], similar: float):
    """(a, b) of links that join the classes of a tile, and of pairs in doubt; of all pairs, or of the two parts."""
    both = np.concatenate(items)
    _, code = np.unique(both, return_inverse=True)
    size = np.array([len(x) for x in items])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    most = np.array([x[-1] if len(x) >= SKETCH else np.iinfo(np.uint32).max for x in items], np.uint32)
    cut_ = size >= SKETCH
    classes_ = classes_.copy()
    flags = np.zeros(int(code.max()) + 1, np.int64)
    left = np.arange(len(ids)) if low else np.flatnonzero(own)
    for n in left:
        mine = code[first[n] : first[n] + size[n]]
        flags[mine] = 1
        common = np.add.reduceat(flags[code], first)
        flags[mine] = 0
        others = classes_ != classes_[n]
        others &= (np.arange(len(ids)) > n) if low else ~own
        # Beyond the least end of two sketches nothing is known, so only what is up to there counts.
        up_to = np.minimum(most, most[n])
        ours = np.searchsorted(items[n], up_to, "right") if cut_.any() else np.full(len(ids), size[n])
        theirs = np.add.reduceat(both <= most[n], first) if cut_[n] else size
        share = common / (ours + theirs - common)
        doubt = np.where(cut_ | cut_[n], DOUBT, 0.0)
        sure = np.flatnonzero(others & (share >= similar + doubt))
        for m in sure[np.argsort(-share[sure], kind="stable")]:
            if classes_[m] != classes_[n]:
                yield min(ids[n], ids[m]), max(ids[n], ids[m])
                classes_[classes_ == classes_[m]] = classes_[n]
        for m in np.flatnonzero(others & (share >= similar - doubt) & (share < similar + doubt) & (classes_ != classes_[n])):
            yield min(ids[n], ids[m]), max(ids[n], ids[m])


def tiles(met: DataFrame, named: DataFrame) -> DataFrame:
    """(id, class, key, low, high, first): in which tiles a node stands, and whether in their first part.

    In a bucket of several classes, the nodes outside its largest class meet each other, in tiles of the bucket. If that
    class is big, they meet all of it, in tiles of the class, whatever the number of buckets; else it is one of the others.
    """
    held = met.join(named, "id", "left").select("id", "value", F.coalesce("component", "id").alias("class"))
    counts = held.groupBy("value", "class").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("value").agg(F.sum("n").alias("size"), F.max(F.struct("n", "class")).alias("top"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    big = F.col("top")["n"] > BIG
    mixed = mixed.select("value", F.when(big, F.col("top")["class"]).alias("top"), (F.col("size") - F.when(big, F.col("top")["n"]).otherwise(0)).alias("few"), F.when(big, F.col("classes") - 1).otherwise(F.col("classes")).alias("classes"))
    few = cut(held.join(mixed, "value").where(~F.col("class").eqNullSafe(F.col("top"))))
    within = few.where("classes > 1").select("id", "class", F.col("value").alias("key"), F.ceil(F.col("few") / TILE).alias("parts"))
    within = within.withColumn("own", F.pmod(F.xxhash64("id"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    within = within.select("id", "class", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.col("own").alias("own"))
    guests = few.where("top is not null").select("id", "class", F.col("top").alias("key")).distinct()
    hosts = named.select("id", F.col("component").alias("key"))
    sizes = guests.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("guests")).join(hosts.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("hosts")), "key")
    sides = []
    for rows, own, other in ((guests, "guests", "hosts"), (hosts.withColumn("class", F.col("key")), "hosts", "guests")):
        rows = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), own)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        # Tiles of classes are numbered below zero, apart from those of buckets.
        low, high = ("own", "other") if own == "guests" else ("other", "own")
        sides.append(rows.select("id", "class", "key", (-1 - F.col(low)).alias("low"), F.col(high).alias("high"), (F.lit(0) if own == "guests" else F.lit(1)).cast("long").alias("own")))
    first = F.when(F.col("low") < 0, F.col("own") == 0).otherwise(F.col("own") == F.col("low"))
    return within.unionByName(sides[0]).unionByName(sides[1]).select("id", "class", "key", "low", "high", first.alias("first"))


def crossing(met: DataFrame, named: DataFrame, sketches, similar: float = SIMILAR) -> DataFrame:
    """(a, b): links between the classes of nodes that share a bucket, or pairs in doubt; ``sketches`` gives (id, s) of ids."""
    placed = cut(tiles(met, named))
    key = ["key", "low", "high"]
    rows = placed.join(sketches(placed.select("id").distinct()), "id").repartition(*key).sortWithinPartitions(*key)

    def links_of(table: pa.Table):
        columns = {c: table.column(c).to_numpy() for c in ("id", "class", *key)}
        first = table.column("first").to_numpy(zero_copy_only=False).astype(bool)
        items = [np.asarray(x, np.int32).view(np.uint32) for x in table.column("s").to_numpy(zero_copy_only=False)]
        return _joined(columns["low"][0] == columns["high"][0], first, columns["id"], columns["class"], items, similar)

    def run(batches):
        held, at = [], None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in key]
            new = np.zeros(max(0, batch.num_rows - 1), bool)
            for c in columns:
                new |= np.diff(c) != 0
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for start, end in zip(edges, edges[1:]):
                if start == end:
                    continue
                tile = tuple(int(c[start]) for c in columns)
                if tile != at and held:
                    yield from _pairs(links_of(pa.Table.from_batches(held)))
                    held = []
                at = tile
                held.append(batch.slice(start, end - start))
        if held:
            yield from _pairs(links_of(pa.Table.from_batches(held)))

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _pairs(found):
    """Batches of pairs."""
    while part := list(itertools.islice(found, 4096)):
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*part)], names=["a", "b"])


def verified(docs: DataFrame, pairs: DataFrame, similar: float) -> DataFrame:
    """Those of the pairs (a, b) whose weighted shingles are similar."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("copies")))
    sets = _of_texts(docs, wanted.select("id"), lambda items: items.view(np.int64), "array<bigint>")
    both = F.size(F.array_intersect("s_a", "s_b"))
    for x, y in ("ab", "ba"):  # a text in many pairs is copied, and its pairs dealt to the copies
        many = wanted.select(F.col("id").alias(x), F.col("copies").alias("of"))
        pairs = pairs.join(many, x).withColumn(f"part_{x}", F.pmod(F.xxhash64(y), "of").cast("int")).drop("of")
    sides = [sets.join(wanted, "id").select(F.col("id").alias(x), F.col("s").alias(f"s_{x}"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias(f"part_{x}")) for x in "ab"]
    exact = pairs.join(sides[0], ["a", "part_a"]).join(sides[1], ["b", "part_b"]).where(both >= similar * (F.size("s_a") + F.size("s_b") - both))
    return exact.select("a", "b")


def links(docs: DataFrame, nodes: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Pairs (a, b) that join all nodes with similar weighted shingles: links to centres' classes, then those between classes."""
    met = cut(buckets(nodes))
    sides = [nodes.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab"]
    equal = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda t, x: t + x)
    judged = cut(central(met).join(sides[0], "a").join(sides[1], "b").where(equal >= HOPELESS * K).select("a", "b"))
    named = cut(components(verified(docs, judged, similar)))
    more = crossing(met, named, lambda ids: _of_texts(docs, ids, sketch, "array<int>"), similar)
    more = cut(more.join(judged, ["a", "b"], "left_anti"))
    drop(met)
    return named.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(verified(docs, more, similar))


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, class_id) for each row of (doc_id, text)."""
    all_ = cut(signed(docs))
    keyed = all_.where("n > 0 and doc_id is not null")
    # Tables of groups are written before the joins, so that Spark can split a hot group's rows in these.
    first = cut(keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("id")))
    nodes = keyed.join(first.select("k1", "k2", F.col("id").alias("doc_id")), ["k1", "k2", "doc_id"]).select(F.col("doc_id").alias("id"), "k1", "k2", "sig").dropDuplicates(["k1", "k2", "id"])
    nodes = cut(nodes)
    found = links(docs, nodes, similar)
    # Documents that share an id are one: their nodes are linked through it.
    shared = keyed.join(first, ["k1", "k2"]).where("id <> doc_id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    named = components(found.select("a", "b").unionByName(shared.join(nodes.select(F.col("id").alias("b")).distinct(), "b", "left_semi").select("a", "b")))
    of_node = nodes.select("k1", "k2", "id").join(named, "id", "left").groupBy("k1", "k2").agg(F.min(F.coalesce("component", "id")).alias("class_id"))
    of_node = cut(of_node)
    rest = all_.select("doc_id", "n", F.when(F.col("n") > 0, F.col("k1")).alias("k1"), F.when(F.col("n") > 0, F.col("k2")).alias("k2"))
    return rest.join(of_node, ["k1", "k2"], "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def deduplicate(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """All columns of one document of each class, that with the smallest doc_id."""
    name = fresh(docs, "_gone")
    gone = classes(docs, similar).where("class_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(name), "left_anti")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return classes(table(spark, sf_dir, "documents"))
