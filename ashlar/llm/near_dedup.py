"""MinHash near-dedup by a multi-index Hamming join, with links confirmed on full shingle sets.

A document's set holds its distinct word shingles. Equal sets are one class at once. Each class has a
signature of CHUNKS * WIDTH minhashes, cut into chunks; two signatures that differ in at most
(ERRORS + 1) * CHUNKS - 1 places have a chunk with at most ERRORS differences (pigeonhole), so both reach
a common key when each chunk is indexed once for every choice of ERRORS places to leave out. Signatures
are kept at BITS bits a place for the distance filter.

A bucket isn't expanded into all pairs: its members are paired with HUBS of them, links are confirmed, and
only members of different components are compared with each other in a second pass. There a parity bitmap
of each set bounds the symmetric difference of two sets from below, which rules out most pairs for sure.
So no link is lost between classes that share a bucket.

Defined cases: null and empty texts, and texts without words, have an empty set and link with nothing;
texts with fewer words than a shingle are one shingle; repeated rows get a row each, and rows of one
doc_id with different texts count as one document with the first of them as its set; rows without a doc_id
have the component of equal sets that have one, or none, and stay in the latter case only; texts and words of any
length are taken whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pieces, save, shared_dir

CHUNKS, WIDTH, ERRORS, BITS = 10, 4, 1, 4
PLACES = CHUNKS * WIDTH
#: Signatures that differ in more places aren't checked: at a similarity of 0.8 the chance is about 1e-8.
MOST_DISTANCE = 24
#: Members of a bucket that all others are paired with.
HUBS = 4
#: Bits of a set's parity bitmap.
PARITY = 2048
#: Members of a bucket's size band that are compared at once in the second pass; pairs of a hub checked in one task.
PART, PAIRS_A_TASK = 2048, 512
#: Keys with more members than this (estimated from a sample) are first worked on in SALTS parts.
HOT_KEY, SALTS, SAMPLE = 20_000, 16, 0.01

_DELIMITERS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_VALUES = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_VALUES[_DELIMITERS] = 0
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
#: Factor of each further 4096 bytes of a word; 1 for the first, so that a word's hash is its own.
_LONG = np.cumprod(np.array([1, *[0xC2B2AE3D27D4EB4F] * 65535], np.uint64))
_MINHASH = np.random.Generator(np.random.PCG64(78)).integers(1, 1 << 63, (2, PLACES), dtype=np.uint64)
_MINHASH[0] |= np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[bytes], slab: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and the number of words up to each text's start and the end.

    Bytes are worked on in slabs; a word that runs on into the next slab is summed up from its parts.
    """
    whole = b" ".join([*texts, b""])
    every, sums, start = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    before = True  # was the last byte a delimiter?
    for s in range(0, len(whole), slab):
        x = np.frombuffer(whole, np.uint8, min(slab, len(whole) - s), s)
        gaps = _DELIMITERS[x]
        starts = np.flatnonzero(~gaps & np.concatenate([[before], gaps[:-1]]))
        # places count from the start of a byte's word, or of the word before a gap, where values are 0
        at = np.arange(s, s + len(x))
        firsts = np.concatenate([[start], starts + s])
        place = at - np.repeat(firsts, np.diff(np.concatenate([[0], starts, [len(x)]])))
        values = _VALUES[x] * _POWERS[place & 4095]
        if place.max() >= 4096:
            values *= _LONG[(place >> 12) & 65535]
        if len(starts):
            if starts[0] > 0 and len(sums[-1]):
                sums[-1][-1:] += values[: starts[0]].sum()
            sums.append(np.add.reduceat(values, starts))
            every.append(starts + s)
            start = int(starts[-1]) + s
        elif len(sums[-1]):
            sums[-1][-1:] += values.sum()
        before = bool(gaps[-1])
    ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return mixed(np.concatenate(sums)), np.searchsorted(np.concatenate(every), ends)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased by the caller)."""
    words, offsets = word_hashes(texts)
    a = np.uint64(0x9E3779B97F4A7C15)
    out = []
    whole = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        whole = whole * a + words[k : len(words) - size + 1 + k] if len(whole) else whole
    whole = mixed(whole)
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if e - s >= size:
            out.append(np.unique(whole[s : e - size + 1]))
        elif e > s:
            h = np.array([e - s], np.uint64)
            for w in words[s:e]:
                h = h * a + w
            out.append(mixed(h))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def parity(s: np.ndarray) -> bytes:
    """A bit per residue of the hashes: is it hit an odd number of times? Two sets differ in at least as many elements as their bitmaps in bits."""
    return np.packbits(np.bincount((s % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).tobytes()


def portions(batch: pa.RecordBatch, size: int = 1 << 18) -> Iterator[tuple[list, list[bytes]]]:
    """doc_ids and lower-cased texts of a batch, about a quarter of a megabyte at a time."""
    ids, texts, held = [], [], 0
    for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
        ids.append(i)
        texts.append((t or "").encode().lower())
        held += len(texts[-1])
        if held >= size:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, class (hash of the set; null if empty), signature (32 bits a place), parity (bitmap of the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for ids, texts in portions(batch):
                sets = shingle_sets(texts, size)
                full = [s for s in sets if len(s)]
                sig = np.zeros((len(full), PLACES), "<u4")
                if full:
                    every, at = np.concatenate(full), np.cumsum([0, *(len(s) for s in full[:-1])])
                    for k in range(PLACES):
                        sig[:, k] = np.minimum.reduceat(every * _MINHASH[0, k] + _MINHASH[1, k], at) >> np.uint64(32)
                rows = iter(sig)
                names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()), pa.array([parity(s) if len(s) else None for s in sets], pa.binary())], ["doc_id", "n", "class", "signature", "parity"])

    return docs.mapInArrow(run, "doc_id long, n long, class binary, signature binary, parity binary")


def index_keys(classes: DataFrame) -> DataFrame:
    """key, id, n, sig: each chunk of a signature under every choice of ERRORS places left out."""
    kept = [list(c) for c in itertools.combinations(range(WIDTH), WIDTH - ERRORS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2048):
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(-1, PLACES).astype(np.uint64)
            low = sig & np.uint64((1 << BITS) - 1)
            short = np.packbits(np.unpackbits(low.astype(np.uint8)[..., None], axis=-1)[..., 8 - BITS :].reshape(len(sig), -1), axis=-1)
            short = pa.array([r.tobytes() for r in short], pa.binary())
            for c in range(CHUNKS):
                for v, places in enumerate(kept):
                    h = np.full(len(sig), c * len(kept) + v + 1, np.uint64)
                    for p in places:
                        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, c * WIDTH + p])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("id"), batch.column("n"), short], ["key", "id", "n", "sig"])

    return classes.select("id", "n", "signature").mapInArrow(run, "key long, id long, n long, sig binary")


def places_of(sig: list[bytes]) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(b"".join(sig), np.uint8).reshape(len(sig), -1), axis=-1)
    return np.packbits(bits.reshape(len(sig), PLACES, BITS), axis=-1)[..., 0]


def within(n, m, distance: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and signature distances allow the similarity."""
    return (distance <= MOST_DISTANCE) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


class Hubs:
    """The hubs of the bucket that is being streamed, and the pairs found so far."""

    def __init__(self, percent: int):
        self.percent, self.pairs = percent, []
        self.ids, self.n, self.sig = [], [], []

    def take(self, i: int, n: int, sig: np.ndarray) -> bool:
        """Pair a member with the hubs it may link with; whether it became a hub."""
        if self.ids:
            d = (np.array(self.sig) != sig).sum(axis=1)
            for k in np.flatnonzero(within(np.array(self.n), n, d, self.percent)):
                if self.ids[k] != i:
                    self.pairs.append((min(self.ids[k], i), max(self.ids[k], i)))
        if len(self.ids) >= HUBS:
            return False
        self.sig.append(sig)
        self.ids.append(i)
        self.n.append(n)
        return True


def hub_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Stream buckets (key, salt): kind 0 rows are pairs (a, b); kind 1 rows hubs of salted buckets; kind 2 rows members of buckets with company."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hubs, first, out = None, None, None, []

        def full(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal out
            if len(out) > least:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["kind", "a", "b", "key", "n", "sig"])
                out = []

        for batch in pieces(batches, 2048):
            sigs = places_of(batch.column("sig").to_pylist())
            key, salt = batch.column("key").to_numpy(), batch.column("salt").to_numpy()
            same = np.zeros(len(key), bool)  # as the row before or after: the others stand alone
            same[1:] = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1])
            alone = ~same
            alone[:-1] &= ~same[1:]
            alone[[0, -1]] = False  # their neighbours are in other batches
            ids, ns, raw = batch.column("id").to_pylist(), batch.column("n").to_pylist(), batch.column("sig").to_pylist()
            for r in np.flatnonzero(~alone | (salt > 0)).tolist():
                k = (int(key[r]), int(salt[r]))
                if k != now:
                    now, hubs, first = k, Hubs(percent), (ids[r], ns[r], raw[r])
                elif first is not None:
                    out.append((2, first[0], 0, k[0], first[1], first[2]))
                    first = None
                    out.append((2, ids[r], 0, k[0], ns[r], raw[r]))
                else:
                    out.append((2, ids[r], 0, k[0], ns[r], raw[r]))
                if hubs.take(ids[r], ns[r], sigs[r]) and k[1] > 0:
                    out.append((1, ids[r], 0, k[0], ns[r], raw[r]))
                out.extend((0, a, b, k[0], 0, None) for a, b in hubs.pairs)
                hubs.pairs.clear()
            yield from full(5_000)
        yield from full(0)

    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt", F.xxhash64("id"), "id").mapInArrow(run, "kind int, a long, b long, key long, n long, sig binary")


def size_band(n, percent: int):
    """Sets whose sizes allow the similarity are in the same or in neighbouring bands."""
    return F.floor(F.log(n) / (max(0.01, math.log(100 / percent)) * (1 + 1e-9))).cast("int")


def cross_pairs(members: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of bucket members in different components that sizes and parity bitmaps allow.

    The members of a bucket of more than PART are dealt into bands by the size of their sets, and a band's into
    parts; each part is compared with itself, with every later part of its band and with the parts of the next band.
    """
    m = members.select("key", F.col("a").alias("id")).join(labels, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("component")).dropDuplicates(["key", "id"])
    several = m.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where(f"lo < hi AND size > {HUBS + 1}").select("key", "size")
    band = F.when(F.col("size") > PART, size_band(F.col("n"), percent)).otherwise(0)
    m = m.join(several, "key").join(classes.select("id", "n", "parity"), "id").withColumn("band", band)
    bands = m.groupBy("key", "band").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    after = bands.select("key", (F.col("band") - 1).alias("band"), F.col("parts").alias("next_parts"))
    before = bands.select("key", (F.col("band") + 1).alias("band"), F.col("parts").alias("last_parts"))
    bands = bands.join(after, ["key", "band"], "left").join(before, ["key", "band"], "left")
    m = m.join(bands, ["key", "band"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # the task (key, low, i, high, j) compares part i of the lower band with part j of the same band (i <= j) or the next
    upto = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    part, band = F.col("part"), F.col("band")
    own = F.transform(upto("parts"), lambda o: F.struct(band.alias("low"), F.least(part, o).alias("i"), band.alias("high"), F.greatest(part, o).alias("j")))
    up = F.transform(upto("next_parts"), lambda o: F.struct(band.alias("low"), part.alias("i"), (band + 1).alias("high"), o.alias("j")))
    down = F.transform(upto("last_parts"), lambda o: F.struct((band - 1).alias("low"), o.alias("i"), band.alias("high"), part.alias("j")))
    none = F.array().cast("array<struct<low:int,i:int,high:int,j:int>>")
    m = m.withColumn("task", F.explode(F.concat(own, F.coalesce(up, none), F.coalesce(down, none))))
    m = m.select("key", "task.low", "task.i", "task.high", "task.j", "band", "part", "id", "n", "parity", "component")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in pieces(batches):
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "low", "i", "high", "j", "band", "part", "id", "n", "parity", "component")), strict=True):
                if row[:5] != now:
                    if len(held) > 1:
                        yield from compared(now, held)
                    now, held = row[:5], []
                held.append(row[5:])
        if len(held) > 1:
            yield from compared(now, held)

    def compared(now: tuple, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        band, part, ids, n, comp = (np.array([h[k] for h in held], np.int64) for k in (0, 1, 2, 3, 5))
        bits = np.frombuffer(b"".join(h[4] for h in held), np.uint64).reshape(len(held), -1)
        for r in range(len(held) - 1):
            rest = slice(r + 1, None)
            # similar sets differ in at most (100 - percent) / (100 + percent) of both sizes' sum
            ok = (comp[rest] != comp[r]) & (100 * np.minimum(n[rest], n[r]) >= percent * np.maximum(n[rest], n[r]))
            if now[1:3] != now[3:]:
                ok &= (band[rest] != band[r]) | (part[rest] != part[r])
            at = r + 1 + np.flatnonzero(ok)
            at = at[(100 + percent) * np.bitwise_count(bits[at] ^ bits[r]).sum(axis=1, dtype=np.int64) <= (100 - percent) * (n[at] + n[r])]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[at], ids[r])), pa.array(np.maximum(ids[at], ids[r]))], ["a", "b"])

    tasks = ["key", "low", "i", "high", "j"]
    return m.repartition(*tasks).sortWithinPartitions(*tasks, "band", "part", "id").mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets have the similarity. A hub's set goes to its pairs' tasks, PAIRS_A_TASK pairs each."""
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for ids, texts in portions(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in shingle_sets(texts, size)], pa.binary())], ["node", "shingles"])

    sets = docs.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(make, "node long, shingles binary")
    sets = save(sets, "near-sets")
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_TASK).cast("int").alias("salts"))
    hubs = counts.join(sets, F.col("a") == F.col("node")).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "shingles")
    spokes = pairs.join(counts, "a").join(sets, F.col("b") == F.col("node")).select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in pieces(batches):
            a, b = [], []
            for i, j, data in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                s = np.frombuffer(data, np.uint64)
                if j is None:  # nulls sort first: the hub's own set
                    if now != i:
                        now, own = i, s
                    continue
                common = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * common >= percent * (len(own) + len(s) - common):
                    a.append(i)
                    b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return hubs.unionByName(spokes).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) by alternating large-star and small-star rounds."""
    edges = edges.select("a", "b").where("a < b").distinct()
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        edges = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: each node and its smaller neighbours meet the smallest of them
        low = edges.groupBy("b").agg(F.min("a").alias("m"))
        edges = edges.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct().checkpoint()
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:  # a round without a change: each node points at its smallest
            break
        state = new
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    shared_dir(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = save(signatures(docs, size), "near-signatures")
    classes = save(signed.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("parity").alias("parity")).where("id IS NOT NULL"), "near-classes")
    keys = index_keys(classes)
    hot = [r.key for r in keys.sample(SAMPLE, seed=5).groupBy("key").count().where(F.col("count") > HOT_KEY * SAMPLE).select("key").collect()]  # at most rows / HOT_KEY
    salt = F.when(F.col("key").isin(hot), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int") + 1).otherwise(0) if hot else F.lit(0)
    found = save(hub_pairs(keys.withColumn("salt", salt), percent), "near-buckets")
    pairs = found.where("kind = 0").select("a", "b")
    members = found.where("kind = 2").select("key", "a")
    if hot:
        more = save(hub_pairs(found.where("kind = 1").select("key", F.col("a").alias("id"), "n", "sig", F.lit(0).alias("salt")), percent), "near-hubs")
        pairs = pairs.unionByName(more.where("kind = 0").select("a", "b"))
        members = members.unionByName(found.where("kind = 1").select("key", "a"))
    links = save(confirmed(save(pairs.distinct(), "near-pairs"), docs, size, percent), "near-links")
    labels = save(components(links), "near-labels")
    pairs = save(cross_pairs(members, labels, classes, percent), "near-cross")
    if pairs.limit(1).count():
        links = links.unionByName(save(confirmed(pairs, docs, size, percent), "near-cross-links"))
        labels = save(components(links), "near-labels")
    ids = classes.select("class", "id").join(labels, F.col("id") == F.col("node"), "left").select("class", F.coalesce("component", "id").alias("component_id"))
    out = signed.select("doc_id", "n", "class").join(ids, "class", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows whose doc_id is their component's smallest, with their columns; repeated rows of it all stay."""
    kept = near_duplicates(docs, size, percent).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept.hint("shuffle_hash"), docs["doc_id"].cast("long").eqNullSafe(F.col("_kept")), "left_semi")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=4)
