"""Removal of repeated byte strings by difference-cover sampled suffixes.

Documents are dealt into groups of consecutive doc_ids. Positions whose place in the document modulo 31 is
in a difference cover are sampled: any two places have a common shift below 31 at which both are sampled,
so two equal 50-byte strings hold two equal sampled 20-byte blocks. Whole copies of a text with a smaller
doc_id lose everything and take no part in the rest. Then

1. sampled blocks are named by fingerprint, sorted in buckets, and names that come once are discarded;
2. the suffixes that can still have an equal 50-byte prefix (those with a repeated name within reach) are
   named by the fingerprint of that prefix, merged and sorted in buckets, and adjacent equal prefixes of
   different groups compared; equal prefixes within a group are compared in the group;
3. each group marks the bytes under strings that start in a smaller doc_id.

Only equality of 50-byte prefixes matters here, so names needn't be lexicographic ranks and the recursion
ends at the first names that are 50 bytes long. Names and prefixes are 64-bit fingerprints that aren't checked
byte by byte: two different 50-byte strings count as equal with a chance of 2**-64. Sorted arrays move as binary
columns; the number of buckets follows from the bytes of text, and that of groups as well, whose bounds are
quantiles of doc_id weighed by length.

Defined cases: null is the empty text; texts under 50 bytes lose nothing; rows of one doc_id count as one
document, whatever their texts, and don't remove each other's bytes; rows without a doc_id count as one document
behind all others, dealt into as many groups as their bytes ask for; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, save

#: A perfect difference set: every residue modulo 31 is a difference of two members.
COVER_MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
LENGTH, BLOCK = 50, 20
assert {(a - b) % COVER_MODULUS for a in COVER for b in COVER} == set(range(COVER_MODULUS)) and COVER_MODULUS - 1 + BLOCK <= LENGTH
#: Bytes of text in a group, a slab of hashes, and bytes of text whose names and prefixes are one bucket's.
GROUP_BYTES, SLAB, BUCKET_BYTES = 8 << 20, 1 << 20, 4 << 20
LARGEST = (1 << 63) - 1

_MULTIPLIER = 0xB5297A4D3F84D5B5
_SAMPLED = np.isin(np.arange(COVER_MODULUS), COVER)
_hash_tables: list[np.ndarray] = []


def hash_tables() -> list[np.ndarray]:
    """A random value per byte, and powers of the multiplier and its inverse modulo 2**64, for one slab."""
    if not _hash_tables:
        n = SLAB + LENGTH + 1
        powers = lambda m: np.cumprod(np.where(np.arange(n) > 0, np.uint64(m), np.uint64(1)))
        values = np.random.Generator(np.random.PCG64(20_231)).integers(1, 1 << 63, 256, dtype=np.uint64)
        _hash_tables.extend([values, powers(_MULTIPLIER), powers(pow(_MULTIPLIER, -1, 1 << 64))])
    return _hash_tables


def slabs(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(start, prefix hashes) of slabs that overlap by LENGTH."""
    values, powers, _ = hash_tables()
    for s in range(0, len(x), SLAB):
        part = x[s : s + SLAB + LENGTH]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * powers[: len(part)], out=sums[1:])
        yield s, sums


def fingerprint(sums: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """64-bit fingerprints of the strings of a width at places of a slab."""
    h = (sums[at + width] - sums[at]) * hash_tables()[2][at]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Group:
    """Documents side by side: their bytes x, and where they start."""

    def __init__(self, texts: list[bytes]):
        self.x = np.frombuffer(b"".join(texts), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    def owners(self, at: np.ndarray) -> np.ndarray:
        """The document of each of some ascending places."""
        return np.searchsorted(self.starts, at, side="right") - 1

    def slab_places(self, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per place of a slab: its number, its place in its document, and how much of the document follows."""
        at = np.arange(s, min(s + SLAB, len(self.x)))
        first, last = self.owners(at[[0, -1]])
        lengths = np.diff(np.clip(self.starts[first : last + 2], s, at[-1] + 1))
        owner = np.repeat(np.arange(first, last + 1), lengths)
        return at, at - self.starts[owner], self.starts[owner + 1] - at

    def names(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sampled places and their names of 32 bits besides those of the bucket."""
        places, names = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint64)]
        for s, sums in slabs(self.x):
            at, inside, left = self.slab_places(s)
            at = at[_SAMPLED[inside % COVER_MODULUS] & (left >= BLOCK)]
            places.append(at.astype(np.uint32))
            names.append(fingerprint(sums, at - s, BLOCK) >> np.uint64(32 - bits))
        return np.concatenate(places), np.concatenate(names)

    def suffixes(self, repeated: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Places with a repeated name within reach, and their 64-bit prefix names."""
        hits = np.zeros(len(self.x) + COVER_MODULUS, bool)
        at, names = self.names(bits)
        if len(repeated) and len(at):
            i = np.minimum(np.searchsorted(repeated, names), len(repeated) - 1)
            hits[at[repeated[i] == names]] = True
        del at, names
        places, prefixes = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint64)]
        for s, sums in slabs(self.x):
            at, _, left = self.slab_places(s)
            seen = np.concatenate([[0], np.cumsum(hits[s : s + len(at) + COVER_MODULUS - 1], dtype=np.int32)])
            at = at[(seen[COVER_MODULUS:] > seen[: len(at)]) & (left >= LENGTH)]
            places.append(at.astype(np.uint32))
            prefixes.append(fingerprint(sums, at - s, LENGTH))
        return np.concatenate(places), np.concatenate(prefixes)


def packed(values: np.ndarray, width: int) -> bytes:
    """The low bytes of 64-bit values."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def bucket_bits(n: int) -> int:
    """Bits of a name or prefix that tell its bucket, for so many bytes of text."""
    return max(4, math.ceil(math.log2(max(1, n / BUCKET_BYTES))))


def prefix_bytes(bits: int) -> int:
    """Bytes that hold what a bucket leaves open of a prefix's 64 bits."""
    return 7 if bits >= 8 else 8


def group_bounds(docs: DataFrame, group_bytes: int, n: int, rows: int) -> list[int]:
    """Upper doc_ids of all groups but the last; as many as the n bytes of text have group_bytes.

    Quantiles of doc_id, each counted once and once more for every mean length that its text holds: there are at most two
    such counts a row, so a group has at most twice group_bytes and the texts of one doc_id (bar the quantiles' error, a
    twentieth of a group).
    """
    k = math.ceil(n / group_bytes)
    if k < 2:
        return []
    counts = F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / (n / rows)).cast("int")
    weighed = docs.where("doc_id IS NOT NULL").select("doc_id", F.explode(F.sequence(F.lit(0), counts)))
    found = weighed.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 20 * k)).first()[0]
    return sorted(set(found or []))


def group_of(bounds: list[int]):
    """The number of bounds below doc_id, by binary search in an array constant."""
    if not bounds:
        return F.lit(0)
    b = F.array(*[F.lit(x).cast("long") for x in bounds])
    zero = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def step(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.get(b, mid) < F.col("doc_id")
        done = s["lo"] >= s["hi"]
        return F.struct(F.when(~done & right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(~done & ~right, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.array(*[F.lit(0)] * (len(bounds).bit_length() + 1)), zero, step, lambda s: s["lo"])


def copies_of_smaller(docs: DataFrame) -> DataFrame:
    """g, kind 2, bucket 0, data (doc_id and SHA-256 of each, 8 and 32 bytes): texts that a smaller doc_id has whole."""
    whole = docs.select("g", F.coalesce("doc_id", F.lit(LARGEST)).alias("id"), F.unhex(F.sha2("text", 256)).alias("sha")).where("sha IS NOT NULL")
    first = whole.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    copies = whole.join(first, "sha").where("id > first").select("g", "id", "sha").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, list[bytes]] = {}
            for g, i, sha in zip(*(batch.column(c).to_pylist() for c in ("g", "id", "sha")), strict=True):
                held.setdefault(g, []).append(i.to_bytes(8, "little", signed=True) + sha)
            yield answer_rows(2, 0, [(g, b"".join(rows)) for g, rows in held.items()])

    return copies.mapInArrow(run, ANSWER)


def packed_documents(docs: DataFrame) -> DataFrame:
    """g, ids, lengths, texts: documents of a group that stand together, compressed for the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3)
        for batch in batches:
            held: dict[int, list] = {}
            for g, i, t in zip(batch.column("g").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(g, []).append((LARGEST if i is None else i, (t or "").encode()))
            for g, rows in held.items():
                cols = [[g], [np.array([r[0] for r in rows], np.int64).tobytes()], [np.array([len(r[1]) for r in rows], np.int64).tobytes()], [press.compress(b"".join(r[1] for r in rows))]]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["g", "ids", "lengths", "texts"])

    return docs.select("g", "doc_id", "text").mapInArrow(run, "g int, ids binary, lengths binary, texts binary")


def name_rows(group: Group, g: int, bits: int) -> pa.Table:
    """bucket, g, names: the group's sorted sampled names, each at most twice."""
    names = np.sort(group.names(bits)[1])
    third = np.zeros(len(names), bool)
    third[2:] = names[2:] == names[:-2]
    names = names[~third]
    at = np.searchsorted(names, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
    full = np.flatnonzero(np.diff(at))
    return pa.table({"bucket": pa.array(full, pa.int32()), "g": pa.array([g] * len(full), pa.int32()), "data": pa.array([packed(names[at[b] : at[b + 1]], 4) for b in full], pa.binary())})


def by_bucket(batches: Iterator[pa.RecordBatch], answer) -> Iterator[pa.RecordBatch]:
    """Give answer(bucket, [g...], [data...]) all rows of one bucket after another; rows are sorted by bucket."""
    bucket, gs, data = None, [], []
    for batch in batches:
        for b, g, d in zip(batch.column("bucket").to_pylist(), batch.column("g").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if b != bucket and gs:
                yield answer(bucket, gs, data)
                gs, data = [], []
            bucket = b
            gs.append(g)
            data.append(d)
    if gs:
        yield answer(bucket, gs, data)


def answer_rows(kind: int, bucket: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([bucket] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["g", "kind", "bucket", "data"])


ANSWER = "g int, kind int, bucket int, data binary"


def repeated_names(rows: DataFrame) -> DataFrame:
    """Answers of kind 0: per group and bucket, the sorted names that come more than once anywhere."""

    def answer(bucket: int, gs: list[int], data: list[bytes]) -> pa.RecordBatch:
        names = [unpacked(d, 4) for d in data]
        every = np.sort(np.concatenate(names))
        again = np.unique(every[1:][every[1:] == every[:-1]])
        mine: dict[int, list[np.ndarray]] = {}
        for g, n in zip(gs, names, strict=True):
            if len(again):
                i = np.minimum(np.searchsorted(again, n), len(again) - 1)
                mine.setdefault(g, []).append(n[again[i] == n])
        return answer_rows(0, bucket, [(g, packed(np.unique(np.concatenate(n)), 4)) for g, n in sorted(mine.items())])

    return rows.repartition("bucket").sortWithinPartitions("bucket", "g").mapInArrow(lambda it: by_bucket(it, answer), ANSWER)


def earlier_groups(rows: DataFrame, bits: int, last: int) -> DataFrame:
    """Answers of kind 1: per group and bucket, a bit for each of its sorted prefixes: does an earlier group have it?

    Groups from ``last`` on are parts of one document, none of them earlier than another.
    """

    def answer(bucket: int, gs: list[int], data: list[bytes]) -> pa.RecordBatch:
        parts = [unpacked(d, prefix_bytes(bits)) for d in data]
        lengths = [len(p) for p in parts]
        order = np.argsort(np.concatenate(parts), kind="stable")  # parts stand by group, so equal ones do too
        prefix = np.concatenate(parts)[order]
        of = np.repeat(np.minimum(gs, last), lengths)[order]
        new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
        again = np.zeros(len(prefix), bool)
        again[order] = of > of[np.maximum.accumulate(np.where(new, np.arange(len(prefix)), 0))]
        return answer_rows(1, bucket, [(g, np.packbits(b).tobytes()) for g, b in zip(gs, np.split(again, np.cumsum(lengths)[:-1]), strict=True)])

    return rows.repartition("bucket").sortWithinPartitions("bucket", "g").mapInArrow(lambda it: by_bucket(it, answer), ANSWER)


class Opened:
    """A group's documents in doc_id order, without whole copies of smaller ones."""

    def __init__(self, docs: pa.Table, answers: pa.Table, bits: int):
        self.bits = bits
        rows: list[tuple[int, bytes]] = []
        for ids, lengths, texts in zip(*(docs.column(c).to_pylist() for c in ("ids", "lengths", "texts")), strict=True):
            whole, at = zstandard.ZstdDecompressor().decompress(texts), 0
            for i, n in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(lengths, np.int64).tolist(), strict=True):
                rows.append((i, whole[at : at + n]))
                at += n
        rows.sort()
        self.g = docs.column("g")[0].as_py() if docs.num_rows else 0
        self.answers = sorted(zip(answers.column("kind").to_pylist(), answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True), key=lambda r: r[:2])
        copies: dict[int, set[bytes]] = {}
        for k, _, d in self.answers:
            for at in range(0, len(d), 40) if k == 2 else ():
                copies.setdefault(int.from_bytes(d[at : at + 8], "little", signed=True), set()).add(d[at + 8 : at + 40])
        is_copy = [i in copies and hashlib.sha256(t).digest() in copies[i] for i, t in rows]
        self.copies = [r for r, c in zip(rows, is_copy, strict=True) if c]
        rows = [r for r, c in zip(rows, is_copy, strict=True) if not c]
        self.ids, self.texts = [r[0] for r in rows], [r[1] for r in rows]
        self.group = Group(self.texts)

    def find(self) -> Opened:
        """The candidate suffixes, made alike in both later steps."""
        repeated = [unpacked(d, 4) | np.uint64(b << 32) for k, b, d in self.answers if k == 0]
        self.places, prefixes = self.group.suffixes(np.concatenate(repeated) if repeated else np.zeros(0, np.uint64), self.bits)
        self.prefixes, self.first, self.inverse = np.unique(prefixes, return_index=True, return_inverse=True)
        return self

    def prefix_rows(self) -> list[tuple[int, bytes]]:
        """(bucket, sorted prefixes) of the group, each once."""
        at = self.bucket_edges()
        return [(b, packed(self.prefixes[at[b] : at[b + 1]], prefix_bytes(self.bits))) for b in np.flatnonzero(np.diff(at)).tolist()]

    def bucket_edges(self) -> np.ndarray:
        """Where the buckets of the sorted prefixes start."""
        return np.searchsorted((self.prefixes >> np.uint64(64 - self.bits)).astype(np.int64), np.arange((1 << self.bits) + 1))

    def removed(self) -> np.ndarray:
        """Per byte of the group, whether it goes."""
        rank = np.cumsum([0] + [int(a != b) for a, b in zip(self.ids, self.ids[1:], strict=False)])
        at = self.bucket_edges()
        earlier = np.zeros(len(self.prefixes), bool)
        for k, b, d in self.answers:
            if k == 1:
                earlier[at[b] : at[b + 1]] = np.unpackbits(np.frombuffer(d, np.uint8), count=int(at[b + 1] - at[b])).astype(bool)
        covered = np.zeros(len(self.group.x) + 1, np.int32)
        if len(self.places):
            owner = rank[self.group.owners(self.places)]
            go = self.places.astype(np.int64)[earlier[self.inverse] | (owner > owner[self.first][self.inverse])]
            np.add.at(covered, go, 1)
            np.add.at(covered, go + LENGTH, -1)
        return np.cumsum(covered, dtype=np.int32)[:-1] > 0


def find_repeats(docs: DataFrame, group_bytes: int = GROUP_BYTES, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, end of the bytes that go), kept_sha256, kept (with keep_text: the bytes that stay)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.when(F.col("doc_id").isNull(), F.octet_length("text"))).alias("last"), F.count("*").alias("rows")).first()
    n = size.bytes or 0
    bounds, bits = group_bounds(docs, group_bytes, n, size.rows), bucket_bits(n)
    last = len(bounds) + 1  # the rows without a doc_id, from this group on
    part = F.lit(last) + F.pmod(F.xxhash64("text"), F.lit(max(1, math.ceil((size.last or 0) / group_bytes))))
    docs = docs.withColumn("g", F.when(F.col("doc_id").isNull(), part).otherwise(group_of(bounds)).cast("int"))
    copies = save(copies_of_smaller(docs), "whole-copies")
    grouped = packed_documents(docs).groupBy("g")

    def names(docs: pa.Table, answers: pa.Table) -> pa.Table:
        o = Opened(docs, answers, bits)
        return name_rows(o.group, o.g, bits)

    def prefixes(docs: pa.Table, answers: pa.Table) -> pa.Table:
        o = Opened(docs, answers, bits).find()
        rows = o.prefix_rows()
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "g": pa.array([o.g] * len(rows), pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})

    def spans(docs: pa.Table, answers: pa.Table) -> pa.Table:
        o = Opened(docs, answers, bits).find()
        gone, starts = o.removed(), o.group.starts
        rows = {name: [] for name in SPANS.names}

        def add(doc: int, text: bytes, mask: np.ndarray) -> None:
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).reshape(-1, 2)
            kept = np.frombuffer(text, np.uint8)[~mask].tobytes() if len(edges) else text
            values = (None if doc == LARGEST else doc, len(text), int(mask.sum()), [{"start": int(a), "end": int(b)} for a, b in edges], hashlib.sha256(kept).hexdigest(), kept if keep_text else None)
            for name, value in zip(SPANS.names, values, strict=True):
                rows[name].append(value)

        for i, (doc, text) in enumerate(zip(o.ids, o.texts, strict=True)):
            add(doc, text, gone[starts[i] : starts[i + 1]])
        for doc, text in o.copies:
            add(doc, text, np.full(len(text), len(text) >= LENGTH))
        return pa.table(rows, schema=SPANS)

    rows = "bucket int, g int, data binary"
    repeated = save(repeated_names(grouped.cogroup(copies.groupBy("g")).applyInArrow(names, rows)), "repeated-names")
    answers = copies.unionByName(repeated)
    earlier = save(earlier_groups(grouped.cogroup(answers.groupBy("g")).applyInArrow(prefixes, rows), bits, last), "earlier-groups")
    return grouped.cogroup(answers.unionByName(earlier).groupBy("g")).applyInArrow(spans, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary")


SPANS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
