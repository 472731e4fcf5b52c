"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters and digits. Documents and test items are joined on the hashes and words of
shared LEAST_TILE-word seeds (Karp-Rabin); a Bloom filter of the items' seeds, bounded in size, keeps other places
of the documents out of the join. For each pair with a seed, the longest non-overlapping match of unmarked
words is marked again and again; the share of the item's words under tiles is its coverage, which doesn't
depend on the tiles' order in the document, so reordered passages are caught. Neither the documents nor the
benchmark are held whole anywhere.

Defined cases: null and empty texts, in documents or items, match nothing; items of fewer words than a
tile are matched whole, so that an item of one word covers each text with that word; of matches of equal length
the one that is first in the item, then in the text, is marked first; texts of any length are taken whole;
repeated rows of documents or items give a row each; rows without a doc_id are told apart by their texts where
rows are removed; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pieces, save

LEAST_TILE, LEAST_COVERAGE = 5, 0.5
#: Bits of the filter of seeds per seed, and at least and at most; past the most it lets more through, which the join sorts out.
BITS_A_SEED, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 26
#: Hashes of words that a task keeps at hand.
CACHE_WORDS = 200_000
_WORD = re.compile(r"\w+")
SCHEMA = "doc_id long, item_id long, covered long, item_words long, tiles long, longest long, coverage double"
#: Also the SHA-256 of the text, for rows without a doc_id.
KEYED = f"{SCHEMA}, text_sha256 string"


def tiles(pairs: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from seeds (place in item, place in text) of k words: (item place, text place, words)."""
    runs, by_diagonal = [], defaultdict(list)
    for p, t in pairs:
        by_diagonal[t - p].append(p)
    for d, places in by_diagonal.items():
        places.sort()
        start = end = None
        for p in places:
            if start is not None and p <= end:
                end = max(end, p + k)
                continue
            if start is not None:
                runs.append((start, start + d, end - start))
            start, end = p, p + k
        runs.append((start, start + d, end - start))
    heap, marked_p, marked_t, out = [(-n, p, t) for p, t, n in runs], set(), set(), []
    heapq.heapify(heap)
    while heap:
        n, p, t = heapq.heappop(heap)
        free = [p + i not in marked_p and t + i not in marked_t for i in range(-n)]
        if all(free):
            marked_p.update(range(p, p - n))
            marked_t.update(range(t, t - n))
            out.append((p, t, -n))
            continue
        start = None
        for i, f in enumerate([*free, False]):
            if f and start is None:
                start = i
            elif not f and start is not None:
                if i - start >= k:
                    heapq.heappush(heap, (start - i, p + start, t + start))
                start = None
    return out


class Hashes(dict):
    """64-bit hashes of words, a bounded number of them at hand."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return found


def windows(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of k ids."""
    h = np.full(max(0, len(ids) - k + 1), k, np.uint64)
    for i in range(k if len(h) else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - k + 1 + i]
        h ^= h >> np.uint64(31)
    return h


def words_of(text: str, hashes: Hashes) -> tuple[list[str], np.ndarray]:
    words = _WORD.findall(text.lower())
    return words, np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


SEEDS = "item long, item_id long, item_words int, k int, p int, h long, seed string"


def seeds_of(benchmark: DataFrame, least: int) -> DataFrame:
    """A row per run of ``least`` words of a test item (of all words, if they are fewer), saved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in pieces(batches):
            rows = []
            for item, item_id, text in zip(*(batch.column(c).to_pylist() for c in ("item", "item_id", "text")), strict=True):
                words, ids = words_of(text or "", hashes)
                k = min(least, len(words))
                rows += [(item, item_id, len(words), k, p, h, " ".join(words[p : p + k])) for p, h in enumerate(windows(ids, k).view(np.int64).tolist() if k else [])]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["item", "item_id", "item_words", "k", "p", "h", "seed"])

    return save(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, SEEDS), "seeds")


def seed_filter(seeds: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Words of a Bloom filter with two places per seed, MOST_BITS at most, and the lengths of the seeds."""
    n, lengths = seeds.agg(F.count("*"), F.collect_set("k")).first()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_SEED * n).bit_length()))
    spot = seeds.select(F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 32))).alias("x")).select(F.col("x").bitwiseAND(bits - 1).alias("x"))
    found = spot.groupBy((F.col("x") / 64).cast("long").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(x % 64 as int)))").alias("bits")).toArrow()  # MOST_BITS / 64 rows at most
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("w").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out, sorted(lengths)


def passing(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of hashes that the filter doesn't rule out."""
    mask = np.uint64(len(words) * 64 - 1)
    bit = lambda x: (words[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1)
    at = np.flatnonzero(bit(h & mask))
    return at[bit((h[at] >> np.uint64(32)) & mask).astype(bool)]


def keyed_coverage(docs: DataFrame, benchmark: DataFrame, least: int) -> DataFrame:
    """A row per document and test item that share a seed, with text_sha256."""
    seeds = seeds_of(benchmark, least)
    words, lengths = seed_filter(seeds)
    sent = docs.sparkSession.sparkContext.broadcast(words)  # 8 MB at most

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = Hashes(), sent.value
        for batch in pieces(batches):
            rows = []
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                found, ids = words_of(text or "", hashes)
                key = None if doc is not None or not text else hashlib.sha256(text.encode()).hexdigest()
                for k in lengths:
                    h = windows(ids, k)
                    for t in passing(h, held).tolist():
                        rows.append((row, doc, key, k, t, int(h[t : t + 1].view(np.int64)[0]), " ".join(found[t : t + k])))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["row", "doc_id", "text_sha256", "k", "t", "h", "seed"])

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, pairs = None, None, []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(cols[6], pa.float64()), pa.array(cols[7], pa.string())], names=[x.split()[0] for x in KEYED.split(", ")])

        def closed() -> tuple:
            doc, key, item_id, n, k = first
            got = tiles(pairs, k)
            covered = sum(m for *_, m in got)
            return doc, item_id, covered, n, len(got), max(m for *_, m in got), covered / n, key

        for batch in pieces(batches, 4096):
            rows = []
            for row, item, p, t, *rest in zip(*(batch.column(c).to_pylist() for c in ("row", "item", "p", "t", "doc_id", "text_sha256", "item_id", "item_words", "k")), strict=True):
                if (row, item) != now:
                    if pairs:
                        rows.append(closed())
                    now, first, pairs = (row, item), rest, []
                pairs.append((p, t))
            yield out(rows)
        if pairs:
            yield out([closed()])

    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = given.mapInArrow(hits, "row long, doc_id long, text_sha256 string, k int, t int, h long, seed string")
    both = found.join(seeds, ["k", "h", "seed"]).drop("h", "seed")
    return both.repartition("row", "item").sortWithinPartitions("row", "item", "p", "t").mapInArrow(tiled, KEYED)


def coverage(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_TILE) -> DataFrame:
    """A row per document and test item that share a seed."""
    return keyed_coverage(docs, benchmark, least).drop("text_sha256")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_TILE, threshold: float = LEAST_COVERAGE) -> DataFrame:
    return coverage(docs, benchmark, least).where(F.col("coverage") >= threshold)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_TILE, threshold: float = LEAST_COVERAGE) -> DataFrame:
    """The rows that hold no test item, with their columns."""
    hit = keyed_coverage(docs, benchmark, least).where(F.col("coverage") >= threshold).select(F.col("doc_id").alias("_hit"), F.col("text_sha256").alias("_hit_sha")).distinct()
    doc_id = docs["doc_id"].cast("long")
    sha = F.when(doc_id.isNull(), F.sha2(docs["text"], 256))
    return docs.join(hit, doc_id.eqNullSafe(F.col("_hit")) & sha.eqNullSafe(F.col("_hit_sha")), "left_anti")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
