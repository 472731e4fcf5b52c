"""Exact ranked search with a dual-sorted wavelet tree per shard.

The corpus is cut into shards of about SHARD_TERMS terms, in the tasks that read it; texts don't move. A shard's postings
stand term by term and, within a term, by falling impact (what the term adds to a document's score, before its weight). The
sequence of their documents is a wavelet tree (as a wavelet matrix: a bit vector per level, zeros first): it is sorted by impact, and
walking it down sorts it by document. At a node, which is a range of documents, a term has one range of positions, and its
first position holds the largest impact among the node's documents, since the cuts keep the order. So the sum over an item's terms of
weight and first impact bounds the scores below a node, and at a leaf it is the document's score.

A search goes through the nodes best first, CHUNK nodes at a time, and leaves out those whose bound is under the k-th best
score known for the item in the task, whatever shard that came from; equal bounds are followed, since equal scores go by doc_id. What
the tasks find, k documents an item at most each, is ranked by Spark. Items go to the shards in blocks.

Weights need the documents that hold a term, in all shards: these are counted from the index, for the items' terms only.

Defined cases: null and empty texts have no terms, and aren't counted as documents; items without terms have no result; texts of any length are
taken whole; each row of documents is a document, and each row of items an item, repeated or not; equal scores go by
doc_id, rows without one last (rows of one doc_id and score are alike); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, pieces, save, shared_dir

#: Terms and documents in a shard, about; items that are searched at once; nodes that are opened at once; documents an item.
SHARD_TERMS, SHARD_DOCS, ITEM_BLOCK, CHUNK, TOP = 1 << 20, 1 << 16, 512, 256, 20
#: What is outside of terms becomes a space, A-Z become small; a byte over 127 is part of a term.
_BYTES = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
LAST = (1 << 63) - 1


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_BYTES).split()


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, terms = 0, 0
        for part in pieces(batches):
            sizes = [len(terms_of(t)) for t in part.column("text").to_pylist()]
            n, terms = n + sum(map(bool, sizes)), terms + sum(sizes)
        yield pa.RecordBatch.from_pydict({"n": [n], "terms": [terms]})

    found = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "n long, terms long").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")).first()
    return found.n or 0, found.terms or 0


class Words:
    """Bits by level as 64-bit words, with the ones before each word."""

    def __init__(self, words: np.ndarray, levels: int):
        self.words = words.reshape(levels, -1)
        self.width = self.words.shape[1]
        counts = np.bitwise_count(self.words).astype(np.int32)
        before = np.zeros_like(counts)
        np.cumsum(counts[:, :-1], axis=1, out=before[:, 1:], dtype=np.int32)
        self.flat, self.before = self.words.ravel(), before.ravel()

    def ones(self, base: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ones before places of levels whose words start at base."""
        word = base + (at >> 6)
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.flat[word] & mask)


def packed_bits(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, with a word to spare, so that the end is a place too."""
    out = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
    held = np.packbits(bits, bitorder="little")
    out[: len(held)] = held
    return out.view("<u8")


def built(doc_ids: list, terms: list[list[bytes]], n: int, length: int) -> dict:
    """The tree of some documents: a row of the index."""
    order = sorted(range(len(doc_ids)), key=lambda i: LAST if doc_ids[i] is None else doc_ids[i])
    known: dict[bytes, int] = {}
    number = lambda t: known.setdefault(t, len(known))
    ids = np.fromiter((number(t) for i in order for t in terms[i]), np.int64)
    sizes = np.array([len(terms[i]) for i in order], np.int64)
    d = len(order)
    names = sorted(known)
    place = np.empty(len(names), np.int64)
    place[[known[t] for t in names]] = np.arange(len(names))
    held, tf = np.unique(place[ids] * d + np.repeat(np.arange(d), sizes), return_counts=True)
    term, doc = held // d, held % d
    m = 75 + (25 * sizes * n) // length
    impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
    by_impact = np.lexsort((doc, -impact, term))
    seq, impact = doc[by_impact], impact[by_impact]
    levels, rows, at = max(1, (d - 1).bit_length()), [], seq
    for level in range(levels):
        bit = (at >> (levels - 1 - level)) & 1
        rows.append(packed_bits(bit.astype(np.uint8)))
        at = np.concatenate([at[bit == 0], at[bit == 1]])
    starts = np.searchsorted(term, np.arange(len(names) + 1))
    return {
        "docs": np.array([LAST if doc_ids[i] is None else doc_ids[i] for i in order], "<i8").tobytes(), "terms": names, "counts": np.diff(starts).astype(np.int32),
        "levels": levels, "bits": np.concatenate(rows).tobytes(), "impacts": impact.astype("<i4").tobytes(),
    }


INDEX = "docs binary, terms array<string>, counts array<int>, levels int, bits binary, impacts binary"


def build_index(docs: DataFrame, n: int, length: int) -> DataFrame:
    """The saved index of documents(doc_id, text), a row per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, terms, held = [], [], 0

        def row() -> pa.RecordBatch:
            b = built(doc_ids, terms, n, length)
            names = pa.array([b["terms"]], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array([b["docs"]], pa.binary()), names, pa.array([b["counts"]], pa.list_(pa.int32())), pa.array([b["levels"]], pa.int32()), pa.array([b["bits"]], pa.binary()), pa.array([b["impacts"]], pa.binary())], ["docs", "terms", "counts", "levels", "bits", "impacts"])

        for part in pieces(batches):
            for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                found = terms_of(text)
                if found:
                    doc_ids.append(i)
                    terms.append(found)
                    held += len(found)
                if held >= SHARD_TERMS or len(doc_ids) >= SHARD_DOCS:
                    yield row()
                    doc_ids, terms, held = [], [], 0
        if doc_ids:
            yield row()

    return save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, INDEX), "wavelet-index")


class Tree:
    """A shard, opened: the impacts at every level beside the bits."""

    def __init__(self, docs: bytes, terms: list[str], counts: list[int], levels: int, bits: bytes, impacts: bytes):
        self.docs, self.levels = np.frombuffer(docs, "<i8"), levels
        self.bits = Words(np.frombuffer(bits, "<u8"), levels)
        first = np.frombuffer(impacts, "<i4")
        n = len(first)
        self.n, self.zeros = n, np.zeros(levels, np.int64)
        self.impacts = np.zeros((levels + 1, n + 1), np.int32)  # a place to spare: where an empty range may stand
        self.impacts[0, :n] = first
        for level in range(levels):
            bit = np.unpackbits(self.bits.words[level].view(np.uint8), bitorder="little", count=n).astype(bool)
            self.zeros[level] = n - int(bit.sum())
            self.impacts[level + 1, :n] = np.concatenate([self.impacts[level, :n][~bit], self.impacts[level, :n][bit]])
        self.flat = self.impacts.ravel()
        self.starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.number = {t: i for i, t in enumerate(terms)}

    def search(self, terms: list[str], weights: np.ndarray, best: Best) -> None:
        """Give an item's best documents of this shard to best."""
        at = [(self.number[t], w) for t, w in zip(terms, weights.tolist(), strict=True) if t in self.number]
        if not at:
            return
        which, weight = np.array([i for i, _ in at]), np.array([w for _, w in at], np.int64)
        start, end = self.starts[which][None], self.starts[which + 1][None]
        bound = (weight * self.flat[start]).sum(1)
        heap, made = [(-int(bound[0]), 0, 0, np.zeros(1, np.int64), bound, start, end)], 1
        while heap and -heap[0][0] >= best.least:
            _, _, level, node, bound, start, end = heapq.heappop(heap)
            keep = bound >= best.least
            if not keep.all():
                node, start, end = node[keep], start[keep], end[keep]
            base = level * self.bits.width
            s, e = self.bits.ones(base, start), self.bits.ones(base, end)
            node = np.concatenate([2 * node, 2 * node + 1])
            start, end = np.concatenate([start - s, self.zeros[level] + s]), np.concatenate([end - e, self.zeros[level] + e])
            level += 1
            bound = np.where(start < end, self.flat[level * (self.n + 1) + start], 0) @ weight
            keep = np.flatnonzero(bound >= best.least)
            if level == self.levels:
                if len(keep):
                    best.add(bound[keep], self.docs[node[keep]])
                continue
            keep = keep[np.argsort(-bound[keep], kind="stable")]
            for i in range(0, len(keep), CHUNK):
                k = keep[i : i + CHUNK]
                heapq.heappush(heap, (-int(bound[k[0]]), made, level, node[k], bound[k], start[k], end[k]))
                made += 1


class Best:
    """The best k documents so far, by score and then doc_id; least: the score from which on a document may come in."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.docs = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        scores, docs = np.concatenate([self.scores, scores]), np.concatenate([self.docs, docs])
        order = np.lexsort((docs, -scores))[: self.k]
        self.scores, self.docs = scores[order], docs[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def weighed(index: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """Saved: q, item_id, term, weight of rows of items(item_id, text); weight counts the term as often as it comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            found = [terms_of(t) for t in part.column("text").to_pylist()]
            of = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("q").take(of), pa.array([t for f in found for t in f], pa.binary()).cast(pa.string())], ["q", "term"])

    terms = save(items.select("q", F.col("text").cast("binary").alias("text")).mapInArrow(run, "q long, term string").groupBy("q", "term").agg(F.count("*").alias("times")), "item-terms")
    held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("count"))
    df = held.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("count").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    return save(terms.join(df, "term").select("q", "term", (weight * F.col("times")).alias("weight")), "item-weights")


def search(index: DataFrame, items: DataFrame, n: int, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each row of items(item_id, text), in an index of n documents."""
    items = save(items.select("item_id", "text").withColumn("q", F.monotonically_increasing_id()), "items")
    weights = weighed(index, items, n)
    blocks = max(1, math.ceil(items.count() / ITEM_BLOCK))
    found = [index.mapInArrow(searcher(weights.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b), k), "q long, doc_id long, score long") for b in range(blocks)]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
    ranked = every.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(items.select("q", "item_id"), "q").select("item_id", "rank", F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "score")


def searcher(weights: DataFrame, k: int):
    """A task's function that searches its shards for a block of items, ITEM_BLOCK or so."""
    held: dict[int, tuple[list[str], list[int]]] = {}
    for r in weights.where("weight > 0").sort("q", "term").toLocalIterator():
        terms, numbers = held.setdefault(r.q, ([], []))
        terms.append(r.term)
        numbers.append(r.weight)
    block = [(q, terms, np.array(w, np.int64)) for q, (terms, w) in sorted(held.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in block]
        for batch in batches:
            for i in range(batch.num_rows):
                tree = Tree(*(batch.column(c)[i].as_py() for c in ("docs", "terms", "counts", "levels", "bits", "impacts")))
                for (_, terms, w), b in zip(block, best, strict=True):
                    tree.search(terms, w, b)
        pa.default_memory_pool().release_unused()
        for (q, _, _), b in zip(block, best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(b.docs), pa.int64()), pa.array(b.docs), pa.array(b.scores)], ["q", "doc_id", "score"])

    return run


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    docs, items = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    n, length = corpus_size(docs)
    return search(build_index(docs, n, length), items, n)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), sizes AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id
), size AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes
), postings AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term
), weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM postings, size GROUP BY term
), i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), item_terms AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY item_id, term
), scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM item_terms JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), size GROUP BY item_id, doc_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
