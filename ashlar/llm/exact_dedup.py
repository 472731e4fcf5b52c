"""Exact dedup with counting quotient filters.

Each text is normalised (A-Z lower-cased) and fingerprinted. Every partition builds counting quotient
filters: the fingerprint's leading bits (the quotient) name a block, in which the remainders stand sorted
with their counts. Filters of all partitions merge block by block by adding up equal remainders, which
loses nothing. Fingerprints counted more than once route their documents to byte verification, where
whole normalised texts are grouped; equal fingerprints alone never drop a document.

Defined cases: null counts as the empty text, and empty texts equal each other; of equal texts the row
with the largest doc_id stays; where that doc_id comes twice with the text, each of its rows counts in the
size and is marked as kept; null is a doc_id like the others, below all of them; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, documents, save

#: Fingerprints in a block of the filters, about; the number of blocks follows from that of the rows.
BLOCK = 1 << 18
#: Parts that rows without a doc_id are dealt to; all of them are compared where one is routed.
NULL_PARTS = 64


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp, sha: 64-bit fingerprint and SHA-256 of the normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode().lower() for t in batch.column("text").to_pylist()]
            fp = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in texts), np.uint64, len(texts)).view(np.int64)
            sha = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp), sha], ["doc_id", "fp", "sha"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long, sha string")


def quotient_bits(rows: int) -> int:
    """Bits of a fingerprint that name its block; the others are its remainder."""
    return max(6, math.ceil(math.log2(max(1, rows / BLOCK))))


def partition_filters(prints: DataFrame, bits: int) -> DataFrame:
    """quotient, remainders, counts: one filter per batch of a partition, split into its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= 1 << 20:
                yield filter_blocks(np.concatenate(held), bits)
                held = []
        if held:
            yield filter_blocks(np.concatenate(held), bits)

    return prints.select("fp").mapInArrow(run, "quotient int, remainders binary, counts binary")


def filter_blocks(fp: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted distinct fingerprints with their counts, as rows of (quotient, remainders, counts)."""
    keys, counts = np.unique(fp, return_counts=True)
    counts, shift = counts.astype(np.uint64), np.uint64(64 - bits)
    quotient, remainder = (keys >> shift).astype(np.int32), keys & ((np.uint64(1) << shift) - np.uint64(1))
    ends = np.flatnonzero(np.diff(quotient, append=-1))
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(int)
    rows = [(quotient[s], remainder[s : e + 1].tobytes(), counts[s : e + 1].tobytes()) for s, e in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["quotient", "remainders", "counts"])


def merged(filters: DataFrame, bits: int) -> DataFrame:
    """fp, n for every fingerprint counted more than once. Blocks of one quotient meet in one partition and merge one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotient, parts = None, []
        for batch in batches:
            for q, r, c in zip(*(batch.column(k).to_pylist() for k in ("quotient", "remainders", "counts")), strict=True):
                if q != quotient:
                    if parts:
                        yield repeated(quotient, parts, bits)
                    quotient, parts = q, []
                parts.append((np.frombuffer(r, np.uint64), np.frombuffer(c, np.uint64)))
                if len(parts) > 64:
                    parts = [merge(parts)]
        if parts:
            yield repeated(quotient, parts, bits)

    return filters.repartition("quotient").sortWithinPartitions("quotient").mapInArrow(run, "fp long, n long")


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([r for r, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate([c for _, c in parts])).astype(np.uint64)


def repeated(quotient: int, parts: list[tuple[np.ndarray, np.ndarray]], bits: int) -> pa.RecordBatch:
    keys, counts = merge(parts)
    fp = (np.uint64(quotient) << np.uint64(64 - bits)) | keys[counts > 1]
    return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(counts[counts > 1].astype(np.int64))], ["fp", "n"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    prints = save(fingerprints(docs), "dedup-prints")
    bits = quotient_bits(prints.count())
    many = save(merged(partition_filters(prints, bits), bits), "dedup-repeated")
    routed = save(prints.join(many.select("fp"), "fp", "left_semi"), "dedup-routed")
    # whole texts of the routed rows only, compared byte by byte as grouping keys
    # rows without an id go by a part's number; a row that is let through without need does no harm
    parts = F.when(F.col("doc_id").isNull(), F.sequence(F.lit(0), F.lit(NULL_PARTS - 1)).cast("array<long>")).otherwise(F.array("doc_id"))
    places = routed.select("doc_id").distinct().select(F.explode(parts).alias("place"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ascii_lower(F.coalesce("text", F.lit(""))).alias("norm")).withColumn("place", F.coalesce("doc_id", F.pmod(F.monotonically_increasing_id(), F.lit(NULL_PARTS))))
    texts = texts.join(places.hint("shuffle_hash"), "place", "left_semi")
    groups = texts.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).select(F.sha2("norm", 256).alias("sha"), "keep_id", "group_size")
    # two texts of one SHA-256 would make two groups of it; then the row's own text can't tell its group
    groups = groups.groupBy("sha").agg(F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"), F.count("*").alias("n")).withColumn("n", F.when(F.col("n") > 1, F.raise_error(F.lit("two texts have one SHA-256"))).otherwise(F.col("n")))
    many_docs = routed.join(groups.where("n = 1"), "sha").select("doc_id", "keep_id", "group_size", F.col("sha").alias("text_sha256"))
    single = prints.join(many.select("fp"), "fp", "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.col("sha").alias("text_sha256"))
    return many_docs.unionByName(single).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
