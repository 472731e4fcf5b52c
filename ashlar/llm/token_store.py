"""Token ids in a content-addressed store.

Each document's ids are cut into chunks where a rolling hash of the last WINDOW ids has a given pattern, so
equal passages give equal chunks wherever they stand. The store has three Parquet tables:

* ``chunks``: hash (SHA-256 of the bytes), payload (little-endian ids of ``width`` bytes), each chunk once;
* ``recipes``: per document, in ascending doc_id order, its chunk hashes and lengths, its Merkle root, the
  number of ids before it, and the file range it belongs to;
* ``manifest``: per range of recipes, the Merkle root of its documents' roots.

Defined cases: a null text is empty; an empty text is stored as the end id alone; a text of any length is taken
whole; repeated rows are stored each, in doc_id order; a null doc_id sorts first; an empty table makes empty
tables; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, pieces, table_path

WINDOW, LEAST, CUT_BITS, MOST = 16, 64, 9, 4096
END_ID = 2
#: Ids of words seen before, per Python worker: a young and an old generation of so many each (about 160 MB together).
CACHE_ENTRIES = 400_000

#: White space other than the space and the newline, as str.isspace tells it.
OTHER_SPACE = re.compile(r"[^\S \n]")

_tokenizers: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str, width: int):
    """A function from text to its ids' bytes, by the tokenizers library.

    Vocabularies that aren't byte-level or normalise their input, and texts that hold the content of an added
    token, are given to the library whole. In a byte-level vocabulary a space that follows a word begins the next one, and so does a lone newline;
    a text without two spaces or newlines in a row is the concatenation of the pieces that these begin, and
    equal pieces are encoded once.
    """
    if (path, width) in _tokenizers:
        return _tokenizers[path, width]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel parts
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if tokenizer.get_vocab_size() > 1 << 8 * width:
        raise ValueError(f"ids of this vocabulary don't fit in {width} bytes")
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    pieces: dict[str, bytes] = {}
    older: dict[str, bytes] = {}
    kind = f"<u{width}"

    def whole(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, kind).tobytes()

    if tokenizer.normalizer is not None or type(tokenizer.pre_tokenizer).__name__ != "ByteLevel" or type(tokenizer.model).__name__ != "BPE":
        _tokenizers[path, width] = whole
        return whole

    sizes = np.zeros(tokenizer.get_vocab_size(), np.int64)  # of tokens in bytes: a character of a byte-level token stands for a byte
    for token, i in tokenizer.get_vocab().items():
        if i < len(sizes):
            sizes[i] = len(token)

    def learned(first: str, new: list[str]) -> list[bytes]:
        """Ids of a text's first word and of pieces that were never seen, by one call of the library: behind the word, one after another, as they stand in texts."""
        texts = [first, *[p if p[0] == "\n" else " " + p for p in new]]
        text = "".join(texts)
        found = tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ends = np.cumsum([*map(len, texts if text.isascii() else map(str.encode, texts))])
        reached = np.cumsum(sizes[found])
        edges = np.searchsorted(reached, ends)
        if not len(found) or reached[-1] != ends[-1] or (reached[edges] != ends).any():  # not a token per byte
            return [whole("a" + t)[len(whole("a")) :] if k else whole(t) for k, t in enumerate(texts)]
        ids, edges = np.array(found, kind).tobytes(), ((edges + 1) * width).tolist()
        return [ids[a:b] for a, b in zip([0, *edges], edges, strict=False)]

    def encode(text: str) -> bytes:
        nonlocal pieces, older
        first, *parts = text.replace("\n", " \n").split(" ")
        if not first or "" in parts or "\n" in parts or first[-1].isspace() or any(a in text for a in added):
            return whole(text)
        if len(pieces) >= CACHE_ENTRIES:
            pieces, older = {}, pieces
        missing = set(parts).difference(pieces)
        if not missing:
            return whole(first) + b"".join(map(pieces.__getitem__, parts))
        again = [p for p in missing if p in older]
        new = list(missing.difference(again))
        if OTHER_SPACE.search("".join(new)) and any(p[-1].isspace() or p[p[0] == "\n"].isspace() for p in new):
            return whole(text)  # white space of another kind at either end of a piece, and so beside a space or newline
        pieces.update(zip(again, map(older.__getitem__, again), strict=True))
        begin, *ids = learned(first, new) if new else [whole(first)]
        pieces.update(zip(new, ids, strict=True))
        out = begin + b"".join(map(pieces.__getitem__, parts))
        for p in new:
            if len(p) > 64:
                del pieces[p]
        return out

    _tokenizers[path, width] = encode
    return encode


def cuts(ids: np.ndarray, starts: np.ndarray) -> list[list[int]]:
    """Per document of a concatenation, the ends of its chunks."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    h = np.zeros(len(x), np.uint64)
    for k in range(WINDOW):  # the hash of the WINDOW ids that end here
        h[k:] += x[: len(x) - k] * np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64))
    found = np.flatnonzero((h >> np.uint64(64 - CUT_BITS)) == 0) + 1
    out, at = [], np.searchsorted(found, starts)
    for i in range(len(starts) - 1):
        start, end, ends = starts[i], starts[i + 1], []
        for c in found[at[i] : at[i + 1]].tolist():
            if c - start < LEAST or c >= end:
                continue
            while c - start > MOST:
                start += MOST
                ends.append(start)
            if c - start >= LEAST:
                ends.append(c)
                start = c
        while end - start > MOST:
            start += MOST
            ends.append(start)
        if end > start:
            ends.append(int(end))
        out.append(ends)
    return out


def merkle_root(hashes: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd node moves up as it is."""
    level = [hashlib.sha256(b"\0" + h).digest() for h in hashes] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


ROWS = "kind string, key binary, row long, doc_id long, n long, hashes array<binary>, lengths array<int>, root binary, payload binary"


def chunked(docs: DataFrame, tokenizer: str, width: int, end_id: int) -> DataFrame:
    """Rows of two kinds: a recipe per document, and each chunk once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, sent = encoder(tokenizer, width), np.array([end_id], f"<u{width}").tobytes(), set()
        for part in pieces(batches):
            coded = [encode(t or "") + end for t in part.column("text").to_pylist()]
            ids = np.frombuffer(b"".join(coded), f"<u{width}")
            starts = np.concatenate([[0], np.cumsum([len(c) // width for c in coded])])
            rows = []
            for row, doc, start, ends in zip(part.column("row").to_pylist(), part.column("doc_id").to_pylist(), starts.tolist(), cuts(ids, starts), strict=False):
                hashes, lengths, first = [], [], start
                for e in ends:
                    payload = ids[start:e].tobytes()
                    h = hashlib.sha256(payload).digest()
                    hashes.append(h)
                    lengths.append(e - start)
                    start = e
                    if h not in sent:
                        if len(sent) >= 1 << 18:
                            sent.clear()
                        sent.add(h)
                        rows.append({"kind": "chunks", "key": h, "payload": payload})
                key = hashlib.sha256(row.to_bytes(8, "big")).digest()
                rows.append({"kind": "recipes", "key": key, "row": row, "doc_id": doc, "n": ends[-1] - first, "hashes": hashes, "lengths": lengths, "root": merkle_root(hashes)})
            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)

    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInArrow(run, ROWS)


SCHEMA = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("hashes", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("root", pa.binary()), ("payload", pa.binary())])


def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows, the first of each key."""
    last = None
    for batch in batches:
        keys = batch.column("key").to_pylist()
        keep = [k != p for k, p in zip(keys, [last, *keys], strict=False)]
        last = keys[-1] if keys else last
        yield batch.filter(pa.array(keep, pa.bool_()))


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, width: int = 2, end_id: int = END_ID) -> None:
    """Encode documents(doc_id, text) and write the store's tables under a path."""
    rows = chunked(docs, tokenizer or default_tokenizer(), width, end_id)
    unique = rows.repartition("key").sortWithinPartitions("key").mapInArrow(first_of_each, ROWS)
    unique.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/parts")
    spark = docs.sparkSession
    parts = spark.read.schema(ROWS).parquet(f"{path}/parts")
    ordered = parts.where("kind = 'recipes'").select("doc_id", "row", "n", "hashes", "lengths", "root").repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    ordered.withColumn("range", F.spark_partition_id()).write.parquet(f"{path}/recipes")
    sums = spark.read.parquet(f"{path}/recipes").groupBy("range").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))
    sums = sums.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums.join(roots_of_ranges(spark.read.parquet(f"{path}/recipes")), "range").write.parquet(f"{path}/manifest")


def roots_of_ranges(recipes: DataFrame) -> DataFrame:
    """range, root: the Merkle root of the roots of a range's documents, in order."""
    return recipes.select("range", "doc_id", "row", "root").repartition("range").sortWithinPartitions("range", "doc_id", "row").mapInArrow(range_roots, "range int, root binary")


def range_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merkle root of the documents' roots per range; a range is one file's worth of documents."""
    last, held = None, []
    out = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([merkle_root(held)], pa.binary())], ["range", "root"])
    for batch in batches:
        for r, root in zip(batch.column("range").to_pylist(), batch.column("root").to_pylist(), strict=True):
            if r != last and held:
                yield out()
                held = []
            last = r
            held.append(root)
    if held:
        yield out()


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, row, start, n, hashes, lengths, root, sound; start counts the ids of all documents before.

    sound: the roots of the range's documents have the Merkle root that the manifest holds for it, in a range
    of as many documents and ids as it says.
    """
    r = spark.read.parquet(f"{path}/recipes")
    held = spark.read.parquet(f"{path}/manifest")
    found = r.groupBy("range").agg(F.sum("n").alias("n_found"), F.count("*").alias("documents_found")).join(roots_of_ranges(r).withColumnRenamed("root", "root_found"), "range")
    sound = (F.col("root") == F.col("root_found")) & (F.col("n") == F.col("n_found")) & (F.col("documents") == F.col("documents_found"))
    m = held.join(found, "range").select("range", F.col("start").alias("base"), sound.alias("sound"))
    inside = Window.partitionBy("range").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    return r.join(m, "range").withColumn("start", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("base", "range")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind string, key binary, payload binary").parquet(f"{path}/parts").where("kind = 'chunks'").select(F.col("key").alias("hash"), "payload")


def places(spark: SparkSession, path: str) -> DataFrame:
    """A row per place of a chunk in a document: doc_id, row, start, n, seq, hash, length, after (ids of the document
    behind it), sound (the recipe has its Merkle root and length, and the manifest holds it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes, n = batch.column("hashes").to_pylist(), batch.column("n").to_pylist()
            counts = np.array([len(h) for h in hashes], np.int64)
            first = np.concatenate([[0], np.cumsum(counts)])
            lengths = np.array([x for each in batch.column("lengths").to_pylist() for x in each], np.int64)
            behind = np.concatenate([np.cumsum(lengths[::-1])[::-1], [0]])  # ids from a chunk on, of all documents of the cut
            after = behind[1:] - np.repeat(behind[first[1:]], counts)
            whole = behind[first[:-1]] - behind[first[1:]]
            sound = [s and merkle_root(h) == root and w == m for s, h, root, w, m in zip(batch.column("sound").to_pylist(), hashes, batch.column("root").to_pylist(), whole.tolist(), n, strict=True)]
            of = pa.array(np.repeat(np.arange(len(counts)), counts))
            columns = [*(batch.column(k).take(of) for k in ("doc_id", "row", "start", "n")), pa.array(np.arange(len(of)) - np.repeat(first[:-1], counts), pa.int32()), pa.array([h for each in hashes for h in each], pa.binary()), pa.array(lengths, pa.int32()), pa.array(after), pa.array(sound, pa.bool_()).take(of)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "start", "n", "seq", "hash", "length", "after", "sound"])

    return recipes(spark, path).select("doc_id", "row", "start", "n", "hashes", "lengths", "root", "sound").mapInArrow(run, "doc_id long, row long, start long, n long, seq int, hash binary, length int, after long, sound boolean")


def read_store(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, ids: every document put together again from its chunks; a chunk that isn't there is an error."""
    kind = f"<u{width}"

    @F.pandas_udf("array<int>")
    def ids(parts):
        return parts.map(lambda x: np.frombuffer(b"".join(x), kind).astype(np.int32))

    payload = F.coalesce("payload", F.raise_error(F.concat(F.lit("the store lacks the chunk "), F.hex("hash"))).cast("binary")).alias("payload")
    got = places(spark, path).join(chunks(spark, path), "hash", "left").groupBy("doc_id", "row", "start").agg(F.array_sort(F.collect_list(F.struct("seq", payload))).alias("parts"))
    return got.select("doc_id", "start", ids(F.transform("parts", lambda x: x["payload"])).alias("ids"))


def shift_tables(bits: int = 40) -> np.ndarray:
    """CRC-32 after 2**k zero bytes, as look-up tables [k][byte of the CRC][its value]."""
    column = np.array([0xEDB88320] + [1 << i for i in range(31)], np.uint64)  # one zero bit
    apply = lambda m, v: np.bitwise_xor.reduce(np.where((v[..., None] >> np.arange(32, dtype=np.uint64)) & np.uint64(1), m, np.uint64(0)), axis=-1)
    for _ in range(3):
        column = apply(column, column)
    out = np.zeros((bits, 4, 256), np.uint32)
    for k in range(bits):
        for b in range(4):
            out[k, b] = apply(column, np.arange(256, dtype=np.uint64) << np.uint64(8 * b))
        column = apply(column, column)
    return out


def shifted(crc: np.ndarray, zeros: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """CRCs carried over so many following bytes."""
    crc, zeros = crc.astype(np.uint32), zeros.copy()
    for k in range(len(tables)):
        if not zeros.any():
            break
        now = (zeros & 1).astype(bool)
        c, t = crc[now], tables[k]
        crc[now] = t[0][c & 255] ^ t[1][(c >> 8) & 255] ^ t[2][(c >> 16) & 255] ^ t[3][c >> 24]
        zeros >>= 1
    return crc


def digests(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, chunks, verified, read back from the store's files.

    A document's CRC-32 is put together from its chunks' CRCs, so that chunks are read once each and
    their payloads don't move. verified: every chunk is what its name says, the chunks'
    names have the recipe's Merkle root, and its range's recipes have that of the manifest. A document keeps its
    row and its length by the recipe where chunks are lost, and isn't verified.
    """

    def of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            names, payloads = batch.column("hash").to_pylist(), batch.column("payload").to_pylist()
            crc = [zlib.crc32(np.frombuffer(p, f"<u{width}").astype("<u4").tobytes()) for p in payloads]
            ok = [hashlib.sha256(p).digest() == h for h, p in zip(names, payloads, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(crc, pa.int64()), pa.array([len(p) // width for p in payloads], pa.int32()), pa.array(ok, pa.bool_())], ["hash", "crc", "held", "ok"])

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shift_tables()
        for batch in batches:
            crc = shifted(batch.column("crc").to_numpy(zero_copy_only=False), batch.column("after").to_numpy(zero_copy_only=False) * 4, tables)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "row", "start", "length", "ok")), pa.array(crc.astype(np.int64))], ["doc_id", "row", "start", "length", "ok", "crc"])

    held = chunks(spark, path).mapInArrow(of_chunks, "hash binary, crc long, held int, ok boolean")
    ok = F.coalesce(F.col("sound") & F.col("ok") & (F.col("held") == F.col("length")), F.lit(False)).alias("ok")
    got = places(spark, path).join(held, "hash", "left").select("doc_id", "row", "start", "length", "after", F.coalesce("crc", F.lit(0)).cast("long").alias("crc"), ok)
    got = got.mapInArrow(carried, "doc_id long, row long, start long, length int, ok boolean, crc long")
    return got.groupBy("doc_id", "row", "start").agg(F.sum("length").alias("n_tokens"), F.expr("bit_xor(crc)").alias("ids_crc32"), F.count("*").alias("n_chunks"), F.every("ok").alias("verified")).drop("row")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "token-store")
    write_store(documents(spark, sf_dir), path)
    return digests(spark, path)
