"""A Merkle manifest of a data set, kept as the preimages of its parents (DataFrame functions only).

A row's leaf is the hash of its fields. Per source, leaves stand by doc_id; every FAN consecutive nodes have a parent,
the hash of their digests one after another, until one node is left, the source's subroot. The subroots, by source, make a
tree in the same way, whose last node is the root. What is stored of a parent is its preimage: the digests of its children, DIGEST
characters each, a table per level. A leaf's inclusion proof needs nothing else: of each ancestor's preimage the leaf's
own slot is cut out, which leaves the siblings; to fold a changed leaf, the new digest is put in the slot and the
preimage hashed again.

Ancestors come down the tree, each level joined with the level above by (source, number of the parent), FAN rows a key at most, so that
no source, however many rows it has, is a key of a join or the work of a task. Numbers of leaves come from a range
partitioning and the sizes of its parts.

Defined cases: a null field is hashed as ``-``, so that it differs from an empty one; a text of any length is hashed whole; a null
source is a source, the first in order; a null doc_id stands before the others; rows of one source and doc_id stand in the
order of their leaves (equal rows are alike, and each has a row in the result); a source with one row has its leaf for a subroot, and
a single source its subroot for the root; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, documents, save

#: Children of a node, and characters of a digest.
FAN, DIGEST = 16, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A field as it is hashed: its length in bytes, a colon, and it; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, tampered: Column, changed: Column) -> DataFrame:
    """source, doc_id, leaf, other: the leaf of each row, and that with a changed text where ``tampered`` holds."""
    hashed = lambda text: F.sha2(F.concat(*[field(text if c == "text" else F.col(c)) for c in FIELDS]), 256)
    return docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), hashed(F.col("text")).alias("leaf"), F.when(tampered, hashed(changed)).alias("other"))


def numbered(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """The rows with ``at``, their number in their tree from 0, and ``n``, the tree's rows; saved sorted by tree and order.

    A row's number is its place in its part of a range partitioning, behind the tree's rows in the parts before.
    """
    place = F.monotonically_increasing_id()
    rows = save(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("place", place), name)
    part = F.expr("shiftright(place, 33)")
    parts = rows.groupBy(F.col(tree).alias("of"), part.alias("part")).agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    before = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("of", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("of")).alias("n"))
    found = rows.join(parts, F.col(tree).eqNullSafe(F.col("of")) & (part == F.col("part")))
    return found.select(*[c for c in rows.columns if c != "place"], (F.col("place") + F.col("shift")).alias("at"), "n")


def parents(nodes: DataFrame) -> DataFrame:
    """Of nodes (tree, at, n, node): the next level of the trees that have several, as tree, at, n and preimage."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x["node"]), "")
    up = nodes.where("n > 1").groupBy("tree", F.expr(f"at div {FAN}").alias("up"), "n").agg(joined.alias("preimage"))
    return up.select("tree", F.col("up").alias("at"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), "preimage")


def climbed(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Saved tables of preimages per level, the lowest first, and tree, n and node of what remains of each tree."""
    levels, tops = [], [nodes.where("n = 1").select("tree", F.lit(0).alias("height"), "node")]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(save(parents(nodes), f"{name}-{len(levels) + 1}"))
        nodes = levels[-1].select("tree", "at", "n", F.sha2("preimage", 256).alias("node"))
        tops.append(nodes.where("n = 1").select("tree", F.lit(len(levels)).alias("height"), "node"))
        most = -(-most // FAN)
    return levels, save(reduce(DataFrame.unionByName, tops), f"{name}-tops")


def descended(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """tree, up, path and the columns of tops: per lowest parent (number ``up``) the preimages from it to the top of its tree.

    A tree of one node has a row with an empty path.
    """
    carried = [c for c in tops.columns if c not in ("tree", "height")]
    start = tops.select("tree", "height", F.lit(0).cast("long").alias("up"), F.array().cast("array<string>").alias("path"), *carried)
    above = start.where(F.col("height") == len(levels))
    for height in range(len(levels), 0, -1):
        own = levels[height - 1].select(F.col("tree").alias("own"), "at", "preimage")
        joined = own.join(above, F.col("own").eqNullSafe(F.col("tree")) & (F.expr(f"at div {FAN}") == F.col("up")))
        below = joined.select("tree", "height", F.col("at").alias("up"), F.concat(F.array("preimage"), "path").alias("path"), *carried)
        above = below.unionByName(start.where(F.col("height") == height - 1))
    return above.drop("height")


def slots(path: Column, at: Column) -> Column:
    """(preimage, characters before the own digest) per ancestor, for a node of a given number."""
    slot = lambda i: F.call_function("shiftright", at, i * 4).bitwiseAND(F.lit(FAN - 1))
    return F.transform(path, lambda p, i: F.struct(p.alias("preimage"), (slot(i) * DIGEST).cast("int").alias("skip")))


def siblings(path: Column) -> Column:
    """The digests beside the own one, level by level."""
    cut = lambda x: F.concat(F.substr(x["preimage"], F.lit(1), x["skip"]), F.substr(x["preimage"], x["skip"] + DIGEST + 1))
    return F.array_join(F.transform(path, cut), "")


def folded(node: Column, path: Column) -> Column:
    """What a node makes of the top when it takes its place in each ancestor."""
    step = lambda held, x: F.sha2(F.concat(F.substr(x["preimage"], F.lit(1), x["skip"]), held, F.substr(x["preimage"], x["skip"] + DIGEST + 1)), 256)
    return F.aggregate(path, node, step)


def manifest(docs: DataFrame, tampered: Column | None = None, changed: Column | None = None) -> DataFrame:
    """Per row: source, doc_id, at, leaf, subroot, root, siblings (of all levels), folded_root, verified.

    ``folded_root`` is worked out from the leaf of the changed text where ``tampered`` holds, from the leaf itself elsewhere.
    """
    own = leaves(docs, F.lit(False) if tampered is None else tampered, F.col("text") if changed is None else changed)
    own = numbered(save(own, "leaves"), "source", ["doc_id", "leaf"], "leaves-sorted")
    levels, tops = climbed(own.select(F.col("source").alias("tree"), "at", "n", F.col("leaf").alias("node")), "manifest")
    subroots = numbered(tops.withColumn("all", F.lit(0)), "all", ["tree"], "subroots")
    upper, root = climbed(subroots.select(F.col("all").alias("tree"), "at", "n", "node"), "subroots")
    above = descended(upper, root.select("tree", "height", F.col("node").alias("root"))).select("up", F.col("path").alias("path_above"), "root")
    named = subroots.withColumnRenamed("node", "subroot").join(above, F.expr(f"at div {FAN} = up"))
    named = named.select("tree", "height", "subroot", "root", slots(F.col("path_above"), F.col("at")).alias("over"))
    paths = descended(levels, named)
    found = own.join(paths, F.col("source").eqNullSafe(F.col("tree")) & (F.expr(f"at div {FAN}") == F.col("up")))
    way = F.concat(slots(F.col("path"), F.col("at")), F.col("over"))
    found = found.select("source", "doc_id", "at", "leaf", "subroot", "root", siblings(way).alias("siblings"), folded(F.coalesce("other", "leaf"), way).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 5 == 0, F.lit(False))
    found = manifest(documents(spark, sf_dir), tampered, ascii_lower("text"))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified")


#: The same in SQL: the trees as recursive tables, CRC-32 by its table of 256 remainders.
ORACLE = """
WITH RECURSIVE remainders AS (
  SELECT list(c ORDER BY b) AS held FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM range(256) t(b))
), docs AS (
  SELECT doc_id, source, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: xor(c >> 8, held[xor(c & 255, b) + 1])), 4294967295) % 5 = 0 AS tampered,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
           || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM documents, remainders
), hashed AS (
  SELECT doc_id, source, coalesce(tampered, false) AS tampered, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS other FROM docs
), own AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM hashed
), lower_levels AS (
  SELECT 0 AS height, source, pos, n, leaf AS node FROM own
  UNION ALL
  SELECT height + 1, source, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM lower_levels WHERE n > 1 GROUP BY height, source, pos // 16, n
), tops AS (
  SELECT source, height, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s, count(*) OVER () AS sources FROM lower_levels WHERE n = 1
), upper_levels AS (
  SELECT 0 AS height, s AS pos, sources AS n, node FROM tops
  UNION ALL
  SELECT height + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM upper_levels WHERE n > 1 GROUP BY height, pos // 16, n
), runs AS (
  SELECT height, source, pos // 16 AS up, list(node ORDER BY pos) AS nodes FROM lower_levels WHERE n > 1 GROUP BY height, source, up
), upper_runs AS (
  SELECT height, pos // 16 AS up, list(node ORDER BY pos) AS nodes FROM upper_levels WHERE n > 1 GROUP BY height, up
), steps AS (
  SELECT o.source, o.doc_id, o.pos, r.height AS step, (o.pos >> (4 * r.height)) % 16 AS slot, r.nodes
  FROM own o JOIN runs r ON r.source IS NOT DISTINCT FROM o.source AND r.up = o.pos >> (4 * r.height + 4)
  UNION ALL
  SELECT o.source, o.doc_id, o.pos, t.height + r.height, (t.s >> (4 * r.height)) % 16, r.nodes
  FROM own o JOIN tops t ON t.source IS NOT DISTINCT FROM o.source JOIN upper_runs r ON r.up = t.s >> (4 * r.height + 4)
), fold AS (
  SELECT source, pos, 0 AS step, CASE WHEN tampered THEN other ELSE leaf END AS node FROM own
  UNION ALL
  SELECT f.source, f.pos, f.step + 1, sha256(array_to_string(list_concat(list_concat(s.nodes[1:s.slot], [f.node]), s.nodes[s.slot + 2:]), ''))
  FROM fold f JOIN steps s ON s.source IS NOT DISTINCT FROM f.source AND s.pos = f.pos AND s.step = f.step
), ends AS (
  SELECT source, pos, max_by(node, step) AS folded_root FROM fold GROUP BY source, pos
), proofs AS (
  SELECT source, pos, sha256(string_agg(array_to_string(list_concat(nodes[1:slot], nodes[slot + 2:]), ''), '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY source, pos
), root AS (SELECT node AS root FROM upper_levels WHERE n = 1)
SELECT o.doc_id, o.leaf, t.node AS subroot, root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = root AS verified
FROM own o JOIN tops t ON t.source IS NOT DISTINCT FROM o.source JOIN ends e ON e.source IS NOT DISTINCT FROM o.source AND e.pos = o.pos
     LEFT JOIN proofs p ON p.source IS NOT DISTINCT FROM o.source AND p.pos = o.pos, root
"""
