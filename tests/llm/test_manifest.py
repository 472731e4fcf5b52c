"""The Merkle manifest against trees built by hand."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F
from samples import SCHEMA, lower

from ashlar.llm import merkle_manifest
from ashlar.llm.common import ascii_lower


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def tree(nodes):
    """The top, and the way of each node: per ancestor the digests before and behind its slot."""
    ways, under, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], nodes
    while len(level) > 1:
        up, groups = [], []
        for k in range(0, len(level), 16):
            run = level[k : k + 16]
            for j in range(len(run)):
                for i in under[k + j]:
                    ways[i].append((run[:j], run[j + 1 :]))
            up.append(sha(*run))
            groups.append([i for j in range(len(run)) for i in under[k + j]])
        level, under = up, groups
    return (level[0] if level else None), ways


def by_hand(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    held = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for s in sources}
    lower_trees = {s: tree([leaf(*r) for r in held[s]]) for s in sources}
    root, upper = tree([lower_trees[s][0] for s in sources])
    out = []
    for s, above in zip(sources, upper, strict=True):
        subroot, ways = lower_trees[s]
        for r, way in zip(held[s], ways, strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf(r[0], r[1] if r[1] is None or not tampered else lower(r[1]), *r[2:])
            for before, behind in [*way, *above]:
                node = sha(*before, node, *behind)
            out.append((r[0], leaf(*r), subroot, root, sha(*[x for before, behind in [*way, *above] for x in before + behind]), node, node == root))
    return out


def found(docs):
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    m = merkle_manifest.manifest(docs, tampered, ascii_lower("text")).withColumn("proof", F.sha2("siblings", 256))
    return [tuple(r) for r in m.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()]


key = lambda r: (str(r[0]), r[1:])


def test_samples(given_docs, rows):
    assert sorted(found(given_docs), key=key) == sorted(by_hand(rows), key=key)


@pytest.fixture(params=["docs", "clashing"])
def given_docs(request):
    return request.getfixturevalue(request.param)


@pytest.mark.parametrize("sizes", [(1,), (17,), (16, 1), (300, 2, 1, 256, 257), (1,) * 40], ids=str)
def test_shapes(spark, sizes):
    """Lone leaves, lone sources, full and broken runs, and more sources than a node has children."""
    rows = [(1000 * s + i, f"Text {i}" if i % 7 else None, "en", None if s == 2 else f"s{s:02}", i) for s, n in enumerate(sizes) for i in range(n)]
    assert sorted(found(spark.createDataFrame(rows, SCHEMA).repartition(5)), key=key) == sorted(by_hand(rows), key=key)


def test_repeated_rows_and_nulls(spark):
    rows = [(5, "A b", None, "x", 3), (5, "A b", None, "x", 3), (5, "Other", "en", "x", None), (None, "", "en", "x", 0), (None, None, None, None, None), (7, "é" * 5000, "fr", "", 5000)]
    assert sorted(found(spark.createDataFrame(rows, SCHEMA)), key=key) == sorted(by_hand(rows), key=key)


def test_nothing(no_docs):
    assert found(no_docs) == []
