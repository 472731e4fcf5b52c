"""Ranked search against scoring every document by hand."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from samples import SCHEMA, lower

from ashlar.llm import wavelet_search as ws

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def by_hand(rows, items, k=20):
    docs = [(i, Counter(TERM.findall(lower(t)))) for i, t, *_ in rows if TERM.search(t or "")]
    n, length, df = len(docs), sum(sum(c.values()) for _, c in docs), Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in docs:
            m = 100 - 25 + (25 * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in TERM.findall(lower(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def found(docs, items, **k):
    n, length = ws.corpus_size(docs)
    index = ws.build_index(docs, n, length)
    return Counter(tuple(r) for r in ws.search(index, items, n, **k).select("item_id", "rank", "doc_id", "score").collect())


@pytest.fixture(params=["docs", "clashing"])
def given(request):
    return request.getfixturevalue(request.param)


def test_samples(spark, given, rows):
    items = [(1, rows[3][1]), (2, rows[5][1].upper() + " " + rows[5][1]), (3, None), (4, ""), (5, "nothing-like it"), (1, "one two"), (6, " ".join(r[1][:200] for r in rows[40:] if r[1]))]
    assert found(given, spark.createDataFrame(items, ITEMS)) == by_hand(rows, items)


@pytest.mark.parametrize(("shard", "chunk", "block"), [(200, 256, 512), (5000, 4, 2), (1 << 20, 64, 512)])
def test_many(spark, monkeypatch, shard, chunk, block):
    """Small and large shards, few nodes at a time, several blocks of items; copies make ties at the last rank."""
    monkeypatch.setattr(ws, "CHUNK", chunk)
    monkeypatch.setattr(ws, "SHARD_TERMS", shard)
    monkeypatch.setattr(ws, "ITEM_BLOCK", block)
    rnd = random.Random(shard)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "x²"]
    make = lambda n: rnd.choice(" -_,\n").join(rnd.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    texts = [make(rnd.randint(1, 40)) for _ in range(300)]
    texts += texts[:40] * 3 + [make(4000)]
    rows = [(i if i % 50 else None, t, "en", "a", 0) for i, t in enumerate(rnd.sample(texts, len(texts)))] + [(77, "w1 w2 w2", "en", "a", 0)] * 2
    items = [(i, make(rnd.randint(1, 12))) for i in range(12)]
    df, it = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(items, ITEMS)
    for k in (1, 20):
        got, want = found(df, it, k=k), by_hand(rows, items, k)
        # rows without a doc_id and those of one doc_id are alike
        assert got == want


def test_nothing(spark, no_docs, docs):
    assert found(no_docs, spark.createDataFrame([(1, "one")], ITEMS)) == Counter()
    assert found(docs, spark.createDataFrame([], ITEMS)) == Counter()


def test_the_tree_is_a_tree():
    """Ranges at the leaves are one document each, and first impacts bound what is below."""
    rnd = random.Random(3)
    terms = [[b"t%d" % rnd.randint(0, 9) for _ in range(rnd.randint(1, 30))] for _ in range(77)]
    b = ws.built(list(range(77)), terms, 77, sum(map(len, terms)))
    tree = ws.Tree(b["docs"], [t.decode() for t in b["terms"]], b["counts"].tolist(), b["levels"], b["bits"], b["impacts"])
    for i in range(len(b["terms"])):
        start, end, docs = tree.starts[i : i + 1], tree.starts[i + 1 : i + 2], np.zeros(1, np.int64)
        for level in range(tree.levels):
            s, e = tree.bits.ones(np.int64(level * tree.bits.width), start), tree.bits.ones(np.int64(level * tree.bits.width), end)
            start, end = np.concatenate([start - s, tree.zeros[level] + s]), np.concatenate([end - e, tree.zeros[level] + e])
            docs = np.concatenate([2 * docs, 2 * docs + 1])
            full = start < end
            start, end, docs = start[full], end[full], docs[full]
            first = tree.impacts[level + 1, start]
            assert all(first[j] == tree.impacts[level + 1, start[j] : end[j]].max() for j in range(len(start)))
        assert sorted(docs.tolist()) == [d for d, t in enumerate(terms) if b["terms"][i] in t] and (end - start == 1).all()
