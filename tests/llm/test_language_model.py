"""The recurrent language model: counts by hand, the network token by token, its gradients, what it learns."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import SCHEMA, WORD, lower

from ashlar.llm import recurrent_lm as lm

def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))


def found(docs):
    return sorted((r.asDict() for r in lm.language_model_scores(docs, held_out()).collect()), key=lambda r: (str(r["doc_id"]), r["n_tokens"], r["score"]))


def by_hand(rows):
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows]
    tokens = [[*WORD.findall(lower(r[1])), None] for r in rows]
    c = Counter(t for w, h in zip(tokens, held, strict=True) if not h for t in w)
    n, v = sum(c.values()), len(c)
    return sorted(((str(r[0]), len(w), h, sum(t in c for t in w), n, round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w), 6)) for r, w, h in zip(rows, tokens, held, strict=True)), key=str)


@pytest.fixture(params=["docs", "clashing"])
def given(request):
    return request.getfixturevalue(request.param)


@pytest.mark.parametrize(("common", "head"), [(1 << 16, 2048), (40, 7), (3, 7)])
def test_counts_and_base(given, rows, monkeypatch, common, head):
    """With most words in the dictionary of the tasks, and with most of them joined."""
    monkeypatch.setattr(lm, "COMMON", common)
    monkeypatch.setattr(lm, "HEAD", head)
    got = found(given)
    assert sorted(((str(r["doc_id"]), r["n_tokens"], r["held_out"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == by_hand(rows)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def vocabulary(texts, head=None):
    c = Counter(w for t in texts for w in t)
    common = [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))]
    n, v = np.zeros(lm.CLASSES, np.int64), np.zeros(lm.CLASSES, np.int64)
    for w in common[lm.HEAD :]:
        n[lm.class_of(w)] += c[w]
        v[lm.class_of(w)] += 1
    return lm.Vocabulary(common, np.array([c[w] for w in common]), len(texts), sum(c.values()) + len(texts), len(c) + 1, n, v), c


def corpus(n=60, seed=4):
    rnd = random.Random(seed)
    words = [b"%s%s" % (a, b) for a in (b"ka", b"mo", b"ti", b"re") for b in (b"ling", b"st", b"on", b"e", b"us", b"a")]
    return [[rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 40, 90]))] for _ in range(n)]


def symbols_of(vocab, text):
    number = {w: i for i, w in enumerate(vocab.common[: lm.HEAD])}
    return np.array([vocab.symbols[number[w]] if w in number else vocab.rest[lm.class_of(w)] for w in text] + [vocab.end], np.uint16)


@pytest.fixture
def net(monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 12)
    vocab, _ = vocabulary(corpus())
    net = lm.Network(vocab)
    docs = [symbols_of(vocab, t) for t in corpus()]
    lm.learn_from(net, docs, 8)
    return net, vocab, docs


def plain(net, doc):
    """A document's log10 probability, one token after another in double precision."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    sig, w = lambda x: 1 / (1 + np.exp(-x)), lm.WIDTH
    h, given, total = np.zeros(w), net.end, 0.0
    for target in doc.astype(int):
        x, u = p["embed"][given] @ p["wx"] + p["b"], h @ p["wh"]
        r, z = sig(x[:w] + u[:w]), sig(x[w : 2 * w] + u[w : 2 * w])
        new = np.tanh(x[2 * w :] + r * u[2 * w :])
        h = (1 - z) * new + z * h
        k = net.symbol_class[target]
        a = h @ p["wc"] + p["bc"]
        total += a[k] - np.log(np.exp(a).sum())
        lo, hi = net.first[k], net.first[k + 1]
        a = p["wo"][lo:hi] @ h + p["bo"][lo:hi]
        total += a[target - lo] - np.log(np.exp(a).sum())
        given = target
    return total / math.log(10)


@pytest.mark.parametrize(("lanes", "window", "full"), [(1, 16, 1), (7, 5, 1), (512, 16, 2048), (3, 16, 200)])
def test_whole_documents(net, monkeypatch, lanes, window, full):
    """Scores don't depend on lanes and windows: the state is carried through a document and ends with it."""
    for k, v in (("LANES", lanes), ("WINDOW", window), ("FULL", full)):
        monkeypatch.setattr(lm, k, v)
    net, _, docs = net
    assert np.allclose(lm.log_likelihoods(net, docs), [plain(net, d) for d in docs], rtol=1e-4, atol=1e-4)


def test_probabilities_add_up(net):
    net, vocab, _ = net
    h = np.random.default_rng(1).standard_normal((1, lm.WIDTH)).astype(np.float32)
    every = np.arange(len(net.symbol_class))
    assert math.isclose(np.exp(net.output(np.repeat(h, len(every), 0), every)[0]).sum(), 1, rel_tol=1e-4)
    _, c = vocabulary(corpus())
    for k in range(lm.CLASSES):
        rest = [w for w in vocab.common[lm.HEAD :] if lm.class_of(w) == k]
        assert math.isclose(sum((c[w] + 0.1) for w in rest) + 0.1, 10 ** vocab.share()[k])


def test_gradients(net):
    """The way back against differences of the loss, along a random direction per parameter."""
    net, _, docs = net
    given, begins, target = next((g, b, t) for _, i, g, b, t in lm.Lanes(docs, 6).windows(net.end) if i.all())
    h = np.zeros((given.shape[1], lm.WIDTH), np.float32)

    def loss():
        return -net.output(net.forward(given, begins, h)[0].reshape(-1, lm.WIDTH), target.ravel())[0].astype(float).sum()

    states, kept = net.forward(given, begins, h)
    grads = {}
    _, back = net.output(states.reshape(-1, lm.WIDTH), target.ravel(), grads)
    net.backward(given, begins, kept, back.reshape(states.shape), grads)
    rnd = np.random.default_rng(2)
    for k, g in grads.items():
        whole = np.zeros_like(net.p[k])
        if isinstance(g, tuple):
            whole[g[0]] = g[1]
        else:
            whole = g
        way = rnd.standard_normal(whole.shape).astype(np.float32)
        was, step = net.p[k], 3e-3
        net.p[k] = was + step * way
        up = loss()
        net.p[k] = was - step * way
        down = loss()
        net.p[k] = was
        assert math.isclose((up - down) / (2 * step), float((whole * way).sum()), rel_tol=0.03, abs_tol=0.3), k


def test_it_learns_the_order_of_words(spark):
    """Words in a fixed order are told better by far than by their counts, also in texts it never saw."""
    rnd = random.Random(8)
    cycle = [f"w{i}x" for i in range(12)]
    rows = []
    for i in range(600):
        at = rnd.randrange(12)
        rows.append((i, " ".join(cycle[(at + j) % 12] for j in range(rnd.randint(20, 60))), "en", "a", 0))
    got = [r for r in found(spark.createDataFrame(rows, SCHEMA).repartition(3)) if r["held_out"]]
    assert len(got) > 30 and sum(r["score"] for r in got) > 0.8 * sum(r["base_score"] for r in got) and all(r["score"] > r["base_score"] for r in got)


@pytest.mark.parametrize("together", [False, True])
def test_windows_pass_every_token_once_in_order(together):
    """Also with one document much longer than the others; when lanes end together, the last window holds them all."""
    rnd = np.random.default_rng(3)
    docs = [np.arange(1, n + 1).astype(np.uint16) for n in [*rnd.integers(1, 60, 50), 900]]
    dealt = lm.Lanes(docs, 9)
    passed = []
    for place, inside, given, begins, target in dealt.windows(0, together):
        assert begins[~inside].all() and ((given == target - 1) | ~inside).all() and (target[inside & begins] == 1).all()
        passed.append(place[inside])
        last = inside
    assert sorted(np.concatenate(passed).tolist()) == list(range(len(dealt.flat)))
    assert not together or (last.shape[1] == 9 and last[-1].all())


def test_odd_rows(spark, no_docs):
    assert found(no_docs) == []
    rows = [(None, "one two", "en", "a", 0), (None, None, "en", None, 0), (3, "x" * 100_000 + " two", "en", "a", 0), (3, "", "en", "a", 0), (4, "two\x0bTWO\x1fé", None, "a", 0), (4, "two\x0bTWO\x1fé", None, "a", 0)]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert sorted(((str(r["doc_id"]), r["n_tokens"], r["held_out"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == by_hand(rows)
    only_held = [(i, "some words", "en", "a", 0) for i in range(60) if zlib.crc32(str(i).encode()) % 10 == 0]
    got = found(spark.createDataFrame(only_held, SCHEMA))
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(0, 0, 0.0)} and all(math.isfinite(r["score"]) for r in got)


@pytest.mark.parametrize("size", [1, 20, 1 << 20])
def test_words_of_stretches(size):
    """All rows once and in order, with words as bytes.split() finds them, whatever the bytes and wherever batches and stretches are cut."""
    rnd = random.Random(6)
    texts = [None, b"", b" \t ", b"\x1c\x85 A\xa0B\xff", *(bytes(rnd.choice(b" \t\n\x0b\x0c\r\x00\x1fAZaz\x80\xc3\xff") for _ in range(rnd.randint(0, 40))) for _ in range(300)), None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(range(len(texts)))], ["text", "row"])
    cuts = [0, 1, 1, 7, 150, len(texts)]
    rows, found = [], []
    for part in lm.stretches((batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)), size):
        sizes = [len(t or b"") for t in part.column("text").to_pylist()]
        assert part.num_rows == 1 or sum(sizes) <= size
        words, of = lm.words_of(part.column("text"))
        found += [[w for w, i in zip(words.to_pylist(), of.tolist(), strict=True) if i == k] for k in range(part.num_rows)]
        rows += part.column("row").to_pylist()
    assert rows == list(range(len(texts))) and found == [(t or b"").lower().split() for t in texts]


def test_bytes_that_are_no_characters(spark):
    """Strings of other bytes than UTF-8, which Spark reads from files as they are, have words too."""
    texts = spark.range(40).selectExpr("id AS doc_id", "CAST(IF(id % 2 = 1, X'ff6120ff62', X'ff6220fe62') AS STRING) AS text")
    got = {(r["doc_id"] % 2, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found(texts)}
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(40)]
    c = Counter(w for i in range(40) if not held[i] for w in ((b"\xffa", b"\xffb", None) if i % 2 else (b"\xffb", b"\xfeb", None)))
    n = sum(c.values())
    base = {i: round(sum(math.log10((c[w] + 0.1) / (n + 0.5)) for w in ((b"\xffa", b"\xffb", None) if i else (b"\xffb", b"\xfeb", None))), 6) for i in (0, 1)}
    assert got == {(i % 2, held[i], 3, 3, n, base[i % 2]) for i in range(40)}
