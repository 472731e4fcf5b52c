"""A gated recurrent language model in NumPy, learned in data-parallel rounds, and the log-likelihood of whole documents.

Tokens are the words of a text, A-Z lower-cased, and an end. What the model tells apart are symbols: the HEAD words most frequent in
the learning texts, the end, and a rest symbol per class for all other words. A word's class follows from its last bytes, so that a
word that was never seen has one too. The output is factored: a softmax over classes, one over the symbols of the class, and for words
of a rest symbol their share of the rest's counts, (c + 0.1) / (N + 0.1 * (V + 1)) with the rest's own N and V; an unseen word
is the one type besides, in its class, as it is in the base model among all.

* Counts are of all learning texts: tasks count words, Spark adds up. The tasks hold a dictionary of the words with at least so many occurrences that COMMON words at most
  have as many; other words get their counts by a join on the word, and come back as a sum per document.
* Learning goes over all learning texts once, in ROUNDS jobs: each task goes on from the last round's parameters over its part, by
  backpropagation through windows of tokens; the parameters of all tasks are averaged by their tokens, block by block, in Spark. What the driver holds is
  one set of parameters, whose size doesn't depend on the corpus.
* Documents stand one after another in lanes, side by side. The state goes on from window to window and begins anew with each
  document, in learning and in scoring, so that a score is of the complete document and of nothing else.

Defined cases: null and empty texts are the end alone; texts and words of any length are taken whole; rows without a doc_id are learned from; repeated rows count each and
have a row each; without learning texts there are no counts (every word is the unseen type), and scores are those of an untrained model; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pieces, save, shared_dir, shuffle_files_dropped

#: Words that are symbols of their own; words whose counts the tasks hold, at most, and their longest in bytes.
HEAD, COMMON, LONGEST = 2048, 1 << 18, 48
#: Classes of words, and bytes at a word's end that tell them. The end is a class besides.
CLASSES, ENDING = 32, 3
#: Units of the state, rounds, lanes at most, and tokens that a task is given in a round at least.
WIDTH, ROUNDS, LANES, PART = 16, 3, 512, 1 << 22
#: Tokens of a lane in a window, that is how far gradients go back: WINDOW, or more where lanes are few, up to FULL tokens of all and LONG_WINDOW.
WINDOW, FULL, LONG_WINDOW = 16, 2048, 128
RATE, CLIP, BLOCK = 0.12, 1.0, 1 << 14
#: Logits end here, so that their exponentials stay finite.
MOST_LOGIT = np.float32(60)
#: Tokens that are put into lanes at once; bytes of text whose words a task counts at once, and looks up at once.
CHUNK, HELD, TEXT = 1 << 23, 1 << 25, 1 << 23
SMOOTH = 0.1


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts (binary), one text after another, and the text each is of: what stands between the six ASCII white-space
    characters, A-Z lower-cased. Arrow's functions go by bytes, and strings are only looked at as such, so other bytes stay as they are."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string())))
    words, of = split.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    some = pc.greater(pc.binary_length(words), 0)  # white space at an end of a text leaves an empty word there
    return words.filter(some).view(pa.binary()), of[some.to_numpy(zero_copy_only=False)]


def stretches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A task's rows again, in batches of about so many bytes of text, or of one longer text."""
    held, n = [], 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = int(np.searchsorted(ends, before + size - n, side="right"))
            if to == at and not held:
                to = at + 1
            if to > at:
                held.append(batch.slice(at, to - at))
                n += int(ends[to - 1]) - before
                at = to
            if at < batch.num_rows or n >= size:
                yield joined()
                held, n = [], 0
    if held:
        yield joined()
    pa.default_memory_pool().release_unused()


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-ENDING:]) % CLASSES


# counts


def word_counts(texts: DataFrame) -> DataFrame:
    """Saved: word, c of all texts; the row with a null word counts the texts, that is their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in stretches(batches, HELD):
            found = words_of(part.column("text"))[0].value_counts()
            words, c = found.field("values").view(pa.string()), found.field("counts")
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.nulls(1, pa.string())]), pa.concat_arrays([c, pa.array([part.num_rows], pa.int64())])], ["word", "c"])

    return save(texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0"), "word-counts")


@dataclass
class Vocabulary:
    """common: words by falling count, the first HEAD of them symbols; rest_n, rest_v: tokens and types of each class outside of them; n, v: all tokens and types."""

    common: list[bytes]
    counts: np.ndarray
    ends: int
    n: int
    v: int
    rest_n: np.ndarray
    rest_v: np.ndarray

    def __post_init__(self):
        head = self.common[:HEAD]
        classes = np.array([*map(class_of, head), *range(CLASSES), CLASSES], np.int64)  # head words, rests, the end
        order = np.argsort(classes, kind="stable")
        self.symbols = np.empty(len(order), np.int64)
        self.symbols[order] = np.arange(len(order))
        self.symbol_class = classes[order]
        self.first = np.searchsorted(self.symbol_class, np.arange(CLASSES + 2))
        self.rest, self.end = self.symbols[len(head) : len(head) + CLASSES], int(self.symbols[-1])
        tokens = np.concatenate([self.counts[: len(head)], self.rest_n, [self.ends]])[order]
        self.tokens = tokens.astype(np.float64)

    def share(self) -> np.ndarray:
        """log10 of what a rest's counts are divided by, per class."""
        return np.log10(self.rest_n + SMOOTH * (self.rest_v + 1))


def frequent(counts: DataFrame) -> DataFrame:
    """The words counted at least as often as a bound that COMMON words at most reach: found from how many words have which
    count, counts over 4,096 by their leading bits, so that only some thousand numbers come to the driver."""
    level = "case when c < 4096 then c else c - c % shiftleft(1L, length(bin(c)) - 10) end"
    least, words = 1 << 62, 0
    for r in counts.groupBy(F.expr(level).alias("level")).agg(F.count("*").alias("n")).sort(F.desc("level")).collect():
        words += r.n
        if words > COMMON:
            break
        least = r.level
    return counts.where(F.col("c") >= least)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The dictionary of the tasks and the sums over all words, from the counts."""
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word").isNull(), F.col("c"))).alias("ends")).first()
    top = frequent(counts.where(f"octet_length(word) <= {LONGEST}")).orderBy(F.desc("c"), "word").select(F.col("word").cast("binary").alias("word"), "c").collect()
    common, held = [bytes(r.word) for r in top], np.array([r.c for r in top], np.int64)
    head = set(common[:HEAD])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for part in pieces(batches, 4096):
            rest = [(class_of(w), c) for w, c in zip(part.column("word").to_pylist(), part.column("c").to_pylist(), strict=True) if w not in head]
            if rest:
                k, c = np.array(rest).T
                n += np.bincount(k, c, CLASSES).astype(np.int64)
                v += np.bincount(k, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n), pa.array(v)], ["k", "n", "v"])

    rest = counts.where("word IS NOT NULL").select(F.col("word").cast("binary").alias("word"), "c").mapInArrow(run, "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in rest:
        n[r.k], v[r.k] = r.n, r.v
    return Vocabulary(common, held, sums.ends or 0, sums.n or 0, sums.v, n, v)


ENCODED = "row long, doc_id long, held_out boolean, round int, n_tokens long, n_known long, base double, inside double, symbols binary, rare array<string>, times array<int>"


def encoded(docs: DataFrame, vocab: Vocabulary, held_out) -> DataFrame:
    """Saved, by round (-1: not learned from): the symbols of each document and what its common words add to both scores."""
    logs = np.log10(vocab.counts + SMOOTH)
    end_log, share = math.log10(vocab.ends + SMOOTH), vocab.share()
    names = [f.split()[0] for f in ENCODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, head = pa.array(vocab.common, pa.binary()), min(HEAD, len(vocab.common))
        classes = np.array([class_of(w) for w in vocab.common], np.int64)
        # one more for words that aren't common, at -1
        symbol_of = np.concatenate([vocab.symbols[:head], vocab.rest[classes[head:]], [0]]).astype(np.uint16)
        log, inside = np.append(logs, 0), np.append(logs - share[classes], 0)
        inside[:head] = 0
        for part in stretches(batches, TEXT):
            rows = part.num_rows
            words, of = words_of(part.column("text"))
            at = pc.fill_null(pc.index_in(words, common), -1).to_numpy()
            symbols = np.full(len(words) + rows, vocab.end, np.uint16)  # the end of each text stays
            place = np.arange(len(words)) + of
            symbols[place] = symbol_of[at]
            n, known = np.bincount(of, minlength=rows) + 1, np.bincount(of[at >= 0], minlength=rows) + int(vocab.ends > 0)
            base, within = np.bincount(of, log[at], rows) + end_log, np.bincount(of, inside[at], rows).astype(np.float64)  # whole numbers without words
            others = np.flatnonzero(at < 0)
            rare = words.take(pa.array(others)).dictionary_encode()
            which, code = rare.dictionary, rare.indices.to_numpy().astype(np.int64)
            k = np.array([class_of(w) for w in which.to_pylist()], np.int64)[code]
            symbols[place[others]] = vocab.rest[k]
            within -= np.bincount(of[others], share[k], rows)
            pairs, times = np.unique(of[others] * max(len(which), 1) + code, return_counts=True)
            text, word = np.divmod(pairs, max(len(which), 1))
            bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=rows))]), pa.int32())
            ends = np.concatenate([[0], np.cumsum(n * symbols.itemsize)]).astype(np.int32)
            made = [
                pa.array(n), pa.array(known), pa.array(base), pa.array(within), pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends), pa.py_buffer(symbols)]),
                pa.ListArray.from_arrays(bounds, which.take(pa.array(word)).view(pa.string())), pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "held_out", "round")), *made], names)

    row = F.monotonically_increasing_id()
    given = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("binary").alias("text"))
    given = given.select("row", "doc_id", "held_out", F.when(F.col("held_out"), -1).otherwise(F.pmod(F.xxhash64("row"), F.lit(ROUNDS))).cast("int").alias("round"), "text")
    return save(given.mapInArrow(run, ENCODED), "encoded", ["round"])


def rare_sums(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """row, rare_log, rare_known: the sum of log10(c + 0.1) over words outside of the common ones, and how many have a count."""
    words = texts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    found = words.join(counts.where("word IS NOT NULL"), "word", "left").select("row", (F.col("times") * F.log10(c + SMOOTH)).alias("log"), F.when(c > 0, F.col("times")).otherwise(0).alias("known"))
    return found.groupBy("row").agg(F.sum("log").alias("rare_log"), F.sum("known").alias("rare_known"))


# the network


class Network:
    """A gated recurrent unit between an embedding of the last symbol and a softmax factored by classes."""

    def __init__(self, vocab: Vocabulary, seed: int = 17):
        rnd = np.random.Generator(np.random.PCG64(seed))
        s, c, w = len(vocab.tokens), CLASSES + 1, WIDTH
        self.first, self.symbol_class, self.end = vocab.first, vocab.symbol_class, vocab.end
        small = lambda *shape: (rnd.standard_normal(shape) * 0.5 / math.sqrt(w)).astype(np.float32)
        log = np.log(vocab.tokens + 0.5)
        self.p = {
            "embed": small(s, w), "wx": small(w, 3 * w), "wh": small(w, 3 * w), "b": np.zeros(3 * w, np.float32),
            "wc": small(w, c) * 0.1, "bc": np.log(np.add.reduceat(vocab.tokens, self.first[:-1]) + 0.5).astype(np.float32), "wo": small(s, w) * 0.1, "bo": log.astype(np.float32),
        }
        self.p["bc"] -= self.p["bc"].max()
        self.p["bo"] -= np.maximum.reduceat(self.p["bo"], self.first[:-1])[self.symbol_class]
        self.p["b"][w : 2 * w] = 1  # at first the state mostly stays
        self.seen = {k: np.full(v.shape, 1e-4, np.float32) for k, v in self.p.items()}

    def vector(self) -> np.ndarray:
        return np.concatenate([a.ravel() for held in (self.p, self.seen) for a in held.values()])

    def load(self, vector: np.ndarray) -> None:
        at = 0
        for held in (self.p, self.seen):
            for k, a in held.items():
                held[k] = vector[at : at + a.size].reshape(a.shape).astype(np.float32)
                at += a.size

    def forward(self, given: np.ndarray, begins: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list]:
        """States after each step of a window (steps x lanes), and what the way back needs.

        Inside, lanes are the last axis: what is done to all lanes is then done to numbers that lie side by side.
        """
        p, w = self.p, WIDTH
        half = np.where(np.arange(3 * w) < 2 * w, np.float32(0.5), np.float32(1))  # a sigmoid is half a hyperbolic tangent of the half
        x = p["embed"][given]
        xw = np.matmul((p["wx"] * half).T, x.transpose(0, 2, 1))
        xw += (p["b"] * half)[:, None]
        wh, some, h = (p["wh"] * half).T.copy(), begins.any(axis=1), h.T
        shape = (len(given), w, given.shape[1])
        states, befores, hns = np.empty(shape, np.float32), np.empty(shape, np.float32), np.empty(shape, np.float32)
        hw = np.empty((3 * w, shape[2]), np.float32)
        for t in range(len(given)):
            before = befores[t]
            if some[t]:
                np.multiply(h, ~begins[t], out=before)
            else:
                before[:] = h
            np.matmul(wh, before, out=hw)
            gates, new = xw[t, : 2 * w], xw[t, 2 * w :]
            gates += hw[: 2 * w]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            hns[t] = hw[2 * w :]
            new += np.multiply(gates[:w], hns[t], out=hw[:w])
            np.tanh(new, out=new)
            h = np.subtract(before, new, out=states[t])
            h *= gates[w:]
            h += new
        return np.ascontiguousarray(states.transpose(0, 2, 1)), [x, befores, xw, hns]

    def output(self, h: np.ndarray, target: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-likelihood of each target symbol after states h; with grads, also the gradient of its loss to the states."""
        p = self.p
        k = self.symbol_class[target]

        def softmax(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Log-likelihoods of the own rows, and the gradient to the logits (without grads, what is left of them): a row per symbol, a column per state."""
            logits = weights @ h.T
            logits += bias[:, None]
            if (np.abs(weights).sum(1) * most + bias).max() > MOST_LOGIT:
                np.minimum(logits, MOST_LOGIT, out=logits)
            at = own * len(h)
            at += np.arange(len(h))
            found = logits.ravel()[at]
            e = np.exp(logits, out=logits)
            total = np.ones(len(e), np.float32) @ e
            if grads is not None:
                e *= 1 / total
                e.ravel()[at] -= 1
            return found - np.log(total, out=total), e

        most = max(np.abs(h).max(initial=0), 1)
        found, d = softmax(h, p["wc"].T, p["bc"], k)
        back = None
        if grads is not None:
            grads["wc"], grads["bc"], back = (d @ h).T, d @ np.ones(len(h), np.float32), d.T @ p["wc"].T
            grads["wo"], grads["bo"] = np.zeros_like(p["wo"]), np.zeros_like(p["bo"])
        order = np.argsort(k.astype(np.uint8), kind="stable")  # by radix
        edges = np.searchsorted(k[order], np.arange(CLASSES + 2)).tolist()
        sorted_h, own, inner = h[order], (target - self.first[k])[order], np.zeros(len(h), np.float32)
        sorted_back = np.zeros_like(sorted_h)
        for c in range(CLASSES):
            lo, hi, a, b = self.first[c], self.first[c + 1], edges[c], edges[c + 1]
            if a == b or hi - lo < 2:
                continue
            inner[a:b], d = softmax(sorted_h[a:b], p["wo"][lo:hi], p["bo"][lo:hi], own[a:b])
            if grads is not None:
                grads["wo"][lo:hi], grads["bo"][lo:hi] = d @ sorted_h[a:b], d @ np.ones(b - a, np.float32)
                sorted_back[a:b] = d.T @ p["wo"][lo:hi]
        found[order] += inner
        if grads is not None:
            back[order] += sorted_back
        return found, back

    def backward(self, given: np.ndarray, begins: np.ndarray, kept: list, back: np.ndarray, grads: dict) -> None:
        """Gradients through a window, from those of its states; none go past its beginning."""
        p, w, (x, befores, xw, hns) = self.p, WIDTH, kept
        back = np.ascontiguousarray(back.transpose(0, 2, 1))
        down, dxw, dhw = np.zeros_like(back[0]), np.empty_like(xw), np.empty_like(xw)
        held, some = np.empty_like(down), begins.any(axis=1)
        for t in range(len(given) - 1, -1, -1):
            r, z, new = xw[t, :w], xw[t, w : 2 * w], xw[t, 2 * w :]
            dr, dz, dnew = dxw[t, :w], dxw[t, w : 2 * w], dxw[t, 2 * w :]
            dh = np.add(back[t], down, out=down)
            rest = np.subtract(1, z, out=held)
            np.multiply(dh, rest, out=dnew)
            np.multiply(dh, np.subtract(befores[t], new, out=dz), out=dz)
            dz *= z
            dz *= rest
            np.multiply(new, new, out=held)
            dnew *= np.subtract(1, held, out=held)
            np.multiply(dnew, hns[t], out=dr)
            dr *= r
            dr *= np.subtract(1, r, out=held)
            dhw[t, : 2 * w] = dxw[t, : 2 * w]
            np.multiply(dnew, r, out=dhw[t, 2 * w :])
            dh *= z
            dh += np.matmul(p["wh"], dhw[t], out=held)
            if some[t]:
                dh *= ~begins[t]
        flat = dxw.transpose(0, 2, 1)
        grads["wx"], grads["wh"] = np.matmul(x.transpose(0, 2, 1), flat).sum(0), np.matmul(befores, dhw.transpose(0, 2, 1)).sum(0)
        grads["b"] = (dxw @ np.ones(dxw.shape[2], np.float32)).sum(0)
        order = np.argsort(given.astype(np.uint16), axis=None, kind="stable")  # by radix
        used = given.ravel()[order]
        heads = np.flatnonzero(np.concatenate([[True], used[1:] != used[:-1]]))
        grads["embed"] = (used[heads], np.add.reduceat(np.matmul(flat, p["wx"].T).reshape(-1, w)[order], heads))

    def step(self, grads: dict, tokens: int) -> None:
        """Adagrad on the gradient divided by so many tokens, whose norm is held at CLIP."""
        norm = math.sqrt(sum(float((g[1] if isinstance(g, tuple) else g).ravel() @ (g[1] if isinstance(g, tuple) else g).ravel()) for g in grads.values())) / tokens
        scale = np.float32(min(1.0, CLIP / norm if norm else 1.0) / tokens)
        for k, g in grads.items():
            at, g = g if isinstance(g, tuple) else (slice(None), g)
            g = g * scale
            self.seen[k][at] += g * g
            self.p[k][at] -= RATE * g / np.sqrt(self.seen[k][at])


class Lanes:
    """Documents one after another in lanes of about equal length, the longest first."""

    def __init__(self, docs: list[np.ndarray], lanes: int):
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        heap = [(0, k) for k in range(max(1, min(lanes, len(docs))))]
        held: list[list[int]] = [[] for _ in heap]
        for i in order:
            n, k = heapq.heappop(heap)
            held[k].append(i)
            heapq.heappush(heap, (n + len(docs[i]), k))
        held.sort(key=lambda h: -sum(len(docs[i]) for i in h))
        self.order = [i for h in held for i in h]
        self.flat = np.concatenate([docs[i] for i in self.order])
        sizes = np.array([len(docs[i]) for i in self.order], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.begins = np.zeros(len(self.flat), bool)
        self.begins[self.starts] = True
        self.length = np.array([sum(len(docs[i]) for i in h) for h in held], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)[:-1]])

    def windows(self, end: int, together: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
        """Places, whether they are in their lane, what is given, where documents begin, what is to be told: steps x lanes that go on.

        Lanes begin together, or end together: then the first windows hold the longest lanes alone, and the last ones all.
        """
        t, longest = 0, int(self.length[0])
        ahead = longest - self.length if together else np.zeros_like(self.length)
        while t < longest:
            n = int((ahead < t + WINDOW).sum()) if together else int((self.length > t).sum())
            steps = min(max(WINDOW, FULL // n), LONG_WINDOW, longest - t)
            n = int((ahead < t + steps).sum()) if together else n
            at = np.arange(t, t + steps)[:, None] - ahead[None, :n]
            inside = (at >= 0) & (at < self.length[None, :n])
            place = np.where(inside, self.at[:n] + at, self.at[:n])
            begins = self.begins[place]
            yield place, inside, np.where(begins, end, self.flat[place - 1]).astype(np.int64), begins, self.flat[place].astype(np.int64)
            t += steps


def learn_from(net: Network, docs: list[np.ndarray], lanes: int) -> None:
    """One pass over some documents, a step per window."""
    dealt = Lanes(docs, lanes)
    held = np.zeros((len(dealt.length), WIDTH), np.float32)
    for _, inside, given, begins, target in dealt.windows(net.end, together=True):
        n = given.shape[1]
        states, kept = net.forward(given, begins, held[:n])
        grads: dict = {}
        rows = np.flatnonzero(inside.ravel())
        flat = states.reshape(-1, WIDTH)
        _, part = net.output(flat[rows], target.ravel()[rows], grads)
        back = np.zeros_like(flat)
        back[rows] = part
        net.backward(given, begins, kept, back.reshape(states.shape), grads)
        # windows of few lanes, with a long document or two, weigh by their tokens
        net.step(grads, max(len(rows), len(dealt.length) * WINDOW))
        held[:n] = states[-1]


def log_likelihoods(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of the symbols of each document."""
    dealt = Lanes(docs, LANES)
    found = np.zeros(len(dealt.flat))
    h = np.zeros((len(dealt.length), WIDTH), np.float32)
    for place, inside, given, begins, target in dealt.windows(net.end):
        states, _ = net.forward(given, begins, h[: given.shape[1]])
        rows = np.flatnonzero(inside.ravel())
        found[place.ravel()[rows]] = net.output(states.reshape(-1, WIDTH)[rows], target.ravel()[rows])[0]
        h = states[-1]
    out = np.empty(len(docs))
    out[dealt.order] = np.add.reduceat(found, dealt.starts) / math.log(10)
    return out


def chunks_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows and symbols of a task's documents, about so many symbols at once."""
    rows, docs, held = [], [], 0
    for part in pieces(batches):
        found = [np.frombuffer(s, np.uint16) for s in part.column("symbols").to_pylist()]
        rows += part.column("row").to_pylist()
        docs += found
        held += sum(map(len, found))
        if held >= size:
            yield rows, docs
            rows, docs, held = [], [], 0
    if docs:
        yield rows, docs


# learning and scoring in Spark


def averaged(parts: DataFrame) -> np.ndarray | None:
    """The mean of the tasks' vectors by their tokens: blocks are added up in Spark, in two steps, in the order of the tasks."""

    def summed(by: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, weight, total = None, 0.0, None
            row = lambda: pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*last, weight, total.tobytes()), kinds, strict=True)], names)
            names, kinds = [*by, "weight", "values"], [*[pa.int32()] * len(by), pa.float64(), pa.binary()]
            for batch in pieces(batches, 16):
                for *key, w, v in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    if key != last and last is not None:
                        yield row()
                        weight, total = 0.0, None
                    last = key
                    values = np.frombuffer(v)
                    weight, total = weight + w, values if total is None else total + values
            if last is not None:
                yield row()

        return run

    first = parts.repartition("block", "lot").sortWithinPartitions("block", "lot", "part").mapInArrow(summed(["block", "lot"]), "block int, lot int, weight double, values binary")
    rows = first.repartition("block").sortWithinPartitions("block", "lot").mapInArrow(summed(["block"]), "block int, weight double, values binary").collect()
    return np.concatenate([np.frombuffer(r["values"]) / r.weight for r in sorted(rows, key=lambda r: r.block)]) if rows else None


def parts_of(texts: DataFrame, tokens: int) -> int:
    """Tasks for so many tokens: PART tokens each or more, so that lanes are full and parameters worth sending, but as many tasks as there are cores where there are tokens for them."""
    return max(1, tokens // PART, min(texts.sparkSession.sparkContext.defaultParallelism, tokens // (PART // 8)))


def learned(texts: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """Parameters after all rounds."""
    spark = texts.sparkSession
    vector = Network(vocab).vector()
    for number in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], vector=vector) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            net, tokens = Network(vocab), 0
            net.load(vector)
            for _, docs in chunks_of(batches, CHUNK):
                n = sum(map(len, docs))
                learn_from(net, docs, int(np.clip(n // 2048, 8, LANES)))
                tokens += n
            if tokens:
                out, part = net.vector().astype(np.float64) * tokens, TaskContext.get().partitionId()
                for b in range(0, len(out), BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK], pa.int32()), pa.array([part % 64], pa.int32()), pa.array([part], pa.int32()), pa.array([float(tokens)]), pa.array([out[b : b + BLOCK].tobytes()], pa.binary())], ["block", "lot", "part", "weight", "values"])

        part = texts.where(F.col("round") == number).select("row", "symbols")
        with shuffle_files_dropped(spark):
            found = averaged(part.coalesce(parts_of(texts, vocab.n // ROUNDS)).mapInArrow(run, "block int, lot int, part int, weight double, values binary"))
        vector = vector if found is None else found.astype(np.float32)
    return vector


def scored(texts: DataFrame, vocab: Vocabulary, vector: np.ndarray) -> DataFrame:
    """row, symbols_log: log10 probability of each document's symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(vocab)
        net.load(vector)
        for rows, docs in chunks_of(batches, CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(log_likelihoods(net, docs))], ["row", "symbols_log"])

    return texts.select("row", "symbols").coalesce(parts_of(texts, vocab.n)).mapInArrow(run, "row long, symbols_log double")


def language_model_scores(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of documents(doc_id, text); those that are held out aren't learned from."""
    counts = word_counts(docs.where(~held_out).select("text"))
    vocab = vocabulary(counts)
    texts = encoded(docs, vocab, held_out)
    scores = scored(texts, vocab, learned(texts, vocab))
    found = texts.drop("symbols", "rare", "times", "round").join(scores, "row").join(rare_sums(texts, counts), "row", "left")
    rare, known = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    divisor = math.log10(vocab.n + SMOOTH * (vocab.v + 1))
    return found.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + known).cast("long").alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("base") + rare - F.col("n_tokens") * F.lit(divisor)).alias("base_score"), (F.col("symbols_log") + F.col("inside") + rare).alias("score"),
    )


def op11_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 10 == 0, F.lit(False))
    return language_model_scores(documents(spark, sf_dir), held_out)
