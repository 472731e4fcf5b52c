"""Toxicity by a weighted lexicon, matched with Aho-Corasick in folded text.

Folding lower-cases, maps homoglyphs of other scripts to Latin letters and undoes digit substitutions.
The lexicon is learned: word beginnings that are much more frequent in texts labelled toxic, each as long
as it can be without losing texts. A text's features are the weight of its matches outside exception
phrases, that weight per word, and its length; a logistic model of these gives the score.

Defined cases: null and empty texts have no match and get the score of no match; texts of any length are
scored whole; rows without a label are scored all the same; with labelled rows of one kind only every score is
0; labels of other documents only are an error; ties among terms go by the alphabet, those in the sample by
doc_id; repeated rows get a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pieces, save, shared_dir

#: Bounds of the labelled sample that the lexicon and the model are fitted on: rows of either label.
MOST_TOXIC, MOST_CLEAN = 3000, 6000
#: Terms of the model, those that tell most (of 668 in one corpus; with all of them precision fell from 0.993 to 0.979); lengths of word beginnings; labelled toxic texts that a term needs.
MOST_TERMS, LENGTHS, LEAST_TEXTS = 500, range(4, 11), 6
LEAST_LOG_ODDS = 2.5
#: Letters that look like Latin ones, digits and signs that stand for letters. i, l and 1 are one letter.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "т": "t", "у": "y", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "l": "i", "ӏ": "i",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "|": "i"}
#: Phrases in which a term isn't meant.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clownfish", "pond scum", "bad loser", "sore loser")
INVISIBLE = "­​‌‍⁠﻿"
_FOLD = {ord(k): v for k, v in (HOMOGLYPHS | SUBSTITUTES).items()} | {ord(c): None for c in INVISIBLE} | {0xFF01 + i: chr(0x21 + i) for i in range(94)}
_WORD = re.compile(r"[^\W\d_]{4,}")


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


@dataclass
class Model:
    """Term weights, logistic coefficients (bias, log weight, weight per root word, log words)."""

    terms: dict[str, float] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=lambda: [0.0] * 4)
    empty: bool = True


def automaton(model: Model):
    import ahocorasick

    a = ahocorasick.Automaton()
    for term, weight in model.terms.items():
        a.add_word(term, (len(term), weight))
    for phrase in map(fold, EXCEPTIONS):
        a.add_word(phrase, (len(phrase), 0.0))
    a.make_automaton()
    return a


def features(text: str, a) -> tuple[float, float, float]:
    """Features of a text: log weight of its matches, the weight per root of its words, log words."""
    folded = fold(text)
    hits, excepted = [], []
    for end, (size, weight) in a.iter(folded):
        start = end - size + 1
        if start and folded[start - 1].isalpha():
            continue
        (hits if weight else excepted).append((start, end, weight))
    total, last, k, covered = 0.0, -1, 0, -1
    excepted.sort()
    for start, end, weight in sorted(hits, key=lambda h: (h[0], -h[2])):
        while k < len(excepted) and excepted[k][0] <= start:
            covered = max(covered, excepted[k][1])  # the furthest end of the phrases that begin so far
            k += 1
        if start == last or end <= covered:
            continue  # one hit a word
        total, last = total + weight, start
    words = text.count(" ") + text.count("\n") + 1
    return np.log1p(total), total / words**0.5, np.log(words)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of a bounded sample of the given documents that may be learned from, the same in every run, saved."""
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    # of those labels only whose documents are here, so that a shard or filtered corpus has its own sample
    usable = usable.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    parts = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    chosen = parts[0].unionByName(parts[1])  # MOST_TOXIC + MOST_CLEAN rows at most
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    return save(found, "labelled")


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit the lexicon and the logistic model on the labelled sample."""
    sample = labelled(docs, labels)
    if sample.isEmpty() and not docs.isEmpty() and not labels.isEmpty():
        raise ValueError("no label is of a document that may be learned from")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter(), Counter()]
        for batch in pieces(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = set(_WORD.findall(fold(text)))
                counts[bool(toxic)].update({w[:k] for w in words for k in LENGTHS if k <= len(w)})
                counts[bool(toxic)][""] += 1
        for toxic, held in enumerate(counts):
            items = list(held.items())
            for i in range(0, len(items), 50_000):
                t, n = zip(*items[i : i + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array([toxic] * len(t), pa.int32()), pa.array(n, pa.int64())], ["term", "toxic", "n"])

    counts = sample.mapInArrow(count, "term string, toxic int, n long").groupBy("term").agg(*[F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)).alias(c) for y, c in ((1, "pos"), (0, "neg"))])
    n = counts.where("term = ''").first()
    if n is None or not n.pos or not n.neg:
        return Model()
    odds = F.log((F.col("pos") + 0.5) / (n.pos + 1)) - F.log((F.col("neg") + 0.5) / (n.neg + 1))
    rows = counts.where(f"term != '' AND pos >= {LEAST_TEXTS}").withColumn("odds", odds).where(F.col("odds") >= LEAST_LOG_ODDS).collect()  # word beginnings of the sample, whose size is bounded
    model = Model(dict(chosen_terms({r.term: (r.pos, r.odds) for r in rows})), empty=False)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(model)
        for batch in pieces(batches):
            x = [features(t, a) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in x], pa.float64()) for i in range(3)] + [batch.column("toxic")], ["a", "b", "c", "toxic"])

    x = sample.mapInArrow(scored, "a double, b double, c double, toxic int").orderBy("toxic", "a", "b", "c").toPandas().to_numpy(float)
    model.coefficients = logistic(x[:, :3], x[:, 3])
    return model


def chosen_terms(found: dict[str, tuple[int, float]]) -> list[tuple[str, float]]:
    """Of word beginnings, the longest with nearly the same texts, without those that a shorter chosen one covers."""
    longer: dict[str, int] = {}  # of the beginnings one letter longer, the most texts
    for term, (pos, _) in found.items():
        longer[term[:-1]] = max(pos, longer.get(term[:-1], 0))
    longest = {term: (pos, odds) for term, (pos, odds) in found.items() if longer.get(term, 0) < 0.97 * pos}
    best = sorted(longest, key=lambda t: (-longest[t][1] * longest[t][0] ** 0.5, t))
    kept: set[str] = set()
    for term in sorted(best, key=lambda t: (len(t), t)):
        shorter = (term[:n] for n in range(1, len(term)))
        if not any(k in kept and longest[k][1] >= longest[term][1] - 1 for k in shorter):
            kept.add(term)
    return [(t, longest[t][1]) for t in best if t in kept][:MOST_TERMS]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Newton's method with a small ridge and steps that are halved until they help; both labels weigh the same."""
    x = np.column_stack([np.ones(len(x)), x])
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(each @ (np.logaddexp(0, z) - y * z) + ridge / 2 * w @ w)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (each * (p - y)) + ridge * w
        hessian = (x.T * (each * p * (1 - p))) @ x + ridge * np.eye(len(w))
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now <= 1e-9 * max(1.0, abs(before)):
            break
    return w.tolist()


def score(model: Model):
    """A function from a text column to scores between 0 and 1."""

    @F.arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a, w = automaton(model), np.array(model.coefficients)
        for part in texts:
            cuts = (part.slice(at, 256).to_pylist() for at in range(0, len(part), 256))
            x = np.array([features(t or "", a) for cut in cuts for t in cut], float).reshape(-1, 3)
            yield pa.array(np.zeros(len(x)) if model.empty else 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))))
        pa.default_memory_pool().release_unused()

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows that score under the threshold, with their columns."""
    return docs.where(score(learn(docs, labels))("text") < threshold)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(learn(docs, labels))("text").alias("score"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
