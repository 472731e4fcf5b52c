"""Ranks and percentiles over all rows, worked out by ranges of values."""

import random

import pandas as pd
import pytest

from ashlar.plans.analysis import factor_correlation, overall_percentiles, ranked_values, winsorized


@pytest.fixture(scope="module")
def values():
    rnd = random.Random(3)
    # a third of the rows hold one value
    return [0.25 if rnd.random() < 1 / 3 else rnd.choice([round(rnd.gauss(0, 1), 2), rnd.gauss(0, 1e6)]) for _ in range(3000)] + [None] * 7


def test_ranks(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    got = {r.x: r.before + (r.n + 1) / 2 for r in ranked_values(frame, "v").collect()}
    known = pd.Series([v for v in values if v is not None])
    assert got == dict(zip(known, known.rank(), strict=True))


def test_percentiles(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    shares = (0.0, 0.013, 0.4, 0.5, 0.987, 1.0)
    known = pd.Series([v for v in values if v is not None])
    assert overall_percentiles(frame, "v", shares) == pytest.approx([known.quantile(p) for p in shares])
    assert overall_percentiles(frame.where("v IS NULL"), "v", shares) == [None] * 6


def test_winsorized_over_all_rows(spark, values):
    frame = spark.createDataFrame([(1, v) for v in values], "timestamp int, factor_value double")
    got = pd.Series([r.factor_value for r in winsorized(frame, 0.05, 0.95, by_date=False).collect()]).dropna()
    known = pd.Series([v for v in values if v is not None])
    want = known.clip(known.quantile(0.05), known.quantile(0.95))
    assert sorted(got) == pytest.approx(sorted(want))
    assert winsorized(frame.where("factor_value IS NULL"), by_date=False).where("factor_value IS NOT NULL").count() == 0


def test_correlation_of_ranks(spark):
    rnd = random.Random(4)
    rows = [(float(rnd.randint(0, 9)), rnd.gauss(0, 1), float(i % 5)) for i in range(500)]
    got = factor_correlation(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"], "spearman")
    want = pd.DataFrame(rows, columns=["a", "b", "c"]).corr("spearman")
    assert {(r.a, r.b): r.corr for r in got.collect()} == pytest.approx({(a, b): want[a][b] for a, b in (("a", "b"), ("a", "c"), ("b", "c"))})
