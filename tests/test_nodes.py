"""Nodes on small panels: ties, gaps, single codes, short histories; EWM against pandas; no look-ahead."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from ashlar.operators import nodes as n
from ashlar.plans.expr import Expr, ewm, field, rolling_corr, rolling_quantile, rolling_skew, with_factors

DAY = datetime(2024, 1, 1)
SCHEMA = "datetime timestamp_ntz, code string, open double, high double, low double, close double, volume double"


def frame(spark, rows):
    """rows: (day number, code, close[, volume])."""
    return spark.createDataFrame([(DAY + timedelta(days=d), c, x, x, x, x, float(v[0]) if v else 1.0) for d, c, x, *v in rows], SCHEMA)


def values(spark, rows, e):
    got = with_factors(frame(spark, rows), {"x": e}).toPandas().sort_values(["code", "datetime"])
    return [None if pd.isna(v) else round(float(v), 9) for v in got.x]


def test_section_ties(spark):
    rows = [(0, c, x) for c, x in zip("abcdef", [1.0, 1.0, 1.0, 2.0, 3.0, 4.0], strict=True)]
    assert values(spark, rows, n.Rank(n.Close())) == [0.2, 0.2, 0.2, 0.6, 0.8, 1.0]
    assert values(spark, rows, n.Quantile(n.Close(), 3)) == [0.5] * 6


def test_single_code(spark):
    rows = [(0, "a", 5.0)]
    assert values(spark, rows, n.Rank(n.Close())) == [0.5]
    assert values(spark, rows, n.Zscore(n.Close())) == [0.0]
    assert values(spark, rows, n.Neutralize(n.Close(), n.Volume())) == [5.0]
    assert values(spark, rows, n.Std(n.Close(), 3)) == [0.0]


def test_calendar_reference_reads_over_gaps(spark):
    rows = [(0, "a", 1.0), (3, "a", 2.0), (4, "a", None), (5, "a", 4.0)]
    assert values(spark, rows, n.Ref(n.Close(), 1)) == [None, 1.0, 2.0, 2.0]
    assert values(spark, rows, n.Ref(n.Close(), 1, "rows")) == [None, 1.0, 2.0, None]


def test_division_and_missing(spark):
    rows = [(0, "a", 0.0), (1, "a", None)]
    assert values(spark, rows, n.Close() / n.Close()) == [None, None]
    assert values(spark, rows, n.Greater(n.Close(), -1)) == [1.0, 0.0]
    assert values(spark, rows, n.IfElse(n.Close() > 0, 1, 2)) == [2.0, 1.0]
    assert values(spark, rows, n.Sqrt(n.Close() - 1)) == [0.0, None]


@pytest.mark.parametrize("rows", [None, 100])
def test_ewm_is_pandas(spark, rows):
    x = np.random.default_rng(0).normal(size=60)
    got = values(spark, [(i, "a", float(v)) for i, v in enumerate(x)], ewm(1 / 15, field("close"), rows))
    assert np.allclose(got, pd.Series(x).ewm(alpha=1 / 15).mean(), atol=1e-8)


def test_rolling_is_pandas(spark):
    x = pd.Series(np.random.default_rng(1).normal(size=40))
    rows = [(i, "a", float(v), float(v * v)) for i, v in enumerate(x)]
    close, volume = field("close"), field("volume")
    clean = lambda s: [None if pd.isna(v) else round(float(v), 6) for v in s]
    assert [None if v is None else round(v, 6) for v in values(spark, rows, rolling_corr(5, close, volume))] == clean(x.rolling(5).corr(x * x))
    assert [None if v is None else round(v, 6) for v in values(spark, rows, rolling_quantile(0.9, 5, close))] == clean(x.rolling(5).quantile(0.9, interpolation="nearest"))
    z = lambda a: ((a - a.mean()) ** 3).mean() / a.std(ddof=0) ** 3
    assert np.allclose([v for v in values(spark, rows, rolling_skew(5, close)) if v is not None], x.rolling(5).apply(z).dropna(), atol=1e-6)


def test_constant_prices(spark):
    rows = [(i, "a", 5.0, 2.0) for i in range(6)]
    assert values(spark, rows, rolling_corr(3, field("close"), field("volume"))) == [None] * 6


def test_tree_round_trip():
    e = n.Zscore(n.Mean(n.Close() / n.Ref(n.Close(), 2), 5))
    assert Expr.from_dict(e.to_dict()).key == e.key
    assert e.fields() == ["close"]


def test_order_of_rows_does_not_matter(spark):
    rows = [(d, c, float(d * 3 + i)) for d in range(8) for i, c in enumerate("abc")]
    e = n.Rank(n.EMA(n.Close(), 3))
    assert values(spark, rows, e) == values(spark, rows[::-1], e)


def test_sections_are_equal_to_the_last_bit_however_rows_come(spark):
    x = np.random.default_rng(3).normal(size=700) * np.pi
    rows = frame(spark, [(d, f"c{i}", float(v), float(v * v)) for d in (0, 1) for i, v in enumerate(x)])
    exprs = {"z": n.Zscore(n.Close()), "fit": n.Neutralize(n.Close(), n.Volume()), "share": n.Scale(n.Close())}
    a, b = (with_factors(df, exprs).where("datetime < '2024-01-02'").toPandas().sort_values("code") for df in (rows, rows.orderBy("volume").repartition(3)))
    for c in exprs:
        assert a[c].to_numpy().tobytes() == b[c].to_numpy().tobytes(), c
