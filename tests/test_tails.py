"""Values at the last rows by NumPy: against window functions, and two templates of each family against pandas by hand."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from ashlar.functions.minute_features import features
from ashlar.plans.expr import TAILS, field, node, rolling, rolling_corr, rolling_quantile, with_factors
from ashlar.plans.snapshot import compute
from ashlar.plans.tails import Program, all_values, kth_smallest, tail_values

SCHEMA = "datetime timestamp_ntz, code string, open double, high double, low double, close double, volume double"
START = datetime(2024, 1, 2, 9, 30)


def bars(n, code="a", seed=0, gaps=False):
    rnd = np.random.default_rng(seed)
    close = 10 * np.exp(np.cumsum(rnd.normal(0, 2e-3, n)))
    open_, spread = close * np.exp(rnd.normal(0, 1e-3, n)), np.exp(rnd.uniform(0, 2e-3, n))
    d = pd.DataFrame({"datetime": [START + timedelta(minutes=k) for k in range(n)], "code": code, "open": open_, "high": np.maximum(open_, close) * spread, "low": np.minimum(open_, close) / spread, "close": close, "volume": rnd.integers(1, 5000, n).astype(float)})
    if gaps:
        d.loc[rnd.choice(n, n // 10, replace=False), "close"] = np.nan
        d.loc[rnd.choice(n, n // 10, replace=False), "volume"] = np.nan
    return d


def rows(d):
    return [(r[0].to_pydatetime(), r[1], *(None if np.isnan(v) else v for v in r[2:])) for r in d.itertuples(index=False)]


def test_tails_are_windows(spark):
    """Short, long and gappy codes, and one of a single row; the last five rows of each."""
    close, volume = field("close"), field("volume")
    change = node("fill", close / node("lag", close, params=(1,)) - 1, 0)
    exprs = {
        **{f"{k}_{n}": rolling(k, n, x) for k in ("mean", "sum", "std", "var", "max", "min") for n in (2, 7) for x in (change,)},
        "partial": node("part", close, params=("mean", 5)), "count": node("part", volume, params=("count", 4)), "corr": rolling_corr(6, close, volume), "quantile": rolling_quantile(0.8, 9, volume),
        "first": node("first", close, params=(4,)), "lag": node("lag", volume, params=(3,)), "and": (close > 10) & (volume > 2500), "or": (close > 10) | (volume > 2500),
        "if": node("if", close > 10, volume, -1), "mod": close % 0.25, "of_window": rolling("mean", 3, rolling("std", 3, close)), "pow": volume ** 0, "log": node("log", close - 10), "sqrt": node("sqrt", close - 10),
    }
    d = pd.concat([bars(1, "one"), bars(3, "three"), bars(40, "b", 1, gaps=True), bars(60, "c", 2)])
    panel = spark.createDataFrame(rows(d), SCHEMA)
    want = with_factors(panel, exprs).toPandas().sort_values(["code", "datetime"]).groupby("code").tail(5).reset_index(drop=True)
    since = START + timedelta(minutes=55)
    for got, asked in ((tail_values(panel, exprs, fill=None), want.groupby("code").tail(1)), (tail_values(panel, exprs, fill=None, since=since), want[want.datetime >= since])):
        got = got.toPandas().sort_values(["code", "datetime"]).reset_index(drop=True)
        asked = asked.reset_index(drop=True)
        assert got[["datetime", "code"]].equals(asked[["datetime", "code"]])
        for name in exprs:
            assert np.allclose(got[name].astype(float), asked[name].astype(float), atol=1e-9, equal_nan=True), name
    assert tail_values(panel.limit(0), exprs).count() == 0


@pytest.mark.parametrize("step", [1, 7, 4096])
def test_all_rows_are_windows(spark, step):
    """Codes longer and shorter than what is worked out at once; an exponential mean and a quantile among the features."""
    exprs = features(("attention",), median=10.0, rows=TAILS)
    exprs = {k: exprs[k] for i, k in enumerate(exprs) if i % 9 == 0}
    d = pd.concat([bars(1, "one"), bars(40, "b", 1, gaps=True), bars(330, "c", 2), bars(9, "d", 3)])
    panel = spark.createDataFrame(rows(d), SCHEMA).repartition(3)
    plain = features(("attention",), median=10.0, rows=None)
    want = compute(panel, {k: plain[k] for k in exprs}).toPandas().sort_values(["code", "datetime"]).reset_index(drop=True)
    got = all_values(panel, exprs, rows=step).toPandas().sort_values(["code", "datetime"]).reset_index(drop=True)
    assert got[["datetime", "code"]].equals(want[["datetime", "code"]])
    for name in exprs:
        assert np.allclose(got[name], want[name], atol=1e-8), name
    assert all_values(panel.limit(0), exprs).count() == 0


def test_order_statistics_of_sliding_frames():
    """Ties, missing values and infinities; every place of a frame."""
    rnd = np.random.default_rng(9)
    for n in (1, 2, 5, 31, 64):
        x = np.where(rnd.random((4, 64)) < 0.2, np.nan, rnd.integers(-5, 6, (4, 64)) * 0.5)
        x[1, :9] = np.inf
        frames = np.sort(np.lib.stride_tricks.sliding_window_view(x, n, axis=1), axis=-1)
        for p in {1, (n + 1) // 2, n}:
            assert np.array_equal(kth_smallest(x, n, p), frames[..., p - 1], equal_nan=True)


def test_reach_is_bounded_and_sections_are_refused():
    assert Program(features(rows=TAILS)).reach < 14_000
    with pytest.raises(ValueError):
        Program({"x": node("rank", field("close"), params=("average", True))})
    with pytest.raises(ValueError):
        Program({"x": node("part", field("close"), params=("sum", None))})


def test_templates_by_hand(spark):
    """Formulas written out anew in pandas, without the expression trees."""
    d = bars(1500, seed=5)
    o, h, lo, c, v = d.open, d.high, d.low, d.close, np.log1p(d.volume)
    ret, vret = c.pct_change().fillna(0), v.pct_change()
    E = 1e-3
    ratio = v / (v.rolling(60).mean() + E)
    gain, loss = ret.clip(lower=0).ewm(alpha=1 / 15).mean(), (-ret).clip(lower=0).ewm(alpha=1 / 15).mean()
    rsi = 100 - 100 / (1 + gain / (loss + E))
    up = (ret > 0).astype(float)
    level = 10 if c.median() >= 10 else 1
    hour = c.pct_change(60).fillna(0)
    want = {
        "round_3_distance": (c % level) / level, "ath_60min_distance": 1 - c / (c.rolling(60).max() + E), "support_bounce_15min": ((lo == c.rolling(15).min()) & (c > lo)).astype(float).rolling(15).sum(),
        "consecutive_gains": up.rolling(241).sum(), "sentiment_inertia_15min": (1 / (1 + rsi.diff().abs())).rolling(60).mean(), "volatility_index": ret.rolling(60).std() * 60**0.5 * 100,
        "retail_crowding_60min": v.rolling(60).std() / (v.rolling(60).mean() + E), "buy_high_pattern_30min": ((c > h.shift(1)) * v).rolling(30).sum() / (v.rolling(30).sum() + E), "price_anchoring_15min": ((c - c.rolling(15).mean()) / (c.rolling(15).std() + E)).abs(),
        "direction_consensus_60min": (up.rolling(60).mean() * 2 - 1).abs(), "volume_contagion_lag5": (ratio * ratio.shift(5)).rolling(241).mean(), "info_cascade_60min": v.rolling(60).corr(v.shift(1)).clip(-1, 1),
        "kyle_lambda": (ret.abs() / (v + 1)).rolling(60).mean(), "volatility_ratio": ret.rolling(60).var() / (ret.rolling(15).var() + E), "micro_volatility_15min": ((h - lo) / (o + E)).rolling(15).std(),
        "sentiment_memory_60min": (ret * v).ewm(halflife=60).mean(), "anchoring_bias": 1 - c / (h.rolling(241).max() + E), "risk_appetite_60min": v.where(ret > 0, 0).rolling(60).sum() / (v.where(ret < 0, 0).rolling(60).sum() + E),
        "attention_decay_hl60min": v.ewm(halflife=60).mean() / (v.rolling(240).mean() + E), "net_attention_flow": vret.rolling(60).sum(), "attention_shift_60min": v.pct_change(60) / (hour.abs() + E),
        "attention_saturation_60min": (v >= v.rolling(60).quantile(0.9, interpolation="nearest")).astype(float).rolling(60).mean(),
    }
    got = tail_values(spark.createDataFrame(rows(d), SCHEMA), features(median=float(c.median()), rows=TAILS)).first().asDict()
    for name, series in want.items():
        assert got[name] == pytest.approx(series.iloc[-1], rel=1e-7, abs=1e-10), name
