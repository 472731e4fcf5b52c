"""Minute-bar behaviour features: 574 columns from 172 templates in seven families.

Every feature is an expression over a code's rows in time order; the value at the code's last row is its
snapshot. Rolling windows are null unless they are full, except the tails, which may be partial.
"""

from __future__ import annotations

import math
from contextvars import ContextVar

from ..plans.expr import Expr, as_expr, ewm, field, node, rolling, rolling_corr, rolling_quantile, rolling_skew

PERIODS = (5, 15, 60, 241)
EPS = 1e-3


#: The most rows of a code that the features being built are for; 0: any number.
_ROWS = ContextVar("rows", default=0)


def RMEAN(n, x) -> Expr: return rolling("mean", n, x)
def RSUM(n, x) -> Expr: return rolling("sum", n, x)
def RSTD(n, x) -> Expr: return rolling("std", n, x)
def RVAR(n, x) -> Expr: return rolling("var", n, x)
def RMAX(n, x) -> Expr: return rolling("max", n, x)
def RMIN(n, x) -> Expr: return rolling("min", n, x)
def RSKEW(n, x) -> Expr: return rolling_skew(n, x)
def RCORR(n, x, y) -> Expr: return rolling_corr(n, x, y)
def RQ(q, n, x) -> Expr: return rolling_quantile(q, n, x)
def EWM(alpha, x) -> Expr: return ewm(alpha, x, _ROWS.get())
def LAG(k, x) -> Expr: return node("lag", x, params=(k,))
def DIFF(k, x) -> Expr: return as_expr(x) - LAG(k, x)
def PCT(k, x) -> Expr: return as_expr(x) / LAG(k, x) - 1
def FT(k, x) -> Expr: return node("first", x, params=(k,))
def tail_mean(kx) -> Expr: return node("part", kx[1], params=("mean", kx[0]))
def tail_std(kx) -> Expr: return node("part", kx[1], params=("std", kx[0]))
def eq(a, b) -> Expr: return node("eq", a, b)
def ne(a, b) -> Expr: return node("ne", a, b)
def sign(x) -> Expr: return node("sign", x)
def sqrt(x) -> Expr: return node("sqrt", x)
def greatest(a, b) -> Expr: return node("max", a, b)
def clip(x, a, b) -> Expr: return node("min", node("max", x, a), b)
def FIN_u(x) -> Expr: return node("fill", x, 0)


FIN_nu = FIN_u


def when(condition, a, b, *more) -> Expr:
    return node("if", condition, a, when(b, *more) if more else b)


def FIN_ni(change: Expr) -> Expr:
    """A relative change with 0 where it has a base of 0; null without a base."""
    return node("if", eq(change.args[0].args[1], 0), 0, change)


FIN_i = FIN_ni

# base features; volume is its logarithm from here on
open, high, low, close = (field(c) for c in ("open", "high", "low", "close"))
volume = node("log1p", field("volume"))


def cr(k) -> Expr: return node("fill", PCT(k, close), 0)
def vr(k) -> Expr: return node("fill", PCT(k, volume), 0)
def ret_mean(p) -> Expr: return RMEAN(p, cr(1))
def ret_std(p) -> Expr: return RSTD(p, cr(1))
def ret_var(p) -> Expr: return RVAR(p, cr(1))
def vol_mean(p) -> Expr: return RMEAN(p, volume)
def vol_std(p) -> Expr: return RSTD(p, volume)
def cls_mean(p) -> Expr: return RMEAN(p, close)
def cls_std(p) -> Expr: return RSTD(p, close)
def cls_max(p) -> Expr: return RMAX(p, close)
def cls_min(p) -> Expr: return RMIN(p, close)
def hi_max(p) -> Expr: return RMAX(p, high)
def lo_min(p) -> Expr: return RMIN(p, low)
def volatility(p) -> Expr: return ret_std(p) * math.sqrt(p)
def boll(p) -> Expr: return (close - cls_mean(p)) / (2 * cls_std(p) + EPS)


def rsi(p) -> Expr:
    gain, loss = EWM(1 / p, node("max", cr(1), 0)), EWM(1 / p, node("max", -cr(1), 0))
    return 100 - 100 / (1 + gain / (loss + EPS))


def base_features(rows: int | None = None) -> dict[str, Expr]:
    """The base features by name, for codes of at most so many rows as in features."""
    was = _ROWS.set(rows or 0)
    try:
        return _base_features()
    finally:
        _ROWS.reset(was)


def _base_features() -> dict[str, Expr]:
    made = {"close_ret_1": cr(1)}
    of = {
        "close_ret": cr, "volume_ret": vr, "ret_rolling_mean": ret_mean, "ret_rolling_std": ret_std, "ret_rolling_var": ret_var, "volume_rolling_mean": vol_mean, "volume_rolling_std": vol_std,
        "close_rolling_mean": cls_mean, "close_rolling_std": cls_std, "close_rolling_max": cls_max, "close_rolling_min": cls_min, "high_rolling_max": hi_max, "low_rolling_min": lo_min,
        "volatility": volatility, "rsi": rsi, "bollinger_pos": boll,
    }
    return made | {f"{name}_{p}": f(p) for name, f in of.items() for p in PERIODS}


#: Price levels and psychological levels by the median close's bracket.
LEVELS = (
    (1, (0.001, 0.005, 0.01, 0.05, 0.1), (0.005, 0.01, 0.025, 0.05, 0.1)),
    (10, (0.1, 0.5, 1, 5, 10), (0.25, 0.5, 1, 2.5, 5)),
    (100, (1, 5, 10, 50, 100), (10, 25, 50, 100, 250)),
)


def levels(median: float) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Levels for a median close; from 100 on they follow its magnitude."""
    for bound, base, psych in LEVELS:
        if median < bound:
            return base, psych
    magnitude = 10 ** math.floor(math.log10(median + EPS))
    return tuple(int(magnitude * x) for x in (0.1, 0.5, 1, 5, 10)), LEVELS[-1][2]


def near(level, share=0.01) -> float:
    """How far above a level still counts as at it."""
    return level * share if level >= 1 else level * 5 * share


def round_number(base_levels, psych_levels) -> list[tuple[str, Expr]]:
    return [
        *[(f"near_round_{i + 1}_time", RMEAN(241, ((close % level) < near(level)))) for i, level in enumerate(base_levels)],
        *[(f"round_{i + 1}_bounce", RMEAN(241, (((close % level) < near(level)) & (close > LAG(1, close))))) for i, level in enumerate(base_levels)],
        *[(f"round_{i + 1}_volume_cluster", RMEAN(60, when(((close % level) < near(level, 0.02)), volume, 0)) / (vol_mean(15) + EPS)) for i, level in enumerate(base_levels)],
        *[(f"support_bounce_{period}min", RSUM(period, (eq(low, cls_min(period)) & (close > low)))) for period in PERIODS],
        *[(f"resistance_test_{period}min", RSUM(period, (eq(high, cls_max(period)) & (close < high)))) for period in PERIODS],
        *[(f"round_{i + 1}_distance", (close % level) / level) for i, level in enumerate(base_levels)],
        *[(f"round_{i + 1}_breakout", ((close % level) - (FT(2, close) % level)) / level) for i, level in enumerate(base_levels)],
        *[(f"fib_{int(ratio * 1000)}_distance", abs((((close - cls_min(60)) / ((cls_max(60) - cls_min(60)) + EPS)) - ratio))) for i, ratio in enumerate([0.236, 0.382, 0.5, 0.618, 0.786])],
        *[(f"pct_{pct}_move_proximity", ((cr(15) * 100) % pct) / pct) for pct in [5, 10, 15, 20, 25]],
        *[(f"ath_{period}min_distance", 1 - (close / (cls_max(period) + EPS))) for period in PERIODS],
        *[(f"psych_{i + 1}_distance", (close % level) / level) for i, level in enumerate(psych_levels)],
    ]


def fomo_fud() -> list[tuple[str, Expr]]:
    return [
        ("return_skewness", RSKEW(241, PCT(1, close))),
        ("consecutive_gains", RSUM(241, (cr(1) > 0))),
        ("rally_volume", RMEAN(60, when((cr(1) > 0), volume, 0))),
        ("uptrend_acceleration", RMEAN(60, when((cr(1) > 0), DIFF(1, PCT(1, close)), 0))),
        *[(f"consecutive_up_{int(threshold * 10000)}bp", RSUM(60, (cr(1) > threshold))) for threshold in [0.005, 0.01, 0.015, 0.025]],
        *[(f"v_reversal_{period}min", (close / (LAG((2 * (period // 2)), close) + EPS)) * LAG((period // 2), eq(RMIN(period, low), low))) for period in [5, 15, 30, 60, 120]],
        *[(f"extreme_reversal_{period}min", RMEAN(60, (eq(close, cls_max(period)) | eq(close, cls_min(period))))) for period in PERIODS],
        *[(f"sentiment_overheat_{period}min", RMEAN(60, (rsi(period) > 70))) for period in PERIODS],
        *[(f"sentiment_overcold_{period}min", RMEAN(60, (rsi(period) < 30))) for period in PERIODS],
        *[(f"volume_price_divergence_{period}min", RMEAN(60, ne(sign(cr(period)), sign(vr(period))))) for period in PERIODS],
        *[(f"fear_index_{period}min", 1 - RMEAN(period, (low / (high + EPS)))) for period in PERIODS],
        *[(f"greed_index_{period}min", RMEAN(60, (cr(period) * vr(period)))) for period in PERIODS],
        *[(f"sentiment_oscillator_{period}min", RMEAN(60, ((close >= hi_max(period)) - (close <= lo_min(period))))) for period in PERIODS],
        *[(f"sentiment_extreme_duration_{period}min", RSUM(241, ((rsi(period) > 80) | (rsi(period) < 20)))) for period in PERIODS],
        *[(f"price_jump_{period}min", RSUM(241, (abs(cr(period)) > (ret_std(241) * 2)))) for period in PERIODS],
        *[(f"liquidity_stress_{period}min", RMEAN(60, (((high - low) / (close + EPS)) / ((volume / (vol_mean(period) + EPS)) + EPS)))) for period in PERIODS],
        *[(f"sentiment_inertia_{period}min", RMEAN(60, (1 / (1 + abs(DIFF(1, rsi(period))))))) for period in PERIODS],
        ("volatility_index", (ret_std(60) * math.sqrt(60)) * 100),
        ("return_kurtosis_proxy", ret_var(60)),
        *[(f"fomo_surge_{period}min", cr(period) / (ret_std(241) + EPS)) for period in PERIODS],
        *[(f"volume_fomo_{period}min", vol_mean(period) / (tail_mean(((period * 4), volume)) + EPS)) for period in PERIODS],
        *[(f"panic_sell_{period}min", (cr(period) < -0.005) * (volume / (tail_mean(((period * 4), volume)) + EPS))) for period in PERIODS],
        *[(f"chase_momentum_lag{lag}", cr(1) * FT((lag + 1), cr(1))) for lag in [1, 2, 3, 4, 5]],
        *[(f"sentiment_shift_{period}min", abs((rsi(period) - FT(2, rsi(period))))) for period in PERIODS],
        *[(f"price_acceleration_{period}min", cr(period) - FT(2, cr(period))) for period in PERIODS],
        *[(f"volume_acceleration_{period}min", vr(period) - FT(2, vr(period))) for period in PERIODS],
        *[(f"volatility_regime_{period}min", tail_std(((period // 2), cr(1))) / (ret_std(period) + EPS)) for period in PERIODS],
        *[(f"bollinger_position_{period}min", boll(period)) for period in PERIODS],
        *[(f"momentum_divergence_{period}min", abs((cr(period) - vr(period)))) for period in PERIODS],
        *[(f"volume_anomaly_{period}min", abs(((volume - vol_mean(period)) / (vol_std(period) + EPS)))) for period in PERIODS],
    ]


def retail_pattern() -> list[tuple[str, Expr]]:
    return [
        *[(f"buy_high_pattern_{period}min", RSUM(period, ((close > LAG(1, high)) * volume)) / (RSUM(period, volume) + EPS)) for period in [5, 15, 30, 60, 120, 241]],
        *[(f"buy_dip_pattern_{period}min", RSUM(period, ((close < LAG(1, low)) * volume)) / (RSUM(period, volume) + EPS)) for period in [5, 15, 30, 60, 120, 241]],
        *[(f"retail_panic_{period}min", RMEAN(241, ((cr(1) < -0.02) * (volume / (vol_mean(period) + EPS))))) for period in PERIODS],
        *[(f"volume_clustering_{period}min", RSUM(241, (((volume - vol_mean(period)) / (vol_std(period) + EPS)) > 2))) for period in PERIODS],
        *[(f"contrarian_pattern_{period}min", RMEAN(241, ((cr(1) > 0) * (volume < vol_mean(period))))) for period in PERIODS],
        *[(f"consolidation_breakout_{period}min", RMEAN(241, ((high - low) / ((hi_max(period) - lo_min(period)) + EPS)))) for period in PERIODS],
        *[(f"sentiment_reversal_{period}min", RMEAN(241, ((cr(period) > 0) * (vr(period) < 0)))) for period in PERIODS],
        *[(f"retail_fatigue_{period}min", (RSUM(period, (cr(1) > 0)) / period) * (volume / (vol_mean(period) + EPS))) for period in PERIODS],
        *[(f"herding_effect_{period}min", RMEAN(241, (sign(cr(1)) * (volume / (vol_mean(period) + EPS))))) for period in PERIODS],
        *[(f"price_discovery_lag{lag}", clip(FIN_nu(RCORR(241, cr(1), LAG(lag, FIN_ni(PCT(1, volume))))), -1.0, 1.0)) for lag in [1, 5, 15]],
        *[(f"money_flow_{period}min", RSUM(period, DIFF(1, ((((high + low) + close) / 3.0) * volume))) / (RSUM(period, ((((high + low) + close) / 3.0) * volume)) + EPS)) for period in PERIODS],
        ("retail_capitulation", ((cr(241) < -0.04) & (volume > (vol_mean(241) * 2))) & (cr(1) < -0.01)),
        *[(f"stop_loss_{int(threshold * 100)}pct", (cr(60) < -threshold) * (volume / (vol_mean(60) + EPS))) for threshold in [0.02, 0.04]],
        *[(f"take_profit_{int(threshold * 100)}pct", (cr(60) > threshold) * (cr(1) < 0)) for threshold in [0.02, 0.04]],
        *[(f"range_trading_{period}min", (volume / (vol_mean(period) + EPS)) * (1.0 / (1.0 + ret_std(period)))) for period in PERIODS],
        *[(f"breakout_trading_{period}min", ((close > FT(2, hi_max(period))) | (close < FT(2, lo_min(period)))) * (volume / (vol_mean(period) + EPS))) for period in PERIODS],
        *[(f"momentum_chasing_lag{lag}", (cr(1) * FT((lag + 1), cr(1))) * (volume / (vol_mean(60) + EPS))) for lag in [1, 3, 5]],
        *[(f"retail_crowding_{period}min", vol_std(period) / (vol_mean(period) + EPS)) for period in PERIODS],
        *[(f"price_anchoring_{period}min", abs(((close - cls_mean(period)) / (cls_std(period) + EPS)))) for period in PERIODS],
        *[(f"mean_reversion_{period}min", ((close < cls_mean(period)) & (FT(2, close) > FT(2, cls_mean(period)))) * (volume / (vol_mean(period) + EPS))) for period in PERIODS],
        *[(f"news_driven_{period}min", abs(((open - FT(2, close)) / (FT(2, close) + EPS))) * (volume / (vol_mean(period) + EPS))) for period in PERIODS],
        *[(f"ta_dependency_{period}min", ((close > cls_mean(period)) & (FT(2, close) <= FT(2, cls_mean(period)))) * (volume / (vol_mean(60) + EPS))) for period in PERIODS],
        *[(f"sr_test_intensity_{period}min", ((low <= (lo_min(period) * 1.01)) | (high >= (hi_max(period) * 0.99))) * (volume / (vol_mean(period) + EPS))) for period in PERIODS],
        *[(f"volatility_preference_{period}min", ret_std(period) * (volume / (vol_mean(period) + EPS))) for period in PERIODS],
    ]


def herding() -> list[tuple[str, Expr]]:
    return [
        ("strong_herding_bull", (RMEAN(120, (cr(1) > 0)) > 0.7)),
        ("strong_herding_bear", (RMEAN(120, (cr(1) > 0)) < 0.3)),
        ("fragmented_market", ((RMEAN(120, (cr(1) > 0)) >= 0.45) & (RMEAN(120, (cr(1) > 0)) <= 0.55))),
        ("regime_transition", (abs(DIFF(60, RMEAN(120, (cr(1) > 0)))) > 0.1)),
        ("leader_moves", (abs(cr(15)) > RQ(0.9, 60, abs(cr(15))))),
        ("follower_tendency", RMEAN(60, eq((cr(1) > 0), (LAG(1, cr(1)) > 0)))),
        ("leader_effectiveness", RMEAN(120, (LAG(1, cr(15)) * cr(15)))),
        ("info_shock_absorption", RMEAN(60, FIN_nu((abs(FIN_ni(PCT(1, volume))) / (abs(cr(1)) + EPS))))),
        ("info_processing_speed", RMEAN(60, (abs(cr(1)) / (LAG(1, abs(cr(1))) + EPS)))),
        *[(f"direction_consensus_{period}min", abs(((RMEAN(period, (cr(1) > 0)) * 2) - 1))) for period in PERIODS],
        *[(f"extreme_sync_{period}min", RMEAN(period, (eq(high, hi_max(period)) & eq(volume, RMAX(period, volume))))) for period in PERIODS],
        *[(f"reversal_sync_{period}min", RMEAN(period, (cr(1) * LAG(period, cr(1))))) for period in PERIODS],
        *[(f"volatility_contagion_lag{lag}", RMEAN(241, (abs(cr(1)) * LAG(lag, abs(cr(1)))))) for lag in [1, 5, 15, 60, 241]],
        *[(f"volume_contagion_lag{lag}", RMEAN(241, ((volume / (vol_mean(60) + EPS)) * LAG(lag, (volume / (vol_mean(60) + EPS)))))) for lag in [1, 5, 15, 60, 241]],
        *[(f"trend_following_{period}min", RMEAN(period, ((close > cls_mean(period)) & (LAG(1, close) > LAG(1, cls_mean(period)))))) for period in PERIODS],
        *[(f"consensus_break_{period}min", DIFF(1, (RMEAN(period, (cr(1) > 0)) > 0.75)) * -1) for period in PERIODS],
        *[(f"price_magnetic_{period}min", RMEAN(241, abs(((close / (cls_mean(period) + EPS)) - 1)))) for period in PERIODS],
        *[(f"decision_lag_{period}min", RCORR(period, (LAG(1, cr(period)) * vr(period)), cr(period))) for period in PERIODS],
        *[(f"herding_deviation_{period}min", RMEAN(241, abs((cr(1) - ret_mean(period))))) for period in PERIODS],
        *[(f"info_cascade_{period}min", clip(FIN_nu(RCORR(period, volume, LAG(1, volume))), -1.0, 1.0)) for period in PERIODS],
        *[(f"mimetic_trading_{period}min", clip(FIN_nu(RCORR(period, volume, LAG(1, volume))), -1.0, 1.0) * clip(FIN_nu(RCORR(period, cr(1), LAG(1, cr(1)))), -1.0, 1.0)) for period in PERIODS],
        *[(f"group_polarization_{period}min", RMEAN(period, (abs(cr(1)) > RQ(0.8, (period * 4), abs(cr(1)))))) for period in PERIODS],
        *[(f"conformity_pressure_{period}min", abs((RMEAN(period, (cr(1) > 0)) - 0.5)) * 2) for period in PERIODS],
        *[(f"contrarian_sensitivity_{period}min", RMEAN(60, (LAG(1, when((RMEAN(period, (cr(1) > 0)) > 0.7), -1, (RMEAN(period, (cr(1) > 0)) < 0.3), 1, 0)) * cr(1)))) for period in PERIODS],
        *[(f"network_effect_{period}min", RMEAN(120, ((vol_std(period) / (vol_mean(period) + EPS)) * abs(cr(period))))) for period in PERIODS],
        *[(f"info_asymmetry_{period}min", RMEAN(period, (LAG(1, (abs(cr(1)) > RQ(0.9, (period * 2), abs(cr(1))))) & ((LAG(1, cr(1)) * cr(1)) < 0)))) for period in PERIODS],
        *[(f"herding_decay_{period}min", EWM(2 / ((period // 2) + 1), RMEAN(period, (cr(1) > 0)))) for period in PERIODS],
        *[(f"consensus_momentum_{period}min", RMEAN(120, DIFF(1, RMEAN(period, (cr(1) > 0))))) for period in PERIODS],
        *[(f"heterogeneity_{period}min", RMEAN(241, (1 / (1 + (abs(cr(1)) / (((volume + EPS) / (vol_mean(period) + EPS)) + EPS)))))) for period in PERIODS],
        *[(f"herding_saturation_{period}min", RMEAN(period, (cr(1) > 0)) * (1 - (1 / ((volume / (vol_mean(period) + EPS)) + EPS)))) for period in PERIODS],
        *[(f"herding_reversal_{period}min", (DIFF(1, (RMEAN(period, (cr(1) > 0)) > 0.8)) * -1) + DIFF(1, (RMEAN(period, (cr(1) > 0)) < 0.2))) for period in [60, 241]],
        *[(f"collective_wisdom_{period}min", RMEAN(241, (LAG(period, RMEAN(period, (cr(1) > 0))) * cr(period)))) for period in PERIODS],
        *[(f"social_contagion_lag{lag}", RMEAN(241, ((FIN_ni(PCT(1, volume)) * LAG(lag, FIN_ni(PCT(1, volume)))) + (cr(1) * LAG(lag, cr(1)))))) for lag in [1, 5, 30]],
        *[(f"herding_immunity_{period}min", RMEAN(241, abs((RMEAN(period, (cr(1) > 0)) - (cr(1) > 0))))) for period in PERIODS],
        *[(f"learning_curve_{period}min", DIFF(1, RMEAN(period, abs(cr(1))))) for period in [5, 15, 60, 241]],
        ("info_asymmetry_proxy", (volume / (vol_mean(60) + EPS)) - 1),
        *[(f"price_clustering_{period}min", 1 / (1 + (cls_std(period) / (cls_mean(period) + EPS)))) for period in PERIODS],
        *[(f"herding_acceleration_{period}min", ((volume / (vol_mean(period) + EPS)) * abs(cr(1))) - ((FT(2, volume) / (FT(2, vol_mean(period)) + EPS)) * abs(FT(2, cr(1))))) for period in PERIODS],
        *[(f"social_learning_{period}min", abs((ret_std(period) - FT(2, ret_std(period))))) for period in PERIODS],
    ]


def microstructure() -> list[tuple[str, Expr]]:
    return [
        ("kyle_lambda", RMEAN(60, (abs(cr(1)) / (volume + 1)))),
        ("roll_effective_spread", sqrt(RMEAN(60, ((-2 * cr(1)) * LAG(1, cr(1)))))),
        ("amihud_illiquidity", RMEAN(60, (abs(cr(1)) / ((volume * close) + 1)))),
        *[(f"price_efficiency_{period}min", RMEAN(period, (abs((close - open)) / ((high - low) + EPS)))) for period in PERIODS],
        *[(f"price_impact_{period}min", abs(cr(period)) / ((RSUM(period, volume) / (vol_mean(241) + EPS)) + EPS)) for period in PERIODS],
        *[(f"liquidity_consumption_{period}min", RSUM(period, volume) / (RSUM(period, RMEAN((period * 4), volume)) + EPS)) for period in [5, 15, 60]],
        *[(f"order_flow_toxicity_{period}min", RSTD(period, (cr(1) * (volume / (vol_mean(60) + EPS))))) for period in [5, 15, 60, 241]],
        *[(f"info_content_{period}min", RMEAN(period, (abs(cr(1)) / (volume + 1)))) for period in [5, 15, 60, 241]],
        *[(f"micro_volatility_{period}min", RSTD(period, ((high - low) / (open + EPS)))) for period in [5, 15, 60, 241]],
        *[(f"market_resilience_{period}min", RMEAN(241, when(LAG(period, (abs(cr(1)) > RQ(0.9, 241, abs(cr(1))))), (cr(1) * LAG(period, cr(1))), 0))) for period in [5, 15, 60, 241]],
        *[(f"liquidity_risk_{period}min", RSTD(period, (volume / ((high - low) + EPS))) / (RMEAN(period, (volume / ((high - low) + EPS))) + EPS)) for period in PERIODS],
        ("price_efficiency_var", ret_var(60)),
        ("volatility_ratio", ret_var(60) / (ret_var(15) + EPS)),
        ("depth_adjusted_spread", ((high - low) / (close + EPS)) / ((volume / (vol_mean(60) + EPS)) + EPS)),
        *[(f"execution_risk_{period}min", ret_std(period) * (1 / ((volume / (vol_mean(period) + EPS)) + EPS))) for period in [5, 15, 60, 241]],
    ]


def sentiment_cycle() -> list[tuple[str, Expr]]:
    return [
        ("recency_bias", EWM(0.1, cr(1)) / (ret_mean(60) + EPS)),
        ("herd_behavior", RMEAN(30, ((volume > RQ(0.8, 241, volume)) & (abs(cr(1)) > RQ(0.8, 241, cr(1)))))),
        *[(f"sentiment_momentum_{period}min", RSUM(period, (volume * cr(1))) / period) for period in PERIODS],
        *[(f"cumulative_sentiment_{int(decay * 100)}", EWM((1 - decay), (cr(15) * volume))) for decay in [0.95, 0.98, 0.995]],
        *[(f"sentiment_dispersion_{period}min", RSTD(period, ((high - low) / (close + EPS)))) for period in PERIODS],
        *[(f"sentiment_persistence_{period}min", RSUM(period, (cr(1) > 0)) / period) for period in PERIODS],
        *[(f"sentiment_oscillation_{period}min", RSTD(period, (PCT(1, close) * volume)) / (RMEAN(period, abs((PCT(1, close) * volume))) + EPS)) for period in PERIODS],
        *[(f"sentiment_cyclical_{period}min", RMEAN(period, ((cr(1) * volume) * LAG((period // 2), (cr(1) * volume))))) for period in PERIODS],
        *[(f"sentiment_memory_{half_life}min", EWM((1 - math.exp(-math.log(2) / half_life)), (cr(1) * volume))) for half_life in PERIODS],
        *[(f"risk_appetite_{period}min", RSUM(period, when((cr(1) > 0), volume, 0)) / (RSUM(period, when((cr(1) < 0), volume, 0)) + EPS)) for period in PERIODS],
        ("bull_regime", (close > cls_mean(241)) & (cls_mean(60) > cls_mean(241))),
        ("bear_regime", (close < cls_mean(241)) & (cls_mean(60) < cls_mean(241))),
        ("consolidation_regime", ((cls_mean(60) / (cls_mean(241) + EPS)) > 0.95)),
        ("anchoring_bias", 1 - (close / (hi_max(241) + EPS))),
        *[(f"bull_bear_position_{period}min", (close - cls_min(period)) / ((cls_max(period) - cls_min(period)) + EPS)) for period in PERIODS],
        *[(f"fear_greed_{period}min", cr(period) / (ret_std(period) + EPS)) for period in PERIODS],
        *[(f"sc_sentiment_reversal_{period}min", (((cr(period) - FT(2, cr(period))) * cr(period)) < 0)) for period in PERIODS],
        *[(f"capitulation_{int(abs(threshold) * 100)}pct", (cr(60) < threshold) * (volume > (vol_mean(241) * 2))) for threshold in [-0.02, -0.04]],
        *[(f"euphoria_{int(threshold * 100)}pct", (cr(60) > threshold) * (volume > (vol_mean(241) * 2))) for threshold in [-0.02, -0.04]],
    ]


def attention() -> list[tuple[str, Expr]]:
    return [
        ("low_attention_regime", RMEAN(60, (volume < (vol_mean(15) * 0.8)))),
        ("high_attention_regime", RMEAN(60, (volume > (vol_mean(15) * 1.5)))),
        ("attention_inflow", FIN_u(RSUM(60, greatest(FIN_ni(PCT(1, volume)), 0.0)))),
        ("attention_outflow", FIN_u(RSUM(60, greatest(-FIN_ni(PCT(1, volume)), 0.0)))),
        ("net_attention_flow", FIN_u(RSUM(60, FIN_ni(PCT(1, volume))))),
        ("viral_attention", FIN_u(RSUM(120, when((FIN_ni(PCT(1, volume)) > 0), (FIN_ni(PCT(1, volume)) ** 2), 0.0)))),
        ("cascade_attention", FIN_u(RSUM(60, (FIN_ni(PCT(1, volume)) > 0.1)))),
        ("herd_attention", FIN_u(RMEAN(60, ((FIN_ni(PCT(1, volume)) * LAG(1, FIN_ni(PCT(1, volume)))) > 0)))),
        *[(f"trading_activity_{period}min", RSUM(period, volume) / (RSUM((period * 3), volume) + EPS)) for period in PERIODS],
        *[(f"attention_decay_hl{halflife}min", EWM(1 - math.exp(-math.log(2) / halflife), volume) / (RMEAN((halflife * 4), volume) + EPS)) for halflife in PERIODS],
        *[(f"attention_focus_{period}min", 1.0 / (1.0 + RSTD(period, ((high - low) / (close + EPS))))) for period in PERIODS],
        *[(f"attention_intensity_{period}min", RMEAN(period, (abs(cr(1)) * (volume / (vol_mean(period) + EPS))))) for period in PERIODS],
        *[(f"information_shock_{period}min", RSUM(60, (((volume / (vol_mean(period) + EPS)) > 2) & (abs(cr(1)) > (RMEAN(period, abs(cr(1))) * 2))))) for period in PERIODS],
        *[(f"attention_persistence_{period}min", RSUM(period, (volume > (vol_mean(period) * 1.5)))) for period in PERIODS],
        *[(f"attention_saturation_{period}min", RMEAN(60, (volume >= RQ(0.9, period, volume)))) for period in PERIODS],
        *[(f"attention_momentum_{period}min", RMEAN(period, FIN_ni(PCT(1, volume)))) for period in PERIODS],
        *[(f"attention_volatility_{period}min", RSTD(period, (volume / (vol_mean(period) + EPS)))) for period in PERIODS],
        *[(f"social_attention_{period}min", RCORR(period, cr(1), FIN_i(PCT(1, volume)))) for period in PERIODS],
        *[(f"attention_reflow_{period}min", RSUM(period, (LAG(1, (volume < (vol_mean(period) * 0.7))) & (volume > (vol_mean(period) * 1.3))))) for period in PERIODS],
        *[(f"attention_dispersion_{period}min", RSTD(period, (volume / (((high - low) / (close + EPS)) + EPS)))) for period in PERIODS],
        *[(f"anticipated_attention_{period}min", RMEAN(period, FIN_u(DIFF(1, FIN_ni(PCT(1, volume)))))) for period in PERIODS],
        *[(f"attention_echo_lag{lag}min", RSUM(120, (LAG(lag, (volume > (vol_mean(15) * 2))) & (volume > (vol_mean(15) * 1.5))))) for lag in PERIODS],
        *[(f"attention_fatigue_{period}min", DIFF(1, RMEAN(period, ((volume / (vol_mean(period) + EPS)) / (abs(cr(1)) + EPS))))) for period in PERIODS],
        *[(f"attention_contagion_{period}min", FIN_u(RMEAN(period, (FIN_ni(PCT(1, volume)) * LAG(1, FIN_ni(PCT(1, volume))))))) for period in PERIODS],
        *[(f"attention_quality_{period}min", (1.0 / (1.0 + RSTD(period, (high - low)))) * (1.0 / (1.0 + (vol_std(period) / (vol_mean(period) + EPS))))) for period in PERIODS],
        ("volatile_attention_regime", vol_std(15) / (vol_mean(15) + EPS)),
        *[(f"price_memory_lag{lag}min", cr(1) * cr(lag)) for lag in PERIODS],
        *[(f"abnormal_attention_{period}min", (volume - vol_mean(period)) / (vol_std(period) + EPS)) for period in PERIODS],
        *[(f"price_newsworthiness_{period}min", eq(close, cls_max(period)) + eq(close, cls_min(period))) for period in PERIODS],
        *[(f"event_driven_{int(threshold * 10)}x", ((volume / (vol_mean(15) + EPS)) > threshold)) for threshold in [2, 3, 4]],
        *[(f"attention_shift_{period}min", FIN_ni(PCT(period, volume)) / (abs(cr(period)) + EPS)) for period in PERIODS],
        *[(f"focal_moments_{period}min", (eq(close, cls_max(period)) | eq(close, cls_min(period))) * (volume / (vol_mean(period) + EPS))) for period in PERIODS],
        *[(f"surprise_factor_{period}min", abs((close - cls_mean(period))) / (cls_mean(period) + EPS)) for period in PERIODS],
        *[(f"breaking_attention_{period}min", (volume > (vol_mean(period) + (vol_std(period) * 3)))) for period in PERIODS],
    ]


FAMILIES = {"round_number": round_number, "fomo_fud": fomo_fud, "retail_pattern": retail_pattern, "herding": herding, "microstructure": microstructure, "sentiment_cycle": sentiment_cycle, "attention": attention}


def features(families=tuple(FAMILIES), median: float = 50.0, rows: int | None = None) -> dict[str, Expr]:
    """Features of some families by name, for codes of at most so many rows (None: any number; TAILS: for tail_values);
    the first definition of a name wins."""
    out: dict[str, Expr] = {}
    was = _ROWS.set(rows or 0)
    try:
        for f in families:
            for name, e in FAMILIES[f](*levels(median)) if f == "round_number" else FAMILIES[f]():
                out.setdefault(name, as_expr(e))
    finally:
        _ROWS.reset(was)
    return out
