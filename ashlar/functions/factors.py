"""Predefined factors, as expressions."""

from __future__ import annotations

import math

from ..operators.nodes import EMA, Abs, Close, High, Log, Low, Max, Maximum, Mean, Min, Minimum, Ref, Returns, Sqrt, Std, Volume
from ..plans.expr import Expr

TINY, DAYS_A_YEAR = 1e-10, 252


def RSI(window: int = 14) -> Expr:
    change = Close() - Ref(Close(), 1)
    return 100 - 100 / (1 + Mean(Maximum(change, 0), window) / (Mean(Abs(Minimum(change, 0)), window) + TINY))


def MACD(fast: int = 12, slow: int = 26, signal: int = 9) -> dict[str, Expr]:
    macd = EMA(Close(), fast) - EMA(Close(), slow)
    return {"macd": macd, "signal": EMA(macd, signal), "histogram": macd - EMA(macd, signal)}


def Momentum(window: int = 20) -> Expr: return Close() / Ref(Close(), window) - 1
def RateOfChange(window: int = 10) -> Expr: return (Close() - Ref(Close(), window)) / Ref(Close(), window) * 100
def PriceToVolume(window: int = 20) -> Expr: return Close() / Mean(Volume(), window)
def VolumeRatio(short: int = 5, long: int = 20) -> Expr: return Mean(Volume(), short) / Mean(Volume(), long)
def AmihudIlliquidity(window: int = 20) -> Expr: return Mean(Abs(Returns()) / (Close() * Volume() + TINY), window)
def RelativeVolume(window: int = 20) -> Expr: return Volume() / Mean(Volume(), window)


def ATR(window: int = 14) -> Expr:
    before = Ref(Close(), 1)
    return Mean(Maximum(Maximum(High() - Low(), Abs(High() - before)), Abs(Low() - before)), window)


def BollingerBands(window: int = 20, deviations: float = 2) -> dict[str, Expr]:
    middle, band = Mean(Close(), window), deviations * Std(Close(), window)
    return {"upper": middle + band, "middle": middle, "lower": middle - band, "width": ((middle + band) - (middle - band)) / middle}


def HistoricalVolatility(window: int = 20) -> Expr: return Std(Returns(), window) * math.sqrt(DAYS_A_YEAR)
def ParkinsonVolatility(window: int = 20) -> Expr: return Sqrt(Mean(Log(High() / Low()) ** 2 / (4 * 0.693147), window)) * math.sqrt(DAYS_A_YEAR)
def PriceToMA(window: int = 20) -> Expr: return Close() / Mean(Close(), window)
def PercentFromHigh(window: int = 252) -> Expr: return (Max(Close(), window) - Close()) / Max(Close(), window)
def PriceRange(window: int = 20) -> Expr: return (Close() - Min(Low(), window)) / (Max(High(), window) - Min(Low(), window) + TINY)


#: Every factor with its default parameters; those with several outputs give a column each.
LIBRARY: dict[str, Expr] = {
    "rsi": RSI(), **{f"macd_{k}": e for k, e in MACD().items()}, "momentum": Momentum(), "rate_of_change": RateOfChange(), "price_to_volume": PriceToVolume(),
    "volume_ratio": VolumeRatio(), "amihud": AmihudIlliquidity(), "relative_volume": RelativeVolume(), "atr": ATR(), **{f"bollinger_{k}": e for k, e in BollingerBands().items()},
    "historical_volatility": HistoricalVolatility(), "parkinson": ParkinsonVolatility(), "price_to_ma": PriceToMA(), "percent_from_high": PercentFromHigh(), "price_range": PriceRange(),
}
