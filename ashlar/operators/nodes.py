"""The nodes factors are written with. Time-series nodes look back over a code's rows, cross-sectional ones over a date's codes."""

from __future__ import annotations

from ..plans.expr import Expr, as_expr, const, ema, field, node

#: Seconds of a step back in time.
STEP = {"daily": 86_400, "hour": 3_600, "30min": 1_800, "5min": 300, "minute": 60, "week": 604_800}


# columns and constants
def AtomicData(name: str) -> Expr: return field(name)
def Close() -> Expr: return field("close")
def Open() -> Expr: return field("open")
def High() -> Expr: return field("high")
def Low() -> Expr: return field("low")
def Volume() -> Expr: return field("volume")
def Amount() -> Expr: return field("amount")
def Constant(value: float) -> Expr: return const(value)


# arithmetic
def Add(a, b) -> Expr: return node("add", a, b)
def Sub(a, b) -> Expr: return node("sub", a, b)
def Mul(a, b) -> Expr: return node("mul", a, b)
def Div(a, b) -> Expr: return node("div", a, b)
def Pow(a, b) -> Expr: return node("pow", a, b)
def Abs(a) -> Expr: return node("abs", a)
def Log(a) -> Expr: return node("log", a)
def Sqrt(a) -> Expr: return node("sqrt0", a)
def Neg(a) -> Expr: return node("neg", a)
def Sign(a) -> Expr: return node("sign", a)
def Maximum(a, b) -> Expr: return node("max", a, b)
def Minimum(a, b) -> Expr: return node("min", a, b)


def Clip(a, lower=None, upper=None) -> Expr:
    a = as_expr(a)
    a = a if lower is None else Maximum(a, lower)
    return a if upper is None else Minimum(a, upper)


# conditions: a missing side makes a comparison false; a missing condition is true
def Greater(a, b) -> Expr: return node("fill", node("gt", a, b), 0)
def Less(a, b) -> Expr: return node("fill", node("lt", a, b), 0)
def Equal(a, b) -> Expr: return node("fill", node("eq", a, b), 0)
def IfElse(condition, a, b) -> Expr: return node("if", node("fill", condition, 1), a, b)


# time series: the last rows up to now, fewer at the start
def Mean(x, window: int = 20) -> Expr: return node("part", x, params=("mean", window))
def Sum(x, window: int = 20) -> Expr: return node("fill", node("part", x, params=("sum", window)), 0)
def Max(x, window: int = 20) -> Expr: return node("part", x, params=("max", window))
def Min(x, window: int = 20) -> Expr: return node("part", x, params=("min", window))
def EMA(x, window: int = 20) -> Expr: return ema(window, x)


Tsmax, Tsmin = Max, Min


def Std(x, window: int = 20) -> Expr:
    """Sample deviation; 0 over a single row."""
    return node("if", node("le", node("rows", params=(window,)), 1), 0, node("part", x, params=("std", window)))


def Ref(x, periods: int, freq: str = "daily") -> Expr:
    """The last value at or before this time less so many steps; ``freq="rows"`` counts rows instead."""
    return node("lag", x, params=(periods,)) if freq == "rows" else node("ref", x, params=(periods * STEP[freq],))


def Delta(x, periods: int = 1, freq: str = "daily") -> Expr: return as_expr(x) - Ref(x, periods, freq)


def Returns(periods: int = 1, freq: str = "daily") -> Expr: return (Close() - Ref(Close(), periods, freq)) / Ref(Close(), periods, freq)


def TsRank(x, window: int = 20, freq: str = "daily") -> Expr:
    """Share of the window's values below the current one, ties counting half; 0.5 over a single value."""
    x = as_expr(x)
    past = [x, *(Ref(x, k, freq) for k in range(1, window))]
    less, same, n = const(0), const(0), const(0)
    for p in past:
        less, same, n = less + node("fill", p < x, 0), same + node("fill", node("eq", p, x), 0), n + node("known", p)
    return node("if", node("le", n, 1), node("if", node("known", x), 0.5, const(float("nan"))), (less + 0.5 * same) / n)


# cross-sections: missing values stay missing and aren't counted
def _section(kind: str, x, *more) -> Expr: return node("section", x, params=(kind, *more))


def Rank(x, ascending: bool = True, method: str = "average") -> Expr:
    """(rank - 1) / (n - 1); 0.5 for a single value."""
    n = _section("count", x)
    return node("if", node("le", n, 1), node("if", node("known", x), 0.5, const(float("nan"))), (node("rank", x, params=(method, ascending)) - 1) / (n - 1))


def Zscore(x, robust: bool = False) -> Expr:
    """(x - mean) / deviation, or (x - median) / median distance; 0 where that is 0 or n is 1."""
    x = as_expr(x)
    middle = _section("quantile", x, 0.5) if robust else _section("mean", x)
    spread = _section("quantile", abs(x - middle), 0.5) if robust else _section("std", x)
    flat = node("or", node("eq", node("fill", spread, 0), 0), node("le", _section("count", x), 1))
    return node("if", node("known", x), node("if", flat, 0, (x - middle) / spread), const(float("nan")))


def Quantile(x, n_quantiles: int = 5, labels: bool = False) -> Expr:
    """Label by quantile edges, 0 to 1 or 1 to q; with equal edges 0.5 (or 1) for all."""
    x = as_expr(x)
    edges = [_section("quantile", x, k / n_quantiles) for k in range(n_quantiles + 1)]
    label, distinct = const(0), const(1)
    for e in edges[1:-1]:
        label = label + (x > e)
    for a, b in zip(edges, edges[1:], strict=False):
        distinct = distinct * (a < b)
    out = label + 1 if labels else label / max(1, n_quantiles - 1)
    return node("if", node("known", x), node("if", distinct, out, 1 if labels else 0.5), const(float("nan")))


def Winsorize(x, lower: float = 0.05, upper: float = 0.95) -> Expr:
    return Clip(x, _section("quantile", x, lower), _section("quantile", x, upper))


def Neutralize(x, benchmark) -> Expr:
    """Residual of least squares on the benchmark; x itself with fewer than two pairs, x - mean for a constant benchmark."""
    x, b = as_expr(x), as_expr(benchmark)
    blank = const(float("nan"))
    y, z = node("if", node("known", b), x, blank), node("if", node("known", x), b, blank)
    slope = node("section_cov", y, z) / (_section("std", z) ** 2)
    fit = _section("mean", y) + node("fill", slope, 0) * (b - _section("mean", z))
    return node("if", node("lt", _section("count", y + z), 2), x, x - fit)


def Scale(x, target_sum: float | None = None, target_range: tuple[float, float] | None = None) -> Expr:
    """To a sum, to a range (constant: its middle), or to shares of the sum (sum 0: 1/n)."""
    x = as_expr(x)
    if target_range is not None:
        a, b = target_range
        low, high = _section("min", x), _section("max", x)
        return node("if", node("eq", low, high), node("if", node("known", x), (a + b) / 2, const(float("nan"))), a + (x - low) / (high - low) * (b - a))
    total = _section("sum", x)
    if target_sum is not None:
        return x * target_sum / total
    return node("if", node("eq", total, 0), 1 / _section("count", x), x / total)
