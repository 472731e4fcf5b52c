"""Factor expressions: trees over a panel that compile to staged column expressions.

A panel has a row per (datetime, code). Scalar nodes become part of the expression around them; window
nodes are staged as columns, equal ones once, so that each nesting level is one projection over windows of
one partitioning. Missing values are NULL, never NaN, and division by zero is NULL. The same tree renders
as SQL text for Spark or DuckDB.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPARK, DUCKDB = "spark", "duckdb"
#: Height of scalar text that becomes a column of its own.
TALL = 4
SERIES = "partition by code order by datetime"
SECTION = "partition by datetime"


@dataclass(frozen=True, eq=False)
class Expr:
    """A node: an operation, its operands and its parameters."""

    op: str
    args: tuple[Expr, ...] = ()
    params: tuple = ()

    def __add__(self, o): return node("add", self, o)
    def __radd__(self, o): return node("add", o, self)
    def __sub__(self, o): return node("sub", self, o)
    def __rsub__(self, o): return node("sub", o, self)
    def __mul__(self, o): return node("mul", self, o)
    def __rmul__(self, o): return node("mul", o, self)
    def __truediv__(self, o): return node("div", self, o)
    def __rtruediv__(self, o): return node("div", o, self)
    def __mod__(self, o): return node("mod", self, o)
    def __pow__(self, o): return node("pow", self, o)
    def __rpow__(self, o): return node("pow", o, self)
    def __neg__(self): return node("neg", self)
    def __abs__(self): return node("abs", self)
    def __lt__(self, o): return node("lt", self, o)
    def __le__(self, o): return node("le", self, o)
    def __gt__(self, o): return node("gt", self, o)
    def __ge__(self, o): return node("ge", self, o)
    def __and__(self, o): return node("and", self, o)
    def __or__(self, o): return node("or", self, o)

    @property
    def key(self) -> str:
        """A digest of the tree; equal trees have equal keys."""
        found = self.__dict__.get("_key")
        if found is None:
            found = hashlib.md5(json.dumps([self.op, list(self.params), [a.key for a in self.args]]).encode()).hexdigest()
            object.__setattr__(self, "_key", found)
        return found

    @property
    def alias(self) -> str:
        """Column name of the staged node."""
        return "x" + self.key[:16]

    @property
    def windowed(self) -> bool:
        return self.op in WINDOWS

    @property
    def depth(self) -> int:
        found = self.__dict__.get("_depth")
        if found is None:
            found = max([0, *(a.depth for a in self.args)]) + self.windowed
            object.__setattr__(self, "_depth", found)
        return found

    @property
    def place(self) -> tuple[int, int]:
        """The stage after which the node's value is known, and the height of the text that gives it.

        Window nodes and every TALL-th scalar node on the way up are staged: parsers take long over deeply
        nested text.
        """
        found = self.__dict__.get("_place")
        if found is None:
            stage = max([0, *(a.place[0] for a in self.args)])
            height = 1 + max([0, *(a.place[1] for a in self.args)]) if self.args else 0
            found = (stage + 1, 0) if self.windowed or height >= TALL else (stage, height)
            object.__setattr__(self, "_place", found)
        return found

    @property
    def staged(self) -> bool:
        return self.windowed or (bool(self.args) and self.place[1] == 0)

    def walk(self) -> Iterable[Expr]:
        """Every distinct node, operands first."""
        seen: set[str] = set()

        def visit(e: Expr):
            if e.key in seen:
                return
            seen.add(e.key)
            for a in e.args:
                yield from visit(a)
            yield e

        yield from visit(self)

    def fields(self) -> list[str]:
        """Panel columns that the tree reads."""
        return sorted({e.params[0] for e in self.walk() if e.op == "field"})

    def to_dict(self) -> dict:
        return {"op": self.op, "params": list(self.params), "args": [a.to_dict() for a in self.args]}

    @staticmethod
    def from_dict(d: dict) -> Expr:
        return Expr(d["op"], tuple(Expr.from_dict(a) for a in d["args"]), tuple(d["params"]))

    def __str__(self) -> str:
        if self.op == "field":
            return str(self.params[0])
        if self.op == "const":
            return repr(self.params[0])
        return f"{self.op}({', '.join([*map(str, self.args), *map(repr, self.params)])})"


def as_expr(x) -> Expr:
    return x if isinstance(x, Expr) else const(x)


def node(op: str, *args, params: tuple = ()) -> Expr:
    return Expr(op, tuple(as_expr(a) for a in args), tuple(params))


def field(name: str) -> Expr:
    return Expr("field", (), (name,))


def const(value: float) -> Expr:
    return Expr("const", (), (float(value),))


def _both(a: str, b: str, x: str) -> str:
    return f"(case when {a} is null or {b} is null then null else {x} end)"


def _number(x: float) -> str:
    return f"cast({x!r} as double)" if math.isfinite(x) else "cast(null as double)"


#: Scalar operations: operand texts and parameters to text.
SCALARS = {
    "add": lambda a, p: f"({a[0]} + {a[1]})",
    "sub": lambda a, p: f"({a[0]} - {a[1]})",
    "mul": lambda a, p: f"({a[0]} * {a[1]})",
    "div": lambda a, p: f"({a[0]} / nullif({a[1]}, 0))",
    "mod": lambda a, p: f"({a[0]} - {a[1]} * floor({a[0]} / nullif({a[1]}, 0)))",
    "pow": lambda a, p: f"power({a[0]}, {a[1]})",
    "neg": lambda a, p: f"(-{a[0]})",
    "abs": lambda a, p: f"abs({a[0]})",
    "sign": lambda a, p: f"cast(sign({a[0]}) as double)",
    "log": lambda a, p: f"(case when {a[0]} > 0 then ln({a[0]}) end)",
    "log1p": lambda a, p: f"(case when {a[0]} > -1 then ln(1 + {a[0]}) end)",
    "exp": lambda a, p: f"exp({a[0]})",
    "sqrt": lambda a, p: f"(case when {a[0]} >= 0 then sqrt({a[0]}) end)",
    "sqrt0": lambda a, p: f"(case when {a[0]} is null then null when {a[0]} > 0 then sqrt({a[0]}) else cast(0 as double) end)",
    "max": lambda a, p: _both(a[0], a[1], f"greatest({a[0]}, {a[1]})"),
    "min": lambda a, p: _both(a[0], a[1], f"least({a[0]}, {a[1]})"),
    "lt": lambda a, p: f"cast({a[0]} < {a[1]} as double)",
    "le": lambda a, p: f"cast({a[0]} <= {a[1]} as double)",
    "gt": lambda a, p: f"cast({a[0]} > {a[1]} as double)",
    "ge": lambda a, p: f"cast({a[0]} >= {a[1]} as double)",
    "eq": lambda a, p: f"cast({a[0]} = {a[1]} as double)",
    "ne": lambda a, p: f"cast({a[0]} <> {a[1]} as double)",
    "and": lambda a, p: f"cast({a[0]} <> 0 and {a[1]} <> 0 as double)",
    "or": lambda a, p: f"cast({a[0]} <> 0 or {a[1]} <> 0 as double)",
    "if": lambda a, p: f"(case when {a[0]} <> 0 then {a[1]} else {a[2]} end)",
    "fill": lambda a, p: f"coalesce({a[0]}, {a[1]})",
    "known": lambda a, p: f"cast({a[0]} is not null as double)",
    "round": lambda a, p: f"round({a[0]}, {p[0]})",
}


def _frame_of(rows: int | None) -> str:
    return f"over ({SERIES} rows between {'unbounded' if rows is None else rows - 1} preceding and current row)"


AGGREGATES = {"mean": "avg", "sum": "sum", "std": "stddev_samp", "pstd": "stddev_pop", "var": "var_samp", "max": "max", "min": "min", "count": "count"}


def _part(a, p, d):
    return f"{AGGREGATES[p[0]]}({a[0]}) {_frame_of(p[1])}"


def _list(a, p, d):
    """The frame's known values in time order, as an array."""
    return f"collect_list({a[0]}) {_frame_of(p[0])}" if d == SPARK else f"list({a[0]}) filter (where {a[0]} is not null) {_frame_of(p[0])}"


def _fold(a: str, first: str, step: str, d: str) -> str:
    """Fold a list from its first value on; first and step are texts of the value v and the state s."""
    if d == SPARK:
        return f"aggregate({a}, cast(null as double), (s, v) -> case when s is null then {first} else {step} end)"
    return f"list_reduce({a}, lambda s, v: {step})"


def _number_of(x: float, d: str) -> str:
    return f"{x!r}D" if d == SPARK else f"cast({x!r} as double)"


def _pick(a, p, d):
    """The p-th smallest value of a list."""
    return f"element_at(sort_array({a[0]}), {p[0]})" if d == SPARK else f"list_sort({a[0]})[{p[0]}]"


def _list_ema(a, p, d):
    k = 2.0 / (p[0] + 1)
    return _fold(a[0], "v", f"{_number_of(k, d)} * v + {_number_of(1 - k, d)} * s", d)


def _list_ewm(a, p, d):
    keep = _number_of(1 - p[0], d)
    size = f"size({a[0]})" if d == SPARK else f"len({a[0]})"
    return f"({_fold(a[0], 'v', f's * {keep} + v', d)} / nullif((1 - power({keep}, {size})) / (1 - {keep}), 0))"


#: Scalar operations on staged arrays, whose text differs by dialect.
LISTS = {"pick": _pick, "list_ema": _list_ema, "list_ewm": _list_ewm}


def blank() -> Expr:
    return const(float("nan"))


def full(n: int, value: Expr, *given) -> Expr:
    """A value that is null unless all given operands are known in all of the last n rows."""
    known = as_expr(given[0])
    for g in given[1:]:
        known = known + g
    return node("if", node("eq", node("part", known, params=("count", n)), n), value, blank())


def rolling(kind: str, n: int, x) -> Expr:
    return full(n, node("part", x, params=(kind, n)), x)


def rolling_corr(n: int, x, y) -> Expr:
    """Pearson correlation over full windows; null without variance."""
    x, y = as_expr(x), as_expr(y)
    a, b = node("if", node("known", y), x, blank()), node("if", node("known", x), y, blank())
    spread = node("part", a, params=("std", n)) * node("part", b, params=("std", n))
    return full(n, node("covar", x, y, params=(n,)) / spread, x, y)


def rolling_skew(n: int, x) -> Expr:
    """Population skewness over full windows, from moments; null without variance."""
    x = as_expr(x)
    m1, m2, m3 = (node("part", e, params=("mean", n)) for e in (x, x * x, x * x * x))
    var = m2 - m1 * m1
    return full(n, node("if", var > 1e-18, (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / (var * node("sqrt", var)), blank()), x)


def rolling_quantile(q: float, n: int, x) -> Expr:
    """The nearest value to a quantile over full windows."""
    return full(n, node("pick", node("list", x, params=(n,)), params=(math.floor(q * (n - 1) + 0.5) + 1,)), x)


def ema(window: int, x) -> Expr:
    """Exponential mean over the last 2 * window rows, seeded with the first of them."""
    return node("list_ema", node("list", x, params=(2 * window,)), params=(window,))


def ewm_rows(alpha: float) -> int:
    """Rows after which a weight is under 1e-17."""
    return math.ceil(-39.2 / math.log1p(-alpha)) if alpha < 1 else 1


#: Stands for a number of rows: exponential means stay nodes of their own (see tails).
TAILS = -1
#: Rows of a code for which running weights can't overflow, by the logarithm of the largest.
MOST_LOG_WEIGHT = 600.0


def ewm(alpha: float, x, rows: int | None = None) -> Expr:
    """Exponentially weighted mean of all rows so far.

    Codes of at most so many rows can use running sums of growing weights, in linear time. With rows = 0 any
    number will do: the weights start anew with each block of rows, and the block before is added with what is
    left of its weight, since older ones count for less than 1e-17. Otherwise the weights that count are folded.
    """
    if rows == TAILS and ewm_rows(alpha) > 64:
        return node("ewm", x, params=(alpha,))
    if rows == 0 and ewm_rows(alpha) > 64:
        x, size = as_expr(x), ewm_rows(alpha)
        row = node("rows", params=(None,)) - 1
        block = (row - row % size) / size
        weight = node("pow", 1 / (1 - alpha), row % size)

        def total(e: Expr) -> Expr:
            return node("fill", node("block", e, block), 0) + node("fill", node("block_before", e, block), 0) * (1 - alpha) ** size

        return total(x * weight) / total(node("if", node("known", x), weight, blank()))
    if rows is not None and -math.log1p(-alpha) * rows < MOST_LOG_WEIGHT and ewm_rows(alpha) > 64:
        x = as_expr(x)
        weight = node("pow", 1 / (1 - alpha), node("rows", params=(None,)))
        weights = node("if", node("known", x), weight, blank())
        return node("part", x * weight, params=("sum", None)) / node("part", weights, params=("sum", None))
    return node("list_ewm", node("list", x, params=(ewm_rows(alpha),)), params=(alpha,))


def _ref(a, p, d):
    seconds = "unix_seconds(cast(datetime as timestamp))" if d == SPARK else "cast(epoch(datetime) as bigint)"
    return f"last_value({a[0]}) ignore nulls over (partition by code order by {seconds} range between unbounded preceding and {int(p[0])} preceding)" if d == SPARK else f"last_value({a[0]} ignore nulls) over (partition by code order by {seconds} range between unbounded preceding and {int(p[0])} preceding)"


def _tail_first(a, p, d):
    k = p[0]
    return f"(case when row_number() over ({SERIES}) < {k} then first_value({a[0]}) over ({SERIES} rows between unbounded preceding and current row) else lag({a[0]}, {k - 1}) over ({SERIES}) end)"


def _rank(a, p, d):
    """Rank among the section's values: average, min, max, first or dense."""
    method, ascending = p
    part = f"partition by datetime, {a[0]} is null"
    order = f"order by {a[0]} {'asc' if ascending else 'desc'}"
    ties = f"count(*) over ({part}, {a[0]})"
    text = {
        "average": f"rank() over ({part} {order}) + ({ties} - 1) / cast(2 as double)",
        "min": f"rank() over ({part} {order})",
        "max": f"rank() over ({part} {order}) + {ties} - 1",
        "first": f"row_number() over ({part} {order}, code)",
        "dense": f"dense_rank() over ({part} {order})",
    }[method]
    return f"(case when {a[0]} is not null then cast({text} as double) end)"


def _section_of(d: str) -> str:
    """The section of a row. Spark adds its rows up in the order of codes, so that equal sections have equal sums to the last bit however rows come."""
    return f"{SECTION} order by code rows between unbounded preceding and unbounded following" if d == SPARK else SECTION


def _section(a, p, d):
    kind = p[0]
    if kind == "quantile":
        return f"{'percentile' if d == SPARK else 'quantile_cont'}({a[0]}, {p[1]!r}) over ({_section_of(d)})"
    return f"{AGGREGATES[kind]}({a[0]}) over ({_section_of(d)})"


def _section_cov(a, p, d):
    return f"covar_samp({a[0]}, {a[1]}) over ({_section_of(d)})"


#: Window operations: operand texts, parameters and dialect to text.
WINDOWS = {
    "part": _part, "list": _list, "ref": _ref,
    "covar": lambda a, p, d: f"covar_samp({a[0]}, {a[1]}) {_frame_of(p[0])}",
    "lag": lambda a, p, d: f"lag({a[0]}, {p[0]}) over ({SERIES})",
    "lead": lambda a, p, d: f"lead({a[0]}, {p[0]}) over ({SERIES})",
    "block": lambda a, p, d: f"sum({a[0]}) over (partition by code, {a[1]} order by datetime rows between unbounded preceding and current row)",
    "block_before": lambda a, p, d: f"sum({a[0]}) over (partition by code order by {a[1]} range between 1 preceding and 1 preceding)",
    "rows": lambda a, p, d: f"count(*) {_frame_of(p[0])}",
    "first": _tail_first, "rank": _rank, "section": _section, "section_cov": _section_cov,
}


def render(e: Expr, dialect: str) -> str:
    """Text of a node; staged nodes are named columns."""
    return e.alias if e.staged else _inline(e, dialect)


def _inline(e: Expr, dialect: str) -> str:
    if e.op == "field":
        return f"cast({e.params[0]} as double)"
    if e.op == "const":
        return _number(e.params[0])
    a = [render(x, dialect) for x in e.args]
    if e.op in LISTS:
        return LISTS[e.op](a, e.params, dialect)
    return WINDOWS[e.op](a, e.params, dialect) if e.windowed else SCALARS[e.op](a, e.params)


def stages(exprs: Iterable[Expr], dialect: str) -> list[dict[str, str]]:
    """Per stage, the columns to add."""
    found: dict[int, dict[str, str]] = {}
    for root in exprs:
        for e in root.walk():
            if e.staged:
                found.setdefault(e.place[0], {})[e.alias] = _inline(e, dialect)
    return [found[k] for k in sorted(found)]


def with_factors(panel: DataFrame, factors: dict[str, Expr], keep: tuple[str, ...] = ("datetime", "code")) -> DataFrame:
    """The panel's keys and a column per factor."""
    for level in stages(factors.values(), SPARK):
        panel = panel.select("*", *[F.expr(text).alias(name) for name, text in level.items()])
    return panel.select(*keep, *[F.expr(render(e, SPARK)).alias(name) for name, e in factors.items()])


def factors_sql(panel: str, factors: dict[str, Expr], keep: tuple[str, ...] = ("datetime", "code"), tail: str = "", wrap=lambda name, text: text) -> str:
    """The same as DuckDB SQL over a query for the panel."""
    levels, last = [f"p0 as ({panel})"], "p0"
    for k, level in enumerate(stages(factors.values(), DUCKDB), 1):
        levels.append(f"p{k} as (select *, {', '.join(f'{text} as {name}' for name, text in level.items())} from {last})")
        last = f"p{k}"
    columns = ", ".join([*keep, *(f"{wrap(name, render(e, DUCKDB))} as \"{name}\"" for name, e in factors.items())])
    return f"with {', '.join(levels)} select {columns} from {last} {tail}"
