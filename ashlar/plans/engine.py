"""Configuration, trading calendar, and the factor engine."""

from __future__ import annotations

import math
import statistics
import time
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.readers import MINUTES, read_bars
from .expr import Expr, stages, with_factors
from .expr import SPARK as _SPARK

#: Frequencies from fine to coarse.
FREQUENCIES = ("minute", "5min", "30min", "hour", "daily", "week", "month")
SESSIONS = (("09:30", "11:30"), ("13:00", "15:00"))


def in_session(ts: Column) -> Column:
    """Weekday and within a session, ends included."""
    clock = F.date_format(ts, "HH:mm")
    return (F.weekday(ts) < 5) & (clock.between(*SESSIONS[0]) | clock.between(*SESSIONS[1]))


@dataclass(frozen=True)
class FrequencyConfig:
    input_freq: str = "daily"
    window_length: int = 20
    calc_freq: str | None = None
    timezone: str = "Asia/Shanghai"

    def __post_init__(self):
        calc = self.calc_freq or self.input_freq
        object.__setattr__(self, "calc_freq", calc)
        for f in (self.input_freq, calc):
            if f not in FREQUENCIES:
                raise ValueError(f"unknown frequency {f}")
        if self.window_length <= 0:
            raise ValueError("window_length must be positive")
        if FREQUENCIES.index(calc) < FREQUENCIES.index(self.input_freq):
            raise ValueError("calc_freq is finer than input_freq")

    def buffer_days(self) -> int:
        """Days before the start that windows look back on."""
        rows = 2 * self.window_length
        return {"daily": rows, "minute": max(1, rows // 360), "30min": max(1, rows // 12)}.get(self.input_freq, 30)

    def to_dict(self) -> dict:
        return {"input_freq": self.input_freq, "window_length": self.window_length, "calc_freq": self.calc_freq}


def daily() -> FrequencyConfig: return FrequencyConfig("daily", 20)
def minute() -> FrequencyConfig: return FrequencyConfig("minute", 30, "5min")
def high_frequency() -> FrequencyConfig: return FrequencyConfig("minute", 60)
def intraday() -> FrequencyConfig: return FrequencyConfig("30min", 10)


def calendar(spark: SparkSession, start: str, end: str, freq: str = "daily") -> DataFrame:
    """Trading times (datetime): weekdays at 15:00, or the sessions' grid, ends included."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("d")).where(F.weekday("d") < 5)
    at = lambda clock: F.to_timestamp_ntz(F.concat_ws(" ", F.col("d").cast("string"), F.lit(f"{clock}:00")))
    if freq not in MINUTES:
        return days.select(at("15:00").alias("datetime"))
    grid = F.concat(*[F.sequence(at(a), at(b), F.expr(f"interval {MINUTES[freq]} minutes")) for a, b in SESSIONS])
    return days.select(F.explode(grid).alias("datetime"))


def as_of(panel: DataFrame, times: DataFrame, columns: list[str]) -> DataFrame:
    """Per code and time of a calendar, the last known values at or before it. Times after the panel's end are left out.

    Panel rows and asked times of a code are one sorted stream, so the work is one window per code.
    """
    codes = panel.groupBy("code").agg(F.count("*").alias("_n")).select("code")
    last = panel.agg(F.max("datetime").alias("_end"))
    asked = times.join(F.broadcast(last), F.col("datetime").cast("date") <= F.col("_end").cast("date")).select("datetime").crossJoin(codes)  # the result has these rows: one per time and code
    rows = panel.select("datetime", "code", *columns, F.lit(0).alias("_asked")).unionByName(asked.select("datetime", "code", F.lit(1).alias("_asked")), allowMissingColumns=True)
    w = Window.partitionBy("code").orderBy("datetime", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("datetime", "code", "_asked", *[F.last(c, True).over(w).alias(c) for c in columns]).where("_asked = 1").drop("_asked")


def align_timestamps(panel: DataFrame, times: DataFrame) -> DataFrame:
    """Reindex each code on a calendar, carrying values forward."""
    return as_of(panel, times, [c for c in panel.columns if c not in ("datetime", "code")])


def validation_report(panel: DataFrame, required: tuple[str, ...] = ("datetime", "code", "close")) -> DataFrame:
    """One row: number of rows, missing columns, duplicate keys and nulls per column."""
    missing = [c for c in required if c not in panel.columns]
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in panel.columns]
    keys = panel.groupBy("datetime", "code").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    return panel.agg(F.count("*").alias("rows"), F.min("datetime").alias("first"), F.max("datetime").alias("last"), *nulls).crossJoin(keys).withColumn("missing_columns", F.array(*[F.lit(c) for c in missing]).cast("array<string>"))


def compare_factors(panel: DataFrame, a: Expr, b: Expr) -> DataFrame:
    """One row: correlation, mean, deviation and largest size of the difference, root mean square."""
    from .analysis import correlation, deviation

    d = with_factors(panel, {"a": a, "b": b}).withColumn("diff", F.col("a") - F.col("b"))
    return d.agg(correlation(F.col("a"), F.col("b")).alias("corr"), F.avg("diff").alias("mean_diff"), deviation("diff").alias("std_diff"), F.max(F.abs("diff")).alias("max_abs_diff"), F.sqrt(F.avg(F.col("diff") * F.col("diff"))).alias("rmse"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("identical"))


def future_bias(panel: DataFrame, factor: Expr, times: list[str]) -> DataFrame:
    """Per test time: the largest difference between the factor on all data and on data up to the time."""
    whole, out = with_factors(panel, {"a": factor}), None
    for t in times:
        at = F.to_timestamp_ntz(F.lit(t))
        cut = with_factors(panel.where(F.col("datetime") <= at), {"b": factor})
        one = whole.where(F.col("datetime") == at).join(cut, ["datetime", "code"], "full_outer").where(F.col("datetime") == at)
        one = one.agg(F.lit(t).alias("time"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs_diff"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing"))
        out = one if out is None else out.unionByName(one)
    return out


@dataclass(frozen=True)
class Reads:
    """Rows of a code that a node's value depends on, from ``first`` to ``last`` rows after its own (before it: negative)."""

    node: Expr
    first: float
    last: float
    adds: bool

    @property
    def ahead(self) -> bool:
        return self.last > 0


def row_reads(factor: Expr) -> list[Reads]:
    """What each distinct node reads, operands first; ``adds``: the node itself looks further ahead than its operands.

    Intervals are added up along the tree, so a lead that a longer lag stands over looks at the past. Reads by calendar time
    reach back without bound, and ahead as far as their operand does. Nodes over a section read other codes at the same rows.
    """
    found: dict[str, Reads] = {}
    for e in factor.walk():
        given = [found[a.key] for a in e.args]
        first, last = min([0.0, *(g.first for g in given)]) if not given else min(g.first for g in given), max([g.last for g in given], default=0.0)
        shift = {"lead": lambda p: p[0], "lag": lambda p: -p[0]}.get(e.op)
        own_last = last
        if shift:
            first, own_last = first + shift(e.params), last + shift(e.params)
        elif e.op in ("part", "covar", "list"):
            first -= math.inf if e.params[-1] is None else e.params[-1] - 1
        elif e.op == "first":
            first -= e.params[0] - 1
        elif e.op in ("ref", "ewm", "rows", "block", "block_before"):
            first = -math.inf
        found[e.key] = Reads(e, first, own_last, own_last > max(last, 0.0))
    return list(found.values())


def look_ahead(factor: Expr) -> list[Reads]:
    """The nodes by which a factor reads rows after its own, the furthest first; none if it provably reads no such row.

    Only nodes that still reach ahead at the root count: what a lag above takes back is no look-ahead.
    """
    reads = {r.node.key: r for r in row_reads(factor)}
    if not reads[factor.key].ahead:
        return []
    guilty: dict[str, Reads] = {}

    def visit(e: Expr, back: float, seen: set) -> None:
        """back: rows by which the nodes above move what e reads towards the past."""
        if (e.key, back) in seen or reads[e.key].last - back <= 0:
            return
        seen.add((e.key, back))
        if reads[e.key].adds:
            guilty[e.key] = reads[e.key]
        own = {"lag": lambda p: p[0], "lead": lambda p: -p[0]}.get(e.op, lambda p: 0)(e.params)
        for a in e.args:
            visit(a, back + own, seen)

    visit(factor, 0, set())
    return sorted(guilty.values(), key=lambda r: -r.last)


def validate_times(panel: DataFrame, times: DataFrame) -> DataFrame:
    """The asked times (datetime) as they are; an error without data, or for a time past the panel's last."""
    end = panel.agg(F.max("datetime")).first()[0]
    if end is None:
        raise ValueError("the panel has no rows")
    late = times.where(F.col("datetime") > F.lit(end).cast("timestamp_ntz")).agg(F.min("datetime"), F.count("*")).first()
    if late[1]:
        raise ValueError(f"{late[1]} times are past the data, which end at {end}; the first is {late[0]}")
    return times


def node_report(panel: DataFrame, factor: Expr, config: FrequencyConfig | None = None) -> dict:
    """Seconds of the distinct windows of a factor, each worked out over the panel with what is under it; those over twice the mean; advice."""
    took: dict[str, float] = {}
    windows = [e for e in factor.walk() if e.windowed]
    for e in windows:
        began = time.perf_counter()
        with_factors(panel, {"f": e}).write.format("noop").mode("overwrite").save()
        took[str(e)] = time.perf_counter() - began
    mean = statistics.fmean(took.values()) if took else 0.0
    slow = sorted(({"node": k, "seconds": t, "times_mean": t / mean} for k, t in took.items() if t > 2 * mean), key=lambda r: -r["seconds"])
    nodes, levels = sum(1 for _ in factor.walk()), len(stages([factor], _SPARK))
    lists = [str(e) for e in windows if e.op == "list"]
    advice = [text for text, holds in (
        ("name parts of the expression: it has over ten nodes", nodes > 10),
        ("the slow windows take most of the time: shorten them or share them between factors", bool(slow)),
        ("look-backs over 100 rows: keep state from bar to bar (plans.recurrence)", config is not None and config.window_length > 100),
        ("windows that keep whole frames are worked out in linear time by plans.tails", bool(lists)),
    ) if holds]
    return {"nodes": nodes, "stages": levels, "seconds": took, "bottlenecks": slow, "advice": advice}


class FactorEngine:
    """Computes factors over bar files at the calendar's times."""

    def __init__(self, spark: SparkSession, data_root: str = "data"):
        self.spark, self.data_root = spark, data_root

    def panel(self, assets: list[str] | None, start: str, end: str, config: FrequencyConfig) -> DataFrame:
        since = str(date.fromisoformat(start) - timedelta(days=config.buffer_days()))
        return read_bars(self.spark, self.data_root, config.input_freq, assets, since, end)

    def compute_multiple_factors(self, factors: dict[str, Expr], assets: list[str] | None, start: str, end: str, config: FrequencyConfig) -> DataFrame:
        """(timestamp, asset, factor, factor_value) at every calculation time."""
        values = with_factors(self.panel(assets, start, end, config), factors)
        values = values.withColumn("datetime", F.to_timestamp_ntz(F.concat_ws(" ", F.to_date("datetime").cast("string"), F.lit("15:00:00")))) if config.input_freq == "daily" else values
        at = as_of(values, calendar(self.spark, start, end, config.calc_freq), list(factors))
        return at.unpivot(["datetime", "code"], list(factors), "factor", "factor_value").withColumnsRenamed({"datetime": "timestamp", "code": "asset"})

    def compute_factor(self, factor: Expr, assets: list[str] | None, start: str, end: str, config: FrequencyConfig) -> DataFrame:
        return self.compute_multiple_factors({"factor": factor}, assets, start, end, config).drop("factor")

    def benchmark_factor(self, factor: Expr, assets: list[str] | None, start: str, end: str, config: FrequencyConfig, iterations: int = 1) -> dict[str, float]:
        """Seconds of full runs into nowhere."""
        took = []
        for _ in range(iterations):
            began = time.perf_counter()
            self.compute_factor(factor, assets, start, end, config).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return {"mean": statistics.fmean(took), "std": statistics.pstdev(took), "min": min(took), "max": max(took), "total": sum(took)}


def factor_summary(factor: Expr) -> dict:
    """Depth, number of nodes, fields read, and the tree."""
    return {"expression": str(factor), "window_depth": factor.depth, "nodes": sum(1 for _ in factor.walk()), "fields": factor.fields(), "tree": factor.to_dict()}


def execution_order(factor: Expr) -> list[str]:
    """Nodes in an order in which operands come first."""
    return [str(e) for e in factor.walk()]
