"""Evaluation of factors: information coefficients, quantile portfolios, metrics, combination, periods, groups, out-of-sample and robustness tests.

Frames are long: (timestamp, asset, factor_value, return). Statistics per date are one aggregation; what
runs over dates only (series of coefficients or returns) carries a ``series`` column, so that many factors,
windows or groups are evaluated side by side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import as_array, columns_of, correlations, matrix, moments, ranks, section_percentiles

DAYS_A_YEAR = 252


@dataclass
class FactorData:
    """A factor's values and returns on (timestamp, asset)."""

    frame: DataFrame
    name: str = "factor"
    frequency: str = "daily"
    attributes: dict = field(default_factory=dict)

    @staticmethod
    def from_engine_output(factor: DataFrame, returns: DataFrame, name: str, frequency: str = "daily") -> FactorData:
        for df, columns in ((factor, {"timestamp", "asset", "factor_value"}), (returns, {"timestamp", "asset", "return"})):
            if missing := columns - set(df.columns):
                raise ValueError(f"missing columns: {sorted(missing)}")
        keys = ["timestamp", "asset"]
        return FactorData(factor.select(*keys, "factor_value").join(returns.select(*keys, "return"), keys, "full_outer"), name, frequency)

    @staticmethod
    def from_frame(frame: DataFrame, name: str, start: str | None = None, end: str | None = None, frequency: str = "daily", attributes: dict | None = None) -> FactorData:
        """From rows (timestamp, asset, factor_value, return) of closed dates."""
        if missing := {"timestamp", "asset", "factor_value", "return"} - set(frame.columns):
            raise ValueError(f"missing columns: {sorted(missing)}")
        for bound, test in ((start, F.col("timestamp").__ge__), (end, F.col("timestamp").__le__)):
            frame = frame if bound is None else frame.where(test(F.lit(bound).cast("timestamp_ntz")))
        return FactorData(frame, name, frequency, attributes or {})

    def validate(self) -> DataFrame:
        share = lambda c: (F.sum(F.col(c).isNull().cast("double")) / F.count("*")).alias(f"{c}_missing")
        return self.frame.agg(F.count("*").alias("rows"), share("factor_value"), share("return"))

    def cross_section(self, timestamp) -> DataFrame: return self.frame.where(F.col("timestamp") == timestamp)
    def time_series(self, asset: str) -> DataFrame: return self.frame.where(F.col("asset") == asset)
    def dates(self) -> DataFrame: return self.frame.select("timestamp").distinct().orderBy("timestamp")
    def assets(self) -> DataFrame: return self.frame.select("asset").distinct().orderBy("asset")

    def summary(self) -> DataFrame:
        q = [F.percentile("factor_value", p).alias(n) for n, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))]
        return self.frame.agg(F.count("factor_value").alias("count"), F.avg("factor_value").alias("mean"), F.stddev_samp("factor_value").alias("std"), F.min("factor_value").alias("min"), *q, F.max("factor_value").alias("max"))


@dataclass
class AnalysisResult:
    """Named frames of an analysis; saved as a folder of Parquet tables."""

    name: str
    data: dict[str, DataFrame]

    def save(self, path: str) -> None:
        for k, df in self.data.items():
            df.write.mode("overwrite").parquet(f"{path}/{self.name}/{k}")

    @staticmethod
    def load(spark, path: str, name: str, tables: list[str]) -> AnalysisResult:
        return AnalysisResult(name, {k: spark.read.parquet(f"{path}/{name}/{k}") for k in tables})


# preparation
def by_asset(): return Window.partitionBy("asset").orderBy("timestamp")


def forward_returns(df: DataFrame, periods: int = 1) -> DataFrame:
    """The return so many rows ahead, in a column ``forward``."""
    return df.withColumn("forward", F.lead("return", periods).over(by_asset()))


def aligned(factor: DataFrame, returns: DataFrame, periods: int = 1, dropna: bool = True) -> DataFrame:
    out = factor.join(forward_returns(returns, periods).select("timestamp", "asset", "forward"), ["timestamp", "asset"])
    return out.dropna(subset=["factor_value", "forward"]) if dropna else out


def winsorized(df: DataFrame, lower: float = 0.01, upper: float = 0.99, by_date: bool = True, column: str = "factor_value", large: bool = False) -> DataFrame:
    """Values held between two percentiles, per date or over all rows. ``large``: dates don't fit in a task each, so percentiles are selected by ranges of values."""
    w = Window.partitionBy("timestamp")
    if by_date and large:
        bounds = section_percentiles(df, column, [lower, upper]).withColumnRenamed("timestamp", "_date")
        x, d = F.col(column), df.join(bounds, F.col("timestamp") == F.col("_date"), "left")
        held = F.when(x.isNull(), None).otherwise(F.least(F.greatest(x, F.get("percentiles", F.lit(0))), F.get("percentiles", F.lit(1))))
        return d.select(*[held.alias(c) if c == column else df[c] for c in df.columns])
    if not by_date:  # one row of bounds rather than one window over everything
        low, high = map(F.lit, overall_percentiles(df, column, (lower, upper)))
    else:
        low, high = F.percentile(column, lower).over(w), F.percentile(column, upper).over(w)
    x = F.col(column)
    return df.withColumn(column, F.when(x.isNull(), None).otherwise(F.least(F.greatest(x, low), high)))


def filled(df: DataFrame, method: str = "forward", limit: int | None = None, column: str = "factor_value") -> DataFrame:
    """Missing values by asset: forward or backward up to a limit, the asset's mean, or zero."""
    w, x = by_asset(), F.col(column)
    if method == "forward":
        value = F.last(x, True).over(w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0))
    elif method == "backward":
        value = F.first(x, True).over(w.rowsBetween(0, Window.unboundedFollowing if limit is None else limit))
    elif method == "mean":
        value = F.coalesce(x, F.avg(x).over(Window.partitionBy("asset")))
    elif method == "zero":
        value = F.coalesce(x, F.lit(0.0))
    else:
        raise ValueError(f"unknown method {method}")
    return df.withColumn(column, value)


def average_rank(x: Column, *part: str) -> Column:
    w = Window.partitionBy(*part, x.isNull())
    return F.when(x.isNotNull(), F.rank().over(w.orderBy(x)) + (F.count("*").over(Window.partitionBy(*part, x.isNull(), x)) - 1) / 2.0)


def ranked_values(df: DataFrame, column: str) -> DataFrame:
    """x, n, before: each known value, its rows, and the rows with smaller ones.

    Rows are counted in two levels, by ranges of values and in each range, so that no task has all of them. There are
    as many ranges as shuffle partitions, by approximate quantiles of the distinct values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count("*").alias("n"))
    ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = counts.agg(F.percentile_approx("x", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] or []
    step = math.isqrt(len(bounds)) or 1
    array = lambda values: F.array(*map(F.lit, values)).cast("array<double>")
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col("x")))
    counts = counts.withColumn("coarse", below(array(bounds[step - 1 :: step])) * step)
    counts = counts.withColumn("range", F.col("coarse") + below(F.slice(array(bounds), F.col("coarse") + 1, step)))
    sums = counts.groupBy("range").agg(F.sum("n").alias("n"))
    up_to = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("range", up_to(Window.orderBy("range")).alias("base"))  # one row a range
    return counts.join(sums, "range").select("x", "n", (F.col("base") + up_to(Window.partitionBy("range").orderBy("x"))).alias("before"))


def overall_percentiles(df: DataFrame, column: str, shares: tuple[float, ...]) -> list[float | None]:
    """Interpolated percentiles over all rows; None without known values."""
    known = df.where(F.col(column).isNotNull()).count()
    if not known:
        return [None] * len(shares)
    places = [p * (known - 1) for p in shares]
    wanted = sorted({f(p) for p in places for f in (math.floor, math.ceil)})
    holds = [F.lit(i).between(F.col("before"), F.col("before") + F.col("n") - 1) for i in wanted]
    rows = ranked_values(df, column).where(reduce(lambda a, b: a | b, holds)).collect()  # two rows a share at most
    at = {i: float(r.x) for r in rows for i in wanted if r.before <= i < r.before + r.n}
    low, high = [at[math.floor(p)] for p in places], [at[math.ceil(p)] for p in places]
    return [a if a == b else a + (p - math.floor(p)) * (b - a) for p, a, b in zip(places, low, high, strict=True)]


def standardized(df: DataFrame, method: str = "zscore", column: str = "factor_value") -> DataFrame:
    """Per date: z-score (no deviation: unchanged), min-max (constant: 0.5), or rank over all rows."""
    w, x = Window.partitionBy("timestamp"), F.col(column)
    if method == "zscore":
        s = F.stddev_samp(x).over(w)
        value = F.when(s > 0, F.try_divide(x - F.avg(x).over(w), s)).otherwise(x)
    elif method == "minmax":
        low, high = F.min(x).over(w), F.max(x).over(w)
        value = F.when(x.isNull(), None).when(high > low, F.try_divide(x - low, high - low)).otherwise(0.5)
    elif method == "rank":
        value = average_rank(x, "timestamp") / F.count("*").over(w)
    else:
        raise ValueError(f"unknown method {method}")
    return df.withColumn(column, value)


def resampled(df: DataFrame, unit: str, method: str = "last") -> DataFrame:
    """Per asset and date_trunc unit: last, first, mean or sum of the factor."""
    agg = {"last": F.max_by("factor_value", "timestamp"), "first": F.min_by("factor_value", "timestamp"), "mean": F.avg("factor_value"), "sum": F.sum("factor_value")}[method]
    return df.groupBy(F.date_trunc(unit, "timestamp").cast("timestamp_ntz").alias("timestamp"), "asset").agg(agg.alias("factor_value"))


def dated(df: DataFrame) -> DataFrame:
    """Number the distinct dates from 1 in ``day``; the table of dates is one row each."""
    days = df.select("timestamp").distinct().withColumn("day", F.row_number().over(Window.orderBy("timestamp"))).withColumn("days", F.count("*").over(Window.partitionBy(F.lit(1))))
    return df.join(days, "timestamp")


def split_train_test(df: DataFrame, ratio: float = 0.7, by_time: bool = True) -> tuple[DataFrame, DataFrame]:
    if not by_time:
        train, test = df.randomSplit([ratio, 1 - ratio], seed=42)
        return train, test
    d, cut = dated(df), F.floor(F.col("days") * ratio)
    return d.where(F.col("day") <= cut).drop("day", "days"), d.where(F.col("day") > cut).drop("day", "days")


# information coefficients
def deviation(x: Column | str) -> Column:
    """Sample deviation of a group; exactly 0 for equal values, of which merging the sums of tasks can leave a rest."""
    return F.when(F.min(x) < F.max(x), F.stddev_samp(x)).otherwise(F.stddev_samp(x) * 0)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of pairs; null without variance."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_samp(x, y), deviation(a) * deviation(b))


def daily_ic(df: DataFrame, method: str = "pearson", min_periods: int = 20, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per keys and date: the correlation of factor_value and forward over known pairs; null with too few."""
    pairs = df.withColumn("_ok", F.col("factor_value").isNotNull() & F.col("forward").isNotNull())
    x, y = F.when(F.col("_ok"), F.col("factor_value")), F.when(F.col("_ok"), F.col("forward"))
    if method == "spearman":
        x, y = average_rank(x, *keys, "timestamp"), average_rank(y, *keys, "timestamp")
    ranked = pairs.select(*keys, "timestamp", "_ok", x.alias("x"), y.alias("y"))
    return ranked.groupBy(*keys, "timestamp").agg(F.when(F.sum(F.col("_ok").cast("int")) >= min_periods, correlation(F.col("x"), F.col("y"))).alias("ic"))


def ic_series(df: DataFrame, method: str = "pearson", forward_periods: int = 1, min_periods: int = 20) -> DataFrame:
    return daily_ic(forward_returns(df, forward_periods), method, min_periods)


def ic_metrics(ic: DataFrame, *keys: str) -> DataFrame:
    """Mean, deviation, their ratio, share above 0, mean size and t statistic of a series of coefficients."""
    mean, std, n = F.avg("ic"), deviation("ic"), F.count("ic")
    return ic.groupBy(*keys).agg(n.alias("n"), mean.alias("ic_mean"), std.alias("ic_std"), F.try_divide(mean, std).alias("icir"), F.avg((F.col("ic") > 0).cast("double")).alias("ic_positive"), F.avg(F.abs("ic")).alias("ic_abs_mean"), F.try_divide(mean, std / F.sqrt(n.cast("double"))).alias("t_stat"))


def beta_fraction(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_p_value(t: float, freedom: float) -> float:
    """Two-sided p value of a Student t statistic."""
    return beta_fraction(freedom / (freedom + t * t), freedom / 2, 0.5)


def t_quantile(p: float, freedom: float) -> float:
    """Student t quantile by bisection."""
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        cdf = 1 - t_p_value(mid, freedom) / 2 if mid > 0 else t_p_value(mid, freedom) / 2
        low, high = (mid, high) if cdf < p else (low, mid)
    return (low + high) / 2


def ic_test(ic: DataFrame, confidence: float = 0.95) -> dict[str, float]:
    """The metrics of one series with p value and confidence interval, on the driver."""
    r = ic_metrics(ic).first().asDict()
    if r["t_stat"] is not None and r["n"] > 1:
        width = t_quantile(0.5 + confidence / 2, r["n"] - 1) * r["ic_std"] / math.sqrt(r["n"])
        r |= {"p_value": t_p_value(r["t_stat"], r["n"] - 1), "ci_low": r["ic_mean"] - width, "ci_high": r["ic_mean"] + width}
    return r


def batch_ic(df: DataFrame, method: str = "spearman", forward_periods: int = 1, min_periods: int = 20) -> DataFrame:
    """Metrics of many factors (column ``factor``), best ratio first."""
    w = Window.partitionBy("factor", "asset").orderBy("timestamp")
    ic = daily_ic(df.withColumn("forward", F.lead("return", forward_periods).over(w)), method, min_periods, ("factor",))
    return ic_metrics(ic, "factor").orderBy(F.desc_nulls_last("icir"), "factor")


# quantile portfolios
def quantile_labels(df: DataFrame, n: int = 5, column: str = "factor_value", large: bool = False) -> DataFrame:
    """``quantile`` 0, 1, ... per date by distinct quantile edges; equal edges give fewer groups. ``large``: see winsorized."""
    w = Window.partitionBy("timestamp")
    if large:
        found = section_percentiles(df, column, [k / n for k in range(n + 1)]).select(F.col("timestamp").alias("_date"), F.array_sort(F.array_distinct("percentiles")).alias("_edges"))
        d = df.join(found, F.col("timestamp") == F.col("_date"), "left").drop("_date")
    else:
        edges = F.array_sort(F.array_distinct(F.percentile(column, F.array(*[F.lit(k / n) for k in range(n + 1)])).over(w)))
        d = df.withColumn("_edges", edges)
    inner = F.when(F.size("_edges") > 2, F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(1)))).otherwise(F.array().cast("array<double>"))
    label = F.size(F.filter(inner, lambda e: e < F.col(column)))
    return d.withColumn("quantile", F.when(F.col(column).isNotNull() & (F.size("_edges") > 1), label)).drop("_edges")


def group_returns(labelled: DataFrame, n: int = 5) -> DataFrame:
    """Mean forward return per date and group, in columns q1 ... qn, and the last less the first."""
    wide = labelled.groupBy("timestamp").agg(*[F.avg(F.when(F.col("quantile") == k, F.col("forward"))).alias(f"q{k + 1}") for k in range(n)])
    return wide.withColumn("long_short", F.col(f"q{n}") - F.col("q1"))


def unpivoted(wide: DataFrame, n: int = 5) -> DataFrame:
    """(timestamp, series, ret) of the groups and the long-short portfolio."""
    names = [*(f"q{k + 1}" for k in range(n)), "long_short"]
    return wide.unpivot(["timestamp"], names, "series", "ret")


def turnover(labelled: DataFrame) -> DataFrame:
    """Per date and group of the previous date: the share of its assets, present now, whose label changed."""
    d = dated(labelled.select("timestamp", "asset", "quantile"))
    before = d.select("asset", (F.col("day") + 1).alias("day"), F.col("quantile").alias("was"))
    both = d.where("quantile IS NOT NULL").join(before.where("was IS NOT NULL"), ["asset", "day"])
    return both.groupBy("timestamp", "was").agg(F.avg((F.col("quantile") != F.col("was")).cast("double")).alias("turnover"))


# metrics of return series (series, timestamp, ret)
def drawdowns(returns: DataFrame) -> DataFrame:
    w = Window.partitionBy("series").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    grown = returns.where("ret IS NOT NULL").withColumn("wealth", F.product(1 + F.col("ret")).over(w))
    return grown.withColumn("drawdown", F.try_divide(F.col("wealth"), F.max("wealth").over(w)) - 1)


def return_metrics(returns: DataFrame, risk_free: float = 0.0, per_year: int = DAYS_A_YEAR) -> DataFrame:
    r, n = F.col("ret"), F.count("ret")
    total = F.product(1 + r) - 1
    vol = deviation(r) * math.sqrt(per_year)
    excess = r - risk_free / per_year
    down = deviation(F.when(excess < 0, excess)) * math.sqrt(per_year)
    m = drawdowns(returns).groupBy("series").agg(
        n.alias("n"), total.alias("total_return"), F.when(total > -1, F.pow(1 + total, F.try_divide(F.lit(float(per_year)), n.cast("double"))) - 1).alias("annual_return"), vol.alias("volatility"),
        F.try_divide(F.avg(excess) * per_year, vol).alias("sharpe"), F.try_divide(F.avg(excess) * per_year, down).alias("sortino"), F.min("drawdown").alias("max_drawdown"),
        F.avg((r > 0).cast("double")).alias("win_rate"), F.max(r).alias("best"), F.min(r).alias("worst"),
    )
    return m.withColumn("calmar", F.try_divide(F.col("annual_return"), F.abs("max_drawdown")))


def value_at_risk(returns: DataFrame, confidence: float = 0.95) -> DataFrame:
    """VaR and CVaR per series: minus the quantile, and minus the mean at or below it."""
    edge = returns.groupBy("series").agg(F.percentile("ret", 1 - confidence).alias("edge"))
    return returns.join(edge, "series").groupBy("series").agg((-F.first("edge")).alias("var"), (-F.avg(F.when(F.col("ret") <= F.col("edge"), F.col("ret")))).alias("cvar"))


def beta_alpha(returns: DataFrame, benchmark: DataFrame, risk_free: float = 0.0, per_year: int = DAYS_A_YEAR) -> DataFrame:
    """Beta, alpha and information ratio against benchmark(timestamp, bench)."""
    pairs = returns.join(benchmark, "timestamp").where("ret IS NOT NULL AND bench IS NOT NULL")
    beta = F.try_divide(F.covar_samp("ret", "bench"), F.when(F.min("bench") < F.max("bench"), F.var_samp("bench")))
    alpha = F.avg("ret") * per_year - (risk_free + beta * (F.avg("bench") * per_year - risk_free))
    active = F.col("ret") - F.col("bench")
    return pairs.groupBy("series").agg(beta.alias("beta"), alpha.alias("alpha"), F.try_divide(F.avg(active) * math.sqrt(per_year), deviation(active)).alias("information_ratio"))


def all_metrics(returns: DataFrame, benchmark: DataFrame | None = None, risk_free: float = 0.0, per_year: int = DAYS_A_YEAR) -> DataFrame:
    """Every metric of each series, side by side; with a benchmark(timestamp, bench) also those against it."""
    out = return_metrics(returns, risk_free, per_year).join(value_at_risk(returns), "series")
    if benchmark is None:
        return out
    active = returns.join(benchmark, "timestamp").groupBy("series").agg((deviation(F.col("ret") - F.col("bench")) * math.sqrt(per_year)).alias("tracking_error"))
    return out.join(beta_alpha(returns, benchmark, risk_free, per_year), "series", "left").join(active, "series", "left")


def position_turnover(positions: DataFrame) -> DataFrame:
    """Half the sum of absolute changes of weight(timestamp, asset, weight) per date, from the second on."""
    d = dated(positions)
    now, was = d.select("day", "timestamp", "asset", "weight"), d.select((F.col("day") + 1).alias("day"), "asset", F.col("weight").alias("was"))
    days = d.select("day", "timestamp").distinct()
    change = now.drop("timestamp").join(was, ["day", "asset"], "full_outer").join(days, "day").where("day > 1")
    return change.groupBy("timestamp").agg((F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("was", F.lit(0.0)))) / 2).alias("turnover"))


# several factors: frames with a column per factor on (timestamp, asset)
def factor_correlation(wide: DataFrame, names: list[str], method: str = "pearson") -> DataFrame:
    """(a, b, corr) of every pair over the rows where all factors are known, in a number of jobs that doesn't depend on that of factors."""
    x = wide.dropna(subset=names).select(as_array(names).alias("x"))
    _, _, covariance = moments(ranks(x, len(names)) if method == "spearman" else x, len(names))
    return columns_of(wide.sparkSession, correlations(covariance), names)


def high_correlation(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The pairs of factor_correlation of at least this size."""
    return pairs.where(F.abs("corr") >= threshold)


def combination_weights(metrics: DataFrame, names: list[str], method: str = "equal_weight") -> dict[str, float]:
    """Weights from batch_ic's metrics: equal, by size of the mean IC, or by positive ICIR (``optimal`` is the same)."""
    got = {r.factor: r for r in metrics.collect()}
    raw = {n: abs(got[n].ic_mean or 0) if method == "ic_weight" else max(got[n].icir or 0, 0) for n in names} if method != "equal_weight" else {}
    total = sum(raw.values())
    return {n: raw[n] / total for n in names} if total > 0 else {n: 1 / len(names) for n in names}


def combined(wide: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of the factors' z-scores per date, where all are known."""
    names = list(weights)
    z = reduce(lambda df, c: standardized(df, "zscore", c), names, wide).dropna(subset=names)
    return z.select("timestamp", "asset", reduce(lambda a, b: a + b, [F.col(n) * w for n, w in weights.items()]).alias("factor_value"))


def standardized_columns(wide: DataFrame, names: list[str]) -> DataFrame:
    """(timestamp, asset, x): the z-scores per date of several factors as one array; rows where one is missing are left out."""
    stats = wide.groupBy("timestamp").agg(as_array_of(F.avg, names).alias("_mean"), as_array_of(deviation, names).alias("_std"))
    d = wide.select("timestamp", "asset", as_array(names).alias("x")).join(stats, "timestamp")
    score = lambda x, i: F.when(F.get("_std", i) > 0, F.try_divide(x - F.get("_mean", i), F.get("_std", i))).otherwise(x)
    d = d.select("timestamp", "asset", F.transform("x", score).alias("x"))
    return d.where(~F.exists("x", lambda x: x.isNull() | F.isnan(x)))


def as_array_of(f, names: list[str]) -> Column:
    """An aggregate of each of several columns."""
    return F.array(*[f(F.col(f"`{c}`").cast("double")) for c in names])


def principal_components(wide: DataFrame, names: list[str], n_components: int | None = None, variance: float = 0.95) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Scores, components and explained ratios of the factors' z-scores. Only the covariance matrix comes to the driver."""
    z, k = standardized_columns(wide, names), len(names)
    n, mean, covariance = moments(z, k)
    if n < 2:
        mean, covariance = np.zeros(k), np.zeros((k, k))
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order].T
    vectors *= np.sign(vectors[np.arange(k), np.abs(vectors).argmax(axis=1)])[:, None]
    ratio = values / max(values.sum(), 1e-300)
    keep = min(k, n_components or int(np.searchsorted(np.cumsum(ratio), variance - 1e-12) + 1))
    turn, scores = vectors[:keep].T.copy(), [f"pc{p + 1}" for p in range(keep)]

    def run(batches):
        for batch in batches:
            found = (matrix(batch.column("x"), k) - mean) @ turn
            yield pa.RecordBatch.from_arrays([batch.column("timestamp"), batch.column("asset"), *map(pa.array, found.T)], ["timestamp", "asset", *scores])

    kinds = {f.name: f.dataType.simpleString() for f in z.schema}
    schema = f"timestamp {kinds['timestamp']}, asset {kinds['asset']}, " + ", ".join(f"{c} double" for c in scores)
    return z.mapInArrow(run, schema), vectors[:keep], ratio[:keep]


# periods, groups, tests: a part column, then coefficients per part; forward returns are made inside each part
def ic_by_part(parts: DataFrame, method: str = "spearman", forward_periods: int = 1, min_periods: int = 20) -> DataFrame:
    w = Window.partitionBy("part", "asset").orderBy("timestamp")
    ic = daily_ic(parts.withColumn("forward", F.lead("return", forward_periods).over(w)), method, min_periods, ("part",))
    return ic_metrics(ic, "part")


def by_period(df: DataFrame, periods: list[tuple[str, str]], names: list[str] | None = None) -> DataFrame:
    """Rows of closed periods, which may overlap."""
    rows = [(n, a, b) for n, (a, b) in zip(names or [f"period_{k + 1}" for k in range(len(periods))], periods, strict=True)]
    table = df.sparkSession.createDataFrame(rows, "part string, first string, last string").select("part", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first", "last")])
    return df.join(F.broadcast(table), F.col("timestamp").between(F.col("first"), F.col("last"))).drop("first", "last")  # a row per period that the caller lists


def rolling_parts(df: DataFrame, window: int = 60, step: int = 20) -> DataFrame:
    """A row per window of so many dates that holds it; windows start every step dates and are full."""
    d = dated(df)
    first = F.greatest(F.lit(0), F.ceil((F.col("day") - window) / step))
    last = F.least(F.floor((F.col("day") - 1) / step), F.floor((F.col("days") - window) / step))
    return d.where("days >= %d" % window).where(first <= last).withColumn("part", F.explode(F.sequence(first, last))).drop("day", "days")


def trend(metrics: DataFrame, column: str = "ic_mean") -> DataFrame:
    """Slope of a metric over its parts in order, and the deviation of the ratio."""
    d = metrics.withColumn("k", (F.row_number().over(Window.orderBy("part")) - 1).cast("double"))
    return d.agg(F.coalesce(F.try_divide(F.covar_samp("k", column), F.var_samp(F.when(F.col(column).isNotNull(), F.col("k")))), F.lit(0.0)).alias("slope"), deviation("icir").alias("icir_std"))


def by_group(df: DataFrame, groups: DataFrame) -> DataFrame:
    """groups(part, asset); an asset may be in several."""
    return df.join(groups, "asset")


def by_quantile(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    return quantile_labels(df, n, column).where("quantile IS NOT NULL").withColumn("part", F.col("quantile") + 1).drop("quantile")


def monotonicity(metrics: DataFrame, column: str = "ic_mean") -> DataFrame:
    step = F.signum(F.col(column) - F.lag(column).over(Window.orderBy("part")))
    return metrics.select(step.alias("s")).agg(F.try_divide(F.sum("s"), F.count("s").cast("double")).alias("monotonicity"))


def train_test(df: DataFrame, ratio: float = 0.7) -> DataFrame:
    """Parts train and test; the split date is in both."""
    d, cut = dated(df), F.floor(F.col("days") * ratio) + 1
    both = F.array_compact(F.array(F.when(F.col("day") <= cut, F.lit("train")), F.when(F.col("day") >= cut, F.lit("test"))))
    return d.withColumn("part", F.explode(both)).drop("day", "days")


def rolling_oos(df: DataFrame, train: int = 252, test: int = 63, step: int = 21) -> DataFrame:
    """Parts train_k and test_k of rolling windows."""
    d = dated(df)
    k = F.explode(F.sequence(F.lit(0), F.floor((F.col("days") - train - test) / step)))
    d = d.where(F.col("days") >= train + test).withColumn("k", k).withColumn("at", F.col("day") - F.col("k") * step)
    side = F.when(F.col("at").between(1, train), F.lit("train")).when(F.col("at").between(train + 1, train + test), F.lit("test"))
    return d.withColumn("part", F.concat_ws("_", side, "k")).where(side.isNotNull()).drop("day", "days", "k", "at")


def walk_forward(df: DataFrame, folds: int = 5) -> DataFrame:
    """Expanding training windows: fold k trains on the first k of folds + 1 equal runs of dates and tests on the next."""
    d = dated(df).withColumn("size", F.floor(F.col("days") / (folds + 1))).where("size > 0")
    run = F.floor((F.col("day") - 1) / F.col("size"))
    k = F.explode(F.sequence(F.lit(1), F.lit(folds)))
    d = d.withColumn("run", run).withColumn("k", k)
    side = F.when(F.col("run") < F.col("k"), F.lit("train")).when(F.col("run") == F.col("k"), F.lit("test"))
    return d.withColumn("part", F.concat_ws("_", side, "k")).where(side.isNotNull()).drop("day", "days", "size", "run", "k")


def subsamples(df: DataFrame, n: int = 10, ratio: float = 0.8, seed: int = 0) -> DataFrame:
    """n parts, each with the share of dates that comes first in a seeded order."""
    days = df.select("timestamp").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    w = Window.partitionBy("part")
    days = days.withColumn("r", F.row_number().over(w.orderBy(F.xxhash64("timestamp", F.lit(seed), "part"), "timestamp"))).withColumn("m", F.floor(F.count("*").over(w) * ratio))
    return df.join(days.where("r <= m").select("timestamp", "part"), "timestamp")


def stability(metrics: DataFrame) -> DataFrame:
    """1 - deviation / |mean| of the parts' mean coefficients."""
    return metrics.agg((1 - F.try_divide(deviation("ic_mean"), F.abs(F.avg("ic_mean")))).alias("stability"), F.avg("ic_mean").alias("mean"))


def parameter_parts(frames: dict[str, DataFrame]) -> DataFrame:
    """A part per value of a parameter; frames of equal columns."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("part", F.lit(str(k))) for k, df in frames.items()])


def sensitivity(metrics: DataFrame) -> DataFrame:
    """One row over parts: mean, range and deviation of their coefficients, the best part by ratio, stability."""
    best = F.max_by("part", F.struct(F.col("icir").isNotNull(), "icir"))
    return metrics.agg(
        F.count("*").alias("n_parts"), F.avg("ic_mean").alias("mean_ic"), (F.max("ic_mean") - F.min("ic_mean")).alias("ic_range"), deviation("ic_mean").alias("ic_std"), best.alias("best_part"), F.max("icir").alias("best_icir"),
        F.coalesce(1 - F.try_divide(deviation("ic_mean"), F.abs(F.avg("ic_mean"))), F.lit(0.0)).alias("stability"),
    )


def degradation(metrics: DataFrame) -> DataFrame:
    """Per pair of parts train and test (train_k and test_k): their mean coefficients, the decay and the ratio of test to train."""
    pair = F.coalesce(F.nullif(F.regexp_extract("part", r"_(\d+)$", 1), F.lit("")), F.lit("0"))
    side = lambda name, c: F.max(F.when(F.col("part").startswith(name), F.col(c)))
    both = metrics.groupBy(pair.cast("int").alias("pair")).agg(side("train", "ic_mean").alias("train_ic"), side("test", "ic_mean").alias("test_ic"), side("train", "icir").alias("train_icir"), side("test", "icir").alias("test_icir"))
    return both.withColumn("ic_decay", F.col("test_ic") - F.col("train_ic")).withColumn("ic_ratio", F.try_divide("test_ic", "train_ic"))


def split_at(df: DataFrame, date: str) -> DataFrame:
    """Parts train (to the date) and test (from it on); the date is in both."""
    at, t = F.lit(date).cast("timestamp_ntz"), F.col("timestamp")
    both = F.array_compact(F.array(F.when(t <= at, F.lit("train")), F.when(t >= at, F.lit("test"))))
    return df.withColumn("part", F.explode(both))


def out_of_sample_test(df: DataFrame, ratio: float = 0.7, split_date: str | None = None, kind: str = "split", method: str = "spearman", min_periods: int = 20, **options) -> DataFrame:
    """Degradation from training to test dates: of one split, of rolling windows or of walk-forward folds."""
    parts = {"split": lambda: train_test(df, ratio) if split_date is None else split_at(df, split_date), "rolling": lambda: rolling_oos(df, **options), "walk_forward": lambda: walk_forward(df, **options)}
    if kind not in parts:
        raise ValueError(f"unknown kind {kind}")
    return degradation(ic_by_part(parts[kind](), method, 1, min_periods))


def robustness_test(df, kind: str = "subsample", method: str = "spearman", min_periods: int = 20, **options) -> DataFrame:
    """Sensitivity over parts: subsamples of dates, return columns, asset universes, or values of a parameter (df: frames by value)."""
    parts = {"subsample": lambda: subsamples(df, **options), "return_period": lambda: return_periods(df, **options), "universe": lambda: by_group(df, **options), "parameter": lambda: parameter_parts(df)}
    if kind not in parts:
        raise ValueError(f"unknown kind {kind}")
    return sensitivity(ic_by_part(parts[kind](), method, 1, min_periods))


def return_periods(df: DataFrame, columns: list[str]) -> DataFrame:
    """A part per return column."""
    return df.unpivot(["timestamp", "asset", "factor_value"], columns, "part", "return")
