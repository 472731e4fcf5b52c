"""Registered queries over the test tables, with DuckDB SQL for the same results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import factors as lib
from .functions import minute_features as mf
from .functions.processors import cs_minmax, cs_rank
from .operators import nodes as n
from .plans import analysis as an
from .plans.columns import section_percentiles, shared_folder
from .plans.engine import align_timestamps, calendar
from .plans.expr import TAILS, Expr, factors_sql, field, node, with_factors
from .plans.snapshot import minute_features, snapshot_sql
from .plans.tails import tail_values
from .sources.panels import PANELS, panel, panel_sql
from .streaming.bars import validate
from .streaming.online import OnlineFeatures

DIGITS = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, without negative zeros, so that results can be compared by value."""
    return df.select(*[(F.round(F.col(f"`{c}`"), DIGITS) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def r(text: str, name: str) -> str:
    return f"round({text}, {DIGITS}) + 0.0 as {name}"


def wrap(_: str, text: str) -> str:
    return f"round({text}, {DIGITS}) + 0.0"


# panels
for _p in PANELS:
    register(f"panel_{_p}", f"select datetime, code, {', '.join(r(c, c) for c in ('open', 'high', 'low', 'close', 'volume', 'amount'))} from ({panel_sql(_p)})")(lambda s, d, p=_p: panel(s, d, p))

# nodes and factors on the daily panel of users
_mid = (n.High() + n.Low()) / 2
NODES: dict[str, dict[str, Expr]] = {
    "nodes_arithmetic": {
        "add": n.Add(n.Open(), n.Close()), "sub": n.Sub(n.High(), n.Low()), "mul": n.Mul(n.Close(), n.Volume()), "div": n.Div(n.Amount(), n.Volume()), "div_by_zero": n.Div(n.Close(), n.Sub(n.Close(), n.Close())),
        "pow": n.Pow(n.Volume(), 2), "abs": n.Abs(n.Open() - n.Close()), "log": n.Log(n.Close()), "sqrt": n.Sqrt(n.Open() - n.Close()), "neg": n.Neg(n.Close()), "sign": n.Sign(n.Close() - n.Open()),
        "maximum": n.Maximum(n.Open(), n.Close()), "minimum": n.Minimum(n.Open(), n.Close()), "clip": n.Clip(n.Volume(), 1, 2), "constant": n.Constant(3.5) + n.AtomicData("volume"),
    },
    "nodes_conditions": {"greater": n.Greater(n.Close(), n.Open()), "less": n.Less(n.Close(), n.Ref(n.Close(), 1)), "equal": n.Equal(n.High(), n.Low()), "ifelse": n.IfElse(n.Greater(n.Close(), n.Open()), n.High(), n.Low())},
    "nodes_time_series": {
        "mean": n.Mean(n.Close(), 5), "mean_of_mid": n.Mean(_mid, 5), "std": n.Std(n.Close(), 5), "sum": n.Sum(n.Volume(), 5), "max": n.Max(n.High(), 5), "min": n.Min(n.Low(), 5), "tsmax": n.Tsmax(n.Close(), 7), "tsmin": n.Tsmin(n.Close(), 7),
        "ref": n.Ref(n.Close(), 3), "ref_rows": n.Ref(n.Close(), 3, "rows"), "delta": n.Delta(n.Close(), 2), "returns": n.Returns(1), "ema": n.EMA(n.Close(), 5), "ts_rank": n.TsRank(n.Close(), 4),
    },
    "nodes_cross_section": {
        "rank": n.Rank(n.Volume()), "rank_desc": n.Rank(n.Close(), ascending=False), "rank_min": n.Rank(n.Volume(), method="min"), "rank_max": n.Rank(n.Volume(), method="max"), "rank_dense": n.Rank(n.Volume(), method="dense"),
        "zscore": n.Zscore(n.Close()), "zscore_robust": n.Zscore(n.Close(), robust=True), "quantile": n.Quantile(n.Close(), 4), "quantile_labels": n.Quantile(n.Close(), 4, labels=True), "winsorize": n.Winsorize(n.Close()),
        "neutralize": n.Neutralize(n.Close(), n.Volume()), "scale": n.Scale(n.Close()), "scale_sum": n.Scale(n.Close(), target_sum=100), "scale_range": n.Scale(n.Close(), target_range=(-1, 1)),
    },
    "nodes_nested": {"rank_of_momentum": n.Rank(lib.Momentum(5)), "zscore_of_ratio": n.Zscore(n.Close() / n.Mean(n.Close(), 5)), "mean_of_rank": n.Mean(n.Rank(n.Close()), 5)},
    "factor_library": lib.LIBRARY,
}
for _name, _exprs in NODES.items():
    register(_name, factors_sql(panel_sql("E"), _exprs, wrap=wrap))(lambda s, d, e=_exprs: with_factors(panel(s, d, "E"), e))

# minute features on the daily panel of return flags, the last row of each code
for _family in mf.FAMILIES:
    # SQL reads the price levels as constants: the test tables' median close lies between 10,000 and 100,000
    register(f"features_{_family}", snapshot_sql(panel_sql("D"), mf.features((_family,), 50_000.0, None)))(lambda s, d, f=_family: minute_features(panel(s, d, "D"), (f,)))
register("features_base", snapshot_sql(panel_sql("D"), mf.base_features()))(lambda s, d: tail_values(panel(s, d, "D"), mf.base_features(TAILS)))

# bar by bar, and all rows at once
_ALL = mf.features(("microstructure",), 50.0, None)
_FILLED = dict(wrap=lambda name, text: f"round(coalesce({text}, 0), {DIGITS}) + 0.0")
register("features_all_rows", factors_sql(panel_sql("H"), _ALL, **_FILLED))(lambda s, d: minute_features(panel(s, d, "H"), ("microstructure",), snapshot=False))


@register("features_online", factors_sql(panel_sql("H"), _ALL, tail="qualify dense_rank() over (order by datetime desc) <= 3", **_FILLED))
def _online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the last three bars, which come one by one and out of order after a history."""
    bars = panel(spark, sf_dir, "H").select(F.col("datetime").alias("time"), F.col("code").alias("symbol"), "open", "high", "low", "close", "volume", F.col("amount").alias("money"))
    last = [x.time for x in bars.select("time").distinct().orderBy(F.desc("time")).limit(3).collect()]
    online = OnlineFeatures(spark, f"{shared_folder(spark)}/online-{uuid.uuid4().hex}", ("microstructure",), blocks=4)
    online.build(bars.where(F.col("time") < F.lit(last[2]).cast("timestamp_ntz")))
    for batch, k in enumerate((2, 0, 1)):
        online.process(bars.where(F.col("time") == F.lit(last[k]).cast("timestamp_ntz")), batch)
    return online.features().drop("date", "bar")


_SIDES = ("close", "high", "volume")
_OTHER = {"close": "case when cast(volume as bigint) % 3 = 0 then close + 0.5 else close end", "high": "high * 1.0005", "volume": "case when code like '%7' then null else volume end"}


def _side_sql(c: str) -> str:
    pairs = f"select {c} as a, {_OTHER[c]} as b from ({panel_sql('E')})"
    equal = "case when a is null and b is null then 1 when abs(a - b) / nullif(abs(b), 0) < 1e-3 or abs(a - b) < 1e-2 then 1 else 0 end"
    return f"select '{c}' as feature_name, {r(f'avg({equal})', 'equal_ratio')}, {r('max(abs(a - b))', 'max_abs_diff')}, {r('corr(a, b)', 'correlation')} from ({pairs})"


@register("validation_columns", " union all ".join(map(_side_sql, _SIDES)))
def _validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame of features against another one that differs in known places."""
    p = panel(spark, sf_dir, "E")
    return validate(p.select("datetime", "code", *_SIDES), p.select("datetime", "code", *[F.expr(_OTHER[c]).alias(c) for c in _SIDES]))


_SHARES = {"low": 0.0, "p1": 0.01, "quarter": 0.25, "middle": 0.5, "p90": 0.9, "high": 1.0}
register("section_percentiles", f"select datetime, {', '.join(r(f'quantile_cont(close, {s})', name) for name, s in _SHARES.items())} from ({panel_sql('L')}) group by 1")(
    lambda s, d: section_percentiles(panel(s, d, "L"), "close", list(_SHARES.values()), "datetime").select("datetime", *[F.get("percentiles", F.lit(k)).alias(name) for k, name in enumerate(_SHARES)])
)

# evaluation
FACTORS = {"ma_ratio": n.Close() / n.Mean(n.Close(), 5), "volume_rank": n.Rank(n.Volume()), "momentum": lib.Momentum(3), "return": n.Close() / n.Ref(n.Close(), 1, "rows") - 1}
LEAST = 5


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_factors(panel(spark, sf_dir, "E"), FACTORS).withColumnsRenamed({"datetime": "timestamp", "code": "asset"})


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir).select("timestamp", "asset", F.col("ma_ratio").alias("factor_value"), "return")


WIDE_SQL = f"w as (select datetime as timestamp, code as asset, ma_ratio, volume_rank, momentum, \"return\" as ret from ({factors_sql(panel_sql('E'), FACTORS)}))"
BASE_SQL = f"{WIDE_SQL}, b as (select timestamp, asset, ma_ratio as fv, ret, lead(ret) over (partition by asset order by timestamp) as fwd from w)"
DATED_SQL = f"{BASE_SQL}, dd as (select timestamp, row_number() over (order by timestamp) as day, count(*) over () as days from (select distinct timestamp from b)), d as (select * from b join dd using (timestamp))"


def corr_sql(x: str, y: str) -> str:
    return f"covar_samp({x}, {y}) / nullif(stddev_samp(case when {y} is not null then {x} end) * stddev_samp(case when {x} is not null then {y} end), 0)"


def rank_sql(x: str, part: str) -> str:
    return f"case when {x} is not null then rank() over (partition by {part}, {x} is null order by {x}) + (count(*) over (partition by {part}, {x} is null, {x}) - 1) / 2.0 end"


def ic_sql(source: str, keys: str = "", method: str = "spearman") -> str:
    """CTEs from rows (keys, timestamp, fv, fwd) to ic(keys, timestamp, ic)."""
    k = f"{keys}, " if keys else ""
    ok = f"o as (select {k}timestamp, case when fv is not null and fwd is not null then fv end as x, case when fv is not null and fwd is not null then fwd end as y from {source})"
    rk = f"rk as (select {k}timestamp, {rank_sql('x', k + 'timestamp')} as x, {rank_sql('y', k + 'timestamp')} as y from o)" if method == "spearman" else "rk as (select * from o)"
    return f"{ok}, {rk}, ic as (select {k}timestamp, case when count(x) >= {LEAST} then {corr_sql('x', 'y')} end as ic from rk group by {k}timestamp)"


def metrics_sql(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"select {k}count(ic) as n, {r('avg(ic)', 'ic_mean')}, {r('stddev_samp(ic)', 'ic_std')}, {r('avg(ic) / nullif(stddev_samp(ic), 0)', 'icir')}, {r('avg(cast(ic > 0 as double))', 'ic_positive')}, {r('avg(abs(ic))', 'ic_abs_mean')}, {r('avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0)', 't_stat')} from ic" + (f" group by {keys}" if keys else "")


def part_sql(parts: str) -> str:
    """Metrics per part of rows (part, timestamp, asset, fv, ret)."""
    return f"with {DATED_SQL}, p0 as ({parts}), p as (select *, lead(ret) over (partition by part, asset order by timestamp) as fwd from p0), {ic_sql('p', 'part')} {metrics_sql('part')}"


for _m in ("pearson", "spearman"):
    register(f"ic_{_m}", f"with {BASE_SQL}, {ic_sql('b', '', _m)} select timestamp, {r('ic', 'ic')} from ic")(lambda s, d, m=_m: an.ic_series(base(s, d), m, 1, LEAST))
register("ic_metrics", f"with {BASE_SQL}, {ic_sql('b')} {metrics_sql()}")(lambda s, d: an.ic_metrics(an.ic_series(base(s, d), "spearman", 1, LEAST)))

NAMES = ["ma_ratio", "volume_rank", "momentum"]
LONG_SQL = f"{WIDE_SQL}, l as (select timestamp, asset, factor, fv, ret from w unpivot include nulls (fv for factor in (ma_ratio, volume_rank, momentum))), b as (select *, lead(ret) over (partition by factor, asset order by timestamp) as fwd from l)"


def long(s, d):
    return wide(s, d).unpivot(["timestamp", "asset", "return"], NAMES, "factor", "factor_value")


register("batch_ic", f"with {LONG_SQL}, {ic_sql('b', 'factor')} {metrics_sql('factor')}")(lambda s, d: an.batch_ic(long(s, d), "spearman", 1, LEAST))

# portfolios
Q = 4
LABEL_SQL = f"e as (select *, list_sort(list_distinct(list_value({', '.join(f'quantile_cont(fv, {k / Q}) over (partition by timestamp)' for k in range(Q + 1))}))) as edges from b), lab as (select timestamp, asset, fv, ret, fwd, case when fv is not null and len(edges) > 1 then len(list_filter(edges[2:-2], lambda v: v < fv)) end as quantile from e)"
GROUPS_SQL = f"gr as (select timestamp, {', '.join(f'avg(case when quantile = {k} then fwd end) as q{k + 1}' for k in range(Q))} from lab group by timestamp), gl as (select *, q{Q} - q1 as long_short from gr)"
SERIES_SQL = f"ser as (select timestamp, series, ret from gl unpivot include nulls (ret for series in ({', '.join([*(f'q{k + 1}' for k in range(Q)), 'long_short'])})))"


def labelled(s, d):
    return an.quantile_labels(an.forward_returns(base(s, d)), Q)


def series(s, d):
    return an.unpivoted(an.group_returns(labelled(s, d), Q), Q)


register("quantile_labels", f"with {BASE_SQL}, {LABEL_SQL} select timestamp, asset, {r('fv', 'factor_value')}, cast(quantile as integer) as quantile from lab")(lambda s, d: labelled(s, d).select("timestamp", "asset", "factor_value", "quantile"))
register("group_returns", f"with {BASE_SQL}, {LABEL_SQL}, {GROUPS_SQL} select timestamp, {', '.join(r(c, c) for c in [*(f'q{k + 1}' for k in range(Q)), 'long_short'])} from gl")(lambda s, d: an.group_returns(labelled(s, d), Q))
register(
    "portfolio_turnover",
    f"with {BASE_SQL}, {LABEL_SQL}, dd as (select timestamp, row_number() over (order by timestamp) as day from (select distinct timestamp from b)), d as (select * from lab join dd using (timestamp)) select a.timestamp, cast(p.quantile as integer) as was, {r('avg(cast(a.quantile <> p.quantile as double))', 'turnover')} from d a join d p on a.asset = p.asset and a.day = p.day + 1 where a.quantile is not null and p.quantile is not null group by 1, 2",
)(lambda s, d: an.turnover(labelled(s, d)))


def signed_log_sql(x: str) -> str:
    return f"sign({x}) * ln(1 + abs({x}))"


def with_logs(df: DataFrame, names: list[str]) -> DataFrame:
    """Compounded values on a logarithmic scale: the test prices jump so much that they don't compare by digits."""
    return df.withColumns({f"{c}_log": F.signum(c) * F.log(1 + F.abs(c)) for c in names}).drop(*names)


_wealth = "wl as (select *, product(1 + ret) over (partition by series order by timestamp) as wealth from ser where ret is not null), dr as (select *, wealth / nullif(max(wealth) over (partition by series order by timestamp), 0) - 1 as drawdown from wl)"
_annual = "case when product(1 + ret) > 0 then power(product(1 + ret), 252.0 / count(ret)) - 1 end"
register(
    "return_metrics",
    f"with {BASE_SQL}, {LABEL_SQL}, {GROUPS_SQL}, {SERIES_SQL}, {_wealth} select series, count(ret) as n, {r(signed_log_sql('product(1 + ret) - 1'), 'total_return_log')}, {r(signed_log_sql(_annual), 'annual_return_log')}, {r('stddev_samp(ret) * sqrt(252.0)', 'volatility')}, {r('avg(ret) * 252 / nullif(stddev_samp(ret) * sqrt(252.0), 0)', 'sharpe')}, {r('avg(ret) * 252 / nullif(stddev_samp(case when ret < 0 then ret end) * sqrt(252.0), 0)', 'sortino')}, {r('min(drawdown)', 'max_drawdown')}, {r('avg(cast(ret > 0 as double))', 'win_rate')}, {r('max(ret)', 'best')}, {r('min(ret)', 'worst')}, {r(signed_log_sql(f'({_annual}) / nullif(abs(min(drawdown)), 0)'), 'calmar_log')} from dr group by series",
)(lambda s, d: with_logs(an.return_metrics(series(s, d)), ["total_return", "annual_return", "calmar"]))
register("value_at_risk", f"with {BASE_SQL}, {LABEL_SQL}, {GROUPS_SQL}, {SERIES_SQL}, ed as (select series, quantile_cont(ret, 0.05) as edge from ser group by series) select series, {r('-any_value(edge)', 'var')}, {r('-avg(case when ret <= edge then ret end)', 'cvar')} from ser join ed using (series) group by series")(lambda s, d: an.value_at_risk(series(s, d)))
register(
    "beta_alpha",
    f"with {BASE_SQL}, {LABEL_SQL}, {GROUPS_SQL}, {SERIES_SQL}, bm as (select timestamp, avg(fwd) as bench from b group by timestamp), x as (select * from ser join bm using (timestamp) where ret is not null and bench is not null) select series, {r('covar_samp(ret, bench) / nullif(var_samp(bench), 0)', 'beta')}, {r('avg(ret) * 252 - covar_samp(ret, bench) / nullif(var_samp(bench), 0) * (avg(bench) * 252)', 'alpha')}, {r('avg(ret - bench) * sqrt(252.0) / nullif(stddev_samp(ret - bench), 0)', 'information_ratio')} from x group by series",
)(lambda s, d: an.beta_alpha(series(s, d), an.forward_returns(base(s, d)).groupBy("timestamp").agg(F.avg("forward").alias("bench"))))

# several factors
_known = " and ".join(f"{c} is not null" for c in NAMES)
for _m in ("pearson", "spearman"):
    _src = f"(select {', '.join(f'{rank_sql(c, chr(49))} as {c}' if _m == 'spearman' else c for c in NAMES)} from w where {_known})"
    _pairs = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]]
    register(f"factor_correlation_{_m}", f"with {WIDE_SQL}, k as {_src} " + " union all ".join(f"select '{a}' as a, '{b}' as b, {r(corr_sql(a, b), 'corr')} from k" for a, b in _pairs))(lambda s, d, m=_m: an.factor_correlation(wide(s, d), NAMES, m))


def zscore_sql(c: str, source: str = "timestamp") -> str:
    return f"case when stddev_samp({c}) over (partition by timestamp) > 0 then ({c} - avg({c}) over (partition by timestamp)) / stddev_samp({c}) over (partition by timestamp) else {c} end"


register("combine_equal", f"with {WIDE_SQL}, z as (select timestamp, asset, {', '.join(f'{zscore_sql(c)} as {c}' for c in NAMES)} from w) select timestamp, asset, {r('ma_ratio / 3.0 + volume_rank / 3.0 + momentum / 3.0', 'factor_value')} from z where {_known}")(lambda s, d: an.combined(wide(s, d), dict.fromkeys(NAMES, 1 / 3)))
_weights = f"raw as (select factor, greatest(coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0), 0) as x from ic group by factor), wt as (select {', '.join(f'''max(case when factor = '{c}' then x end) as w_{c}''' for c in NAMES)}, sum(x) as total from raw)"
_weighted = " + ".join(f"{c} * case when total > 0 then w_{c} / total else 1.0 / {len(NAMES)} end" for c in NAMES)
register("combine_icir", f"with {LONG_SQL}, {ic_sql('b', 'factor')}, {_weights}, z as (select timestamp, asset, {', '.join(f'{zscore_sql(c)} as {c}' for c in NAMES)} from w) select timestamp, asset, {r(_weighted, 'factor_value')} from z, wt where {_known}")(
    lambda s, d: an.combined(wide(s, d), an.combination_weights(an.batch_ic(long(s, d), "spearman", 1, LEAST), NAMES, "icir_weight"))
)
register("principal_components")(lambda s, d: an.principal_components(wide(s, d), NAMES)[0])

# preparation
register("winsorized", f"with {BASE_SQL} select timestamp, asset, {r('case when fv is not null then least(greatest(fv, quantile_cont(fv, 0.01) over (partition by timestamp)), quantile_cont(fv, 0.99) over (partition by timestamp)) end', 'factor_value')}, {r('ret', '\"return\"')} from b")(lambda s, d: an.winsorized(base(s, d)))
for _m, _x in (("zscore", zscore_sql("fv")), ("minmax", "case when fv is null then null when max(fv) over (partition by timestamp) > min(fv) over (partition by timestamp) then (fv - min(fv) over (partition by timestamp)) / (max(fv) over (partition by timestamp) - min(fv) over (partition by timestamp)) else 0.5 end"), ("rank", f"({rank_sql('fv', 'timestamp')}) / count(*) over (partition by timestamp)")):
    register(f"standardized_{_m}", f"with {BASE_SQL} select timestamp, asset, {r(_x, 'factor_value')} from b")(lambda s, d, m=_m: an.standardized(base(s, d), m).select("timestamp", "asset", "factor_value"))
_gap = "g as (select timestamp, asset, case when fv < 0.7 then null else fv end as fv from b)"
for _m, _x in (("forward", "last_value(fv ignore nulls) over (partition by asset order by timestamp rows between unbounded preceding and current row)"), ("backward", "first_value(fv ignore nulls) over (partition by asset order by timestamp rows between current row and unbounded following)"), ("mean", "coalesce(fv, avg(fv) over (partition by asset))"), ("zero", "coalesce(fv, 0)")):
    register(f"filled_{_m}", f"with {BASE_SQL}, {_gap} select timestamp, asset, {r(_x, 'factor_value')} from g")(lambda s, d, m=_m: an.filled(base(s, d).withColumn("factor_value", F.when(F.col("factor_value") >= 0.7, F.col("factor_value"))), m).select("timestamp", "asset", "factor_value"))
register("resampled_weekly", f"with {BASE_SQL} select cast(date_trunc('week', timestamp) as timestamp) as timestamp, asset, {r('arg_max_null(fv, timestamp)', 'factor_value')} from b group by 1, 2")(lambda s, d: an.resampled(base(s, d), "week"))

# parts
_P = "select *, '{0}' as part from d where {1}"
PERIOD_LIST = [("2024-01-01", "2024-01-10"), ("2024-01-08", "2024-01-20"), ("2024-01-15", "2024-02-15")]


def ic_parts(name: str, parts: Callable[[DataFrame], DataFrame], sql: str | None):
    register(name, None if sql is None else part_sql(sql))(lambda s, d: an.ic_by_part(parts(base(s, d)), "spearman", 1, LEAST))


ic_parts("ic_by_period", lambda df: an.by_period(df, PERIOD_LIST), " union all ".join(f"select 'period_{k + 1}' as part, timestamp, asset, fv, ret from d where timestamp between timestamp '{a}' and timestamp '{b}'" for k, (a, b) in enumerate(PERIOD_LIST)))
ic_parts("ic_rolling", lambda df: an.rolling_parts(df, 10, 5), "select k as part, timestamp, asset, fv, ret from d join range(0, 1000) t(k) on day > k * 5 and day <= k * 5 + 10 and k * 5 + 10 <= days")
ic_parts("ic_by_group", lambda df: an.by_group(df, df.select("asset").distinct().withColumn("part", (F.col("asset").cast("long") % 3).cast("string"))), "select cast(cast(asset as bigint) % 3 as varchar) as part, timestamp, asset, fv, ret from d")
ic_parts("ic_train_test", lambda df: an.train_test(df, 0.7), "select 'train' as part, timestamp, asset, fv, ret from d where day <= floor(days * 0.7) + 1 union all select 'test', timestamp, asset, fv, ret from d where day >= floor(days * 0.7) + 1")
ic_parts("ic_rolling_oos", lambda df: an.rolling_oos(df, 12, 6, 4), "select case when day - k * 4 <= 12 then 'train_' else 'test_' end || k as part, timestamp, asset, fv, ret from d join range(0, 1000) t(k) on day - k * 4 between 1 and 18 and k * 4 + 18 <= days")
ic_parts("ic_walk_forward", lambda df: an.walk_forward(df, 4), "select case when floor((day - 1) / floor(days / 5)) < k then 'train_' else 'test_' end || k as part, timestamp, asset, fv, ret from d join range(1, 5) t(k) on floor((day - 1) / floor(days / 5)) <= k")
ic_parts("ic_subsamples", lambda df: an.subsamples(df, 5, 0.8, 7), None)
register("stability_subsamples")(lambda s, d: an.stability(an.ic_by_part(an.subsamples(base(s, d), 5, 0.8, 7), "spearman", 1, LEAST)))
_early = {"f": n.Zscore(lib.Momentum(5))}
_cut = f"select * from ({panel_sql('E')}) where datetime <= timestamp '2024-01-15'"
register(
    "look_ahead",
    f"with a as (select * from ({factors_sql(panel_sql('E'), _early)}) where datetime <= timestamp '2024-01-15'), c as ({factors_sql(_cut, _early)}) select count(*) filter (round(a.f, 6) is distinct from round(c.f, 6)) as differing from a full join c on a.datetime = c.datetime and a.code = c.code",
)(lambda s, d: _look_ahead(s, d))


def _look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose factor, to six digits, changes when what comes after them is cut off: there are none."""
    p, cut = panel(spark, sf_dir, "E"), F.to_timestamp_ntz(F.lit("2024-01-15"))
    exprs = {"f": n.Zscore(lib.Momentum(5))}
    all_rows = with_factors(p, exprs).where(F.col("datetime") <= cut)
    past = with_factors(p.where(F.col("datetime") <= cut), exprs).withColumnRenamed("f", "g")
    return all_rows.join(past, ["datetime", "code"], "full_outer").agg(F.count_if(~F.round("f", DIGITS).eqNullSafe(F.round("g", DIGITS))).alias("differing"))


# what else is asked of parts, portfolios and preparation
LABELS_BY_VOLUME = f"qe as (select *, volume_rank as vr, list_sort(list_distinct(list_value({', '.join(f'quantile_cont(volume_rank, {k / 3}) over (partition by timestamp)' for k in range(4))}))) as edges from w), qp as (select timestamp, asset, ma_ratio as fv, ret, cast(len(list_filter(edges[2:-2], lambda v: v < vr)) + 1 as integer) as part from qe where vr is not null and len(edges) > 1)"
_by_volume = f"with {WIDE_SQL}, {LABELS_BY_VOLUME}, p as (select *, lead(ret) over (partition by part, asset order by timestamp) as fwd from qp), {ic_sql('p', 'part')}, m as ({metrics_sql('part')})"


def volume_parts(s, d):
    rows = wide(s, d).select("timestamp", "asset", F.col("ma_ratio").alias("factor_value"), "return", "volume_rank")
    return an.ic_by_part(an.by_quantile(rows, "volume_rank", 3), "spearman", 1, LEAST)


register("ic_by_quantile", f"{_by_volume} select * from m")(volume_parts)
register("ic_monotonicity", f"{_by_volume}, st as (select sign(ic_mean - lag(ic_mean) over (order by part)) as s from m) select {r('sum(s) / nullif(count(s), 0)', 'monotonicity')} from st")(lambda s, d: an.monotonicity(volume_parts(s, d)))
_train_test = part_sql("select 'train' as part, timestamp, asset, fv, ret from d where day <= floor(days * 0.7) + 1 union all select 'test', timestamp, asset, fv, ret from d where day >= floor(days * 0.7) + 1")
_pick = lambda side, c: f"max(case when part = '{side}' then {c} end)"
register(
    "out_of_sample",
    f"with m as ({_train_test}) select cast(0 as integer) as pair, {', '.join(r(_pick(side, c), n) for side, c, n in (('train', 'ic_mean', 'train_ic'), ('test', 'ic_mean', 'test_ic'), ('train', 'icir', 'train_icir'), ('test', 'icir', 'test_icir')))}, {r(_pick('test', 'ic_mean') + ' - ' + _pick('train', 'ic_mean'), 'ic_decay')}, {r(_pick('test', 'ic_mean') + ' / nullif(' + _pick('train', 'ic_mean') + ', 0)', 'ic_ratio')} from m",
)(lambda s, d: an.out_of_sample_test(base(s, d), min_periods=LEAST))
_windows = (3, 5, 8)
_by_window = {str(k): {"f": n.Close() / n.Mean(n.Close(), k), "return": FACTORS["return"]} for k in _windows}
_param_rows = " union all ".join(f"select '{k}' as part, datetime as timestamp, code as asset, f as fv, \"return\" as ret from ({factors_sql(panel_sql('E'), e)})" for k, e in _by_window.items())
register(
    "parameter_sensitivity",
    f"with p0 as ({_param_rows}), p as (select *, lead(ret) over (partition by part, asset order by timestamp) as fwd from p0), {ic_sql('p', 'part')}, m as (select part, avg(ic) as ic_mean, avg(ic) / nullif(stddev_samp(ic), 0) as icir from ic group by part) select count(*) as n_parts, {r('avg(ic_mean)', 'mean_ic')}, {r('max(ic_mean) - min(ic_mean)', 'ic_range')}, {r('stddev_samp(ic_mean)', 'ic_std')}, arg_max(part, icir) as best_part, {r('max(icir)', 'best_icir')}, {r('coalesce(1 - stddev_samp(ic_mean) / nullif(abs(avg(ic_mean)), 0), 0)', 'stability')} from m",
)(lambda s, d: an.robustness_test({k: with_factors(panel(s, d, "E"), e).withColumnsRenamed({"datetime": "timestamp", "code": "asset", "f": "factor_value"}) for k, e in _by_window.items()}, "parameter", min_periods=LEAST))
register("high_correlation", " union all ".join(f"select * from (with {WIDE_SQL}, k as (select {', '.join(NAMES)} from w where {_known}) select '{a}' as a, '{b}' as b, {r(corr_sql(a, b), 'corr')} from k) where abs(corr) >= 0.02" for a, b in _pairs))(lambda s, d: an.high_correlation(an.factor_correlation(wide(s, d), NAMES), 0.02))
register(
    "position_turnover",
    f"with {BASE_SQL}, wp as (select timestamp, asset, fv / sum(fv) over (partition by timestamp) as weight from b where fv is not null), dd as (select timestamp, row_number() over (order by timestamp) as day from (select distinct timestamp from wp)), x as (select day, asset, weight from wp join dd using (timestamp)), ch as (select coalesce(a.day, p.day + 1) as day, abs(coalesce(a.weight, 0) - coalesce(p.weight, 0)) as c from x a full join x p on a.asset = p.asset and a.day = p.day + 1) select dd.timestamp, {r('sum(c) / 2', 'turnover')} from ch join dd using (day) where day > 1 group by 1",
)(lambda s, d: an.position_turnover(base(s, d).where("factor_value IS NOT NULL").withColumn("weight", F.col("factor_value") / F.sum("factor_value").over(Window.partitionBy("timestamp"))).select("timestamp", "asset", "weight")))
register("aligned", f"with {BASE_SQL} select timestamp, asset, {r('fv', 'factor_value')}, {r('fwd', 'forward')} from b where fv is not null and fwd is not null")(lambda s, d: an.aligned(base(s, d).select("timestamp", "asset", "factor_value"), base(s, d).select("timestamp", "asset", "return")))
for _m, _x in (("rank", f"(({rank_sql('fv', 'timestamp')}) / nullif(count(fv) over (partition by timestamp), 0) - 0.5) * 3.46"), ("minmax", "(fv - min(fv) over (partition by timestamp)) / (max(fv) over (partition by timestamp) - min(fv) over (partition by timestamp) + 1e-8)")):
    register(f"processor_{_m}", f"with {BASE_SQL} select timestamp as datetime, asset as code, {r(_x, 'x')} from b")(lambda s, d, m=_m: {"rank": cs_rank, "minmax": cs_minmax}[m]()(base(s, d).select(F.col("timestamp").alias("datetime"), F.col("asset").alias("code"), F.col("factor_value").alias("x"))))
register(
    "align_timestamps",
    f"with e as ({panel_sql('E')}), t as (select cast(x as timestamp) + interval 15 hour as tm from range(timestamp '2024-01-08', timestamp '2024-01-20', interval 1 day) q(x) where isodow(x) < 6), g as (select tm, code from t, (select distinct code from e) where cast(tm as date) <= (select cast(max(datetime) as date) from e)) select g.tm as datetime, g.code, {r('arg_max(e.close, e.datetime)', 'close')} from g left join e on e.code = g.code and e.datetime <= g.tm group by 1, 2",
)(lambda s, d: align_timestamps(panel(s, d, "E").select("datetime", "code", "close"), calendar(s, "2024-01-08", "2024-01-19")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rank IC of price over its five-day mean against the next day's return."""
    return QUERIES["ic_spearman"](spark, sf_dir)
