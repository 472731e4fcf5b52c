"""Covariances, ranks, components and comparisons of many columns against NumPy and pandas."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ashlar.plans import analysis as an
from ashlar.plans import columns as co
from ashlar.streaming import bars as st


def arrays(spark, x, parts=5):
    return spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(parts)


def test_covariances_of_574_columns(spark):
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((700, 574)) * 10.0 ** rnd.integers(-1, 7, 574) + 10.0 ** rnd.integers(0, 6, 574)
    n, mean, cov = co.moments(arrays(spark, x, 7), 574)
    want = np.cov(x.T)
    scale = np.sqrt(np.outer(np.diag(want), np.diag(want)))
    assert n == 700 and np.allclose(mean, x.mean(axis=0)) and np.abs((cov - want) / scale).max() < 1e-9


def test_covariances_of_few_rows(spark):
    assert co.moments(arrays(spark, np.zeros((0, 3))), 3)[0] == 0
    n, mean, cov = co.moments(arrays(spark, np.array([[1.0, 2, 3]])), 3)
    assert n == 1 and mean.tolist() == [1, 2, 3] and np.isnan(cov).all()
    assert np.isnan(co.correlations(np.array([[1.0, 0], [0, 0]]))[0, 1])


@pytest.mark.parametrize("parts", [1, 6])
def test_ranks_with_ties_are_those_of_pandas(spark, parts):
    rnd = np.random.default_rng(3)
    x = np.column_stack([rnd.standard_normal(500), rnd.integers(0, 4, 500), np.where(rnd.random(500) < 0.7, 0.0, rnd.standard_normal(500)), np.zeros(500), rnd.integers(-3, 3, 500) * 0.5])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = np.array([r.x for r in co.ranks(arrays(spark, x, parts), 5).collect()])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = pd.DataFrame(x).rank().to_numpy()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_rank_correlation_of_many_factors(spark):
    rnd = np.random.default_rng(4)
    base = rnd.standard_normal((300, 4))
    x = np.round(base @ rnd.standard_normal((4, 60)) + 0.5 * rnd.standard_normal((300, 60)), 1)
    names = [f"f{i}" for i in range(60)]
    d = pd.DataFrame(x, columns=names)
    d.iloc[3, 5] = np.nan
    got = an.factor_correlation(spark.createDataFrame(d), names, "spearman").toPandas()
    want = d.dropna().corr("spearman")
    assert len(got) == 60 * 59 // 2 and all(abs(r.corr - want.loc[r.a, r.b]) < 1e-9 for r in got.itertuples())


def test_principal_components_are_those_of_numpy(spark):
    """Of z-scores per date, with a factor that is constant on a date and rows with missing values."""
    rnd = np.random.default_rng(5)
    rows, names = [], [f"f{i}" for i in range(6)]
    for day in range(8):
        x = rnd.standard_normal((40, 3)) @ rnd.standard_normal((3, 6)) + 0.2 * rnd.standard_normal((40, 6))
        if day == 2:
            x[:, 1] = 1.5
        x[3, 4] = np.nan
        rows += [(datetime(2024, 1, 1) + timedelta(days=day), f"a{k}", *map(float, r)) for k, r in enumerate(x)]
    d = pd.DataFrame(rows, columns=["timestamp", "asset", *names])
    schema = "timestamp timestamp_ntz, asset string, " + ", ".join(f"{c} double" for c in names)
    wide = spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in rows], schema).repartition(4)
    scores, vectors, ratio = an.principal_components(wide, names, n_components=4)
    score = lambda s: (s - s.mean()) / s.std() if s.std() > 0 else s
    z = d.groupby("timestamp")[names].transform(score).assign(timestamp=d.timestamp, asset=d.asset).dropna()
    values, turn = np.linalg.eigh(np.cov(z[names].T))
    values, turn = values[::-1], turn[:, ::-1].T
    assert np.allclose(ratio, (values / values.sum())[:4])
    turn *= np.sign(turn[np.arange(6), np.abs(turn).argmax(axis=1)])[:, None]
    assert np.allclose(vectors, turn[:4], atol=1e-8)
    want = pd.DataFrame((z[names] - z[names].mean()) @ turn[:4].T).assign(timestamp=z.timestamp, asset=z.asset).sort_values(["timestamp", "asset"])
    got = scores.toPandas().sort_values(["timestamp", "asset"])
    assert len(got) == len(want) and np.allclose(got[["pc1", "pc2", "pc3", "pc4"]], want[[0, 1, 2, 3]], atol=1e-8)
    kept = an.principal_components(wide, names, variance=0.5)[2]
    assert kept[:-1].sum() < 0.5 <= kept.sum()


def test_comparison_is_that_of_pandas(spark):
    rnd = np.random.default_rng(6)
    names = [f"f{i}" for i in range(30)] + ["money"]
    times = [datetime(2024, 1, 2, 14, 50) + timedelta(minutes=m) for m in range(12)]
    keys = [(t, f"c{k}") for t in times for k in range(9)]
    a = 1e6 + rnd.standard_normal((len(keys), 31)) * 10.0 ** rnd.integers(-3, 4, 31)
    b = np.where(rnd.random(a.shape) < 0.8, a, a + rnd.standard_normal(a.shape) * 10.0 ** rnd.integers(-4, 5, 31))
    b[:, 3] = 5.0
    holes = [(a, 0.05, np.nan), (b, 0.05, np.nan), (a, 0.02, np.inf), (b, 0.02, -np.inf), (a, 0.03, 0.0), (b, 0.03, 0.0)]
    for x, share, value in holes:
        x[rnd.random(x.shape) < share] = value
    a[:, 7] = b[:, 7] = np.nan
    schema = "datetime timestamp_ntz, code string, " + ", ".join(f"{c} double" for c in names)
    rows = lambda x: [(*k, *(None if np.isnan(v) and i % 2 else float(v) for i, v in enumerate(r))) for k, r in zip(keys, x, strict=True)]  # NaN or null
    report = st.validate(spark.createDataFrame(rows(a)[3:], schema).repartition(3), spark.createDataFrame(rows(b)[:-9], schema).repartition(2))
    got = {r.feature_name: r for r in report.collect()}
    assert sorted(got) == sorted(names)
    pick = [i for i, (t, _) in enumerate(keys) if (t.hour, t.minute) != (15, 0)]
    pick = [i for i in pick if i >= 3 and i < len(keys) - 9]
    for i, c in enumerate(names):
        x, y = (np.array([np.nan if np.isnan(v) and i % 2 else 0.0 if not np.isfinite(v) else v for v in m[pick, i]]) for m in (a, b))
        diff, ok = np.abs(x - y), ~np.isnan(x) & ~np.isnan(y)
        with np.errstate(all="ignore"):
            equal = (np.isnan(x) & np.isnan(y)) | (diff / np.where(y == 0, np.nan, np.abs(y)) < 1e-3) | (diff < (1e4 if c == "money" else 1e-2))
        r = got[c]
        assert r.equal_ratio == pytest.approx(equal.mean())
        assert (r.max_abs_diff is None and not ok.any()) or r.max_abs_diff == pytest.approx(diff[ok].max())
        if ok.any() and x[ok].std() > 0 and y[ok].std() > 0:
            assert r.correlation == pytest.approx(np.corrcoef(x[ok], y[ok])[0, 1], abs=1e-6)
        else:
            assert r.correlation is None
    assert st.validate(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0
    summary = st.validation_summary(report).first()
    assert summary.total_columns == 31 and summary.mean_equal_ratio == pytest.approx(np.mean([r.equal_ratio for r in got.values()]))


def test_one_exchange_a_side(spark):
    """The comparison shuffles each side once by row, whatever the number of columns; what follows are sums."""
    schema = "datetime timestamp_ntz, code string, f1 double, f2 double"
    a, b = (spark.createDataFrame([(datetime(2024, 1, 2, 9, 31), "x", 1.0, 2.0)], schema) for _ in range(2))
    plan = st.validate(a, b.where(F.col("f1") > 0))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(datetime") + plan.count("BroadcastExchange") <= 2 and "Expand" not in plan


def test_percentiles_of_sections_are_selected_by_ranges(spark):
    """One date with most rows, ties, missing values, a single row; and the labels and bounds made from them."""
    rnd = np.random.default_rng(7)
    days = [datetime(2024, 1, 1) + timedelta(days=k) for k in range(5)]
    rows = [(days[0], f"a{i}", float(rnd.standard_normal())) for i in range(4000)] + [(days[1], f"a{i}", float(rnd.integers(0, 3))) for i in range(200)]
    rows += [(days[2], f"a{i}", None if i % 3 else float(i)) for i in range(30)] + [(days[3], "a0", 4.0), (days[4], "a0", None)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, asset string, factor_value double").repartition(5)
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r.timestamp: r.percentiles for r in co.section_percentiles(df, "factor_value", shares).collect()}
    want = {t: np.percentile(x.dropna(), [100 * s for s in shares]) for t, x in pd.DataFrame(rows, columns=["t", "a", "x"]).groupby("t")["x"] if x.notna().any()}
    assert got.keys() == want.keys() and all(np.allclose(got[t], want[t], atol=1e-12) for t in want)
    key = ["timestamp", "asset"]
    for f in (lambda large: an.quantile_labels(df, 5, large=large), lambda large: an.winsorized(df, 0.05, 0.9, large=large)):
        a, b = (f(x).toPandas().sort_values(key).reset_index(drop=True) for x in (False, True))
        assert list(a.columns) == list(b.columns) and a[key].equals(b[key])
        for c in a.columns[2:]:
            assert np.allclose(a[c].astype(float), b[c].astype(float), atol=1e-12, equal_nan=True), c


def test_no_task_has_a_whole_section(spark):
    df = spark.range(20_000).select(F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("timestamp"), F.xxhash64("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which else joins parts as small as these
    try:
        x = df.repartitionByRange("timestamp", "v").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(x) > 2 and x.max() < 10_000
    assert co.section_percentiles(df, "v", [0.5]).first().percentiles[0] == pytest.approx(float(np.median(df.toPandas()["v"])))


def test_ranks_need_no_python_workers(spark, monkeypatch):
    """Half of a column has one value, which is in one part; the workers of tasks would add to an executor's memory."""
    rnd = np.random.default_rng(8)
    x = np.stack([np.where(rnd.random(3000) < 0.5, 2.0, rnd.normal(size=3000)), rnd.integers(-3, 3, 3000) / 7], axis=1)
    df = arrays(spark, x)
    monkeypatch.setattr(type(df), "mapInArrow", None)
    got = np.array([r.x for r in co.ranks(df, 2).collect()])
    want = pd.DataFrame(x).rank().to_numpy()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
