"""Operators that no query runs: readers of finer bars, splits, weights, the registry's checks, handlers and pipelines of features."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_tails import SCHEMA, bars, rows

from ashlar.functions import factors as lib
from ashlar.functions import processors as pr
from ashlar.functions.minute_features import features
from ashlar.plans import analysis as an
from ashlar.plans import engine as en
from ashlar.plans.registry import FactorLibrary, FactorMetadata
from ashlar.plans.snapshot import median_close
from ashlar.sources import readers as rd
from ashlar.sources.panels import panel


@pytest.fixture(scope="module")
def frame(spark):
    rnd = np.random.default_rng(1)
    out = [(datetime(2024, 1, 1) + timedelta(days=d), f"a{k}", float(rnd.standard_normal()), float(rnd.standard_normal()) / 50) for d in range(20) for k in range(12)]
    return spark.createDataFrame(out, "timestamp timestamp_ntz, asset string, factor_value double, return double")


@pytest.mark.parametrize(("frequency", "step"), [("30min", 30), ("minute", 1)])
def test_finer_bars_are_read(spark, tmp_path, frequency, step):
    """Codes by file name, or by column where minute files have one; dates inclusive; what can't be read as a number is missing."""
    glob, _ = rd.LAYOUTS[frequency]
    for code, k in (("510050", 1.0), ("510300", 2.0)):
        name = tmp_path / glob.replace("*/", "2024/").replace("*", code if frequency == "30min" else f"{code}_2024")
        name.parent.mkdir(parents=True, exist_ok=True)
        lines = [f"{datetime(2024, 1, d, 9, 30) + timedelta(minutes=step * m)},{k},{k + 1},{k - 1},{'x' if m == 1 else k},{m},5" for d in (2, 3, 4) for m in range(3)]
        name.write_text("datetime,open,high,low,close,volume,amount\n" + "\n".join(lines))
    got = rd.read_bars(spark, str(tmp_path), frequency, ["510300"], "2024-01-03", "2024-01-03").orderBy("datetime").collect()
    assert [(r.code, r.datetime, r.open, r.close) for r in got] == [("510300", datetime(2024, 1, 3, 9, 30) + timedelta(minutes=step * m), 2.0, None if m == 1 else 2.0) for m in range(3)]
    assert {r.code for r in rd.available_assets(spark, str(tmp_path), frequency).collect()} == {"510050", "510300"}


def test_last_days_before_a_day(spark):
    times = [datetime(2024, 1, d, h) for d in (2, 3, 4, 8, 9) for h in (10, 14)]
    b = spark.createDataFrame([(t, "a") for t in times], "time timestamp_ntz, symbol string")
    assert sorted(r.time for r in rd.last_days(b, "2024-01-09", 3).collect()) == [t for t in times if t.day in (3, 4, 8)]


def test_trading_times(spark):
    asked = ["2024-01-05 09:29", "2024-01-05 09:30", "2024-01-05 11:30", "2024-01-05 11:31", "2024-01-05 13:00", "2024-01-05 15:00", "2024-01-05 15:01", "2024-01-06 10:00"]
    got = spark.createDataFrame([(t,) for t in asked], "t string").select("t", en.in_session(F.to_timestamp_ntz("t")).alias("open")).collect()
    assert [r.t for r in got if r.open] == [asked[1], asked[2], asked[4], asked[5]]


def test_frames_are_validated_and_summed_up(spark, frame):
    data = an.FactorData.from_frame(frame.withColumn("factor_value", F.when(F.col("asset") != "a0", F.col("factor_value"))), "f", "2024-01-03", "2024-01-10")
    v, s = data.validate().first(), data.summary().first()
    d = data.frame.toPandas()
    assert v.rows == 8 * 12 == len(d) and v.factor_value_missing == pytest.approx(1 / 12) and v.return_missing == 0
    want = d.factor_value.describe()
    assert [s["count"], s["mean"], s["std"], s["min"], s["q25"], s["median"], s["q75"], s["max"]] == pytest.approx(want.tolist())
    with pytest.raises(ValueError, match="missing columns"):
        an.FactorData.from_frame(frame.drop("return"), "f")
    assert data.frame.columns == ["timestamp", "asset", "factor_value", "return"]  # long, a row per time and asset


def test_splits(spark, frame):
    train, test = an.split_train_test(frame, 0.7)
    assert train.count() == 14 * 12 and test.count() == 6 * 12 and train.columns == frame.columns
    assert train.agg(F.max("timestamp")).first()[0] < test.agg(F.min("timestamp")).first()[0]
    a, b = an.split_train_test(frame, 0.5, by_time=False)
    assert a.count() + b.count() == frame.count() and 0 < a.count() < frame.count() and a.intersect(b).isEmpty()


def test_weights_of_factors(spark):
    m = spark.createDataFrame([("a", 0.03, 0.5), ("b", -0.06, -0.4), ("c", 0.01, 1.5)], "factor string, ic_mean double, icir double")
    names = ["a", "b", "c"]
    assert an.combination_weights(m, names) == {n: pytest.approx(1 / 3) for n in names}
    assert an.combination_weights(m, names, "ic_weight") == {"a": pytest.approx(0.3), "b": pytest.approx(0.6), "c": pytest.approx(0.1)}
    assert an.combination_weights(m, names, "optimal") == {"a": pytest.approx(0.25), "b": 0, "c": pytest.approx(0.75)}
    none = spark.createDataFrame([(n, None, None) for n in names], m.schema)
    assert an.combination_weights(none, names, "ic_weight") == {n: pytest.approx(1 / 3) for n in names}


def test_trend_is_the_slope_of_a_line(spark):
    y = [0.01, 0.04, 0.02, None, 0.07]
    m = spark.createDataFrame([(k, v, v) for k, v in enumerate(y)], "part int, ic_mean double, icir double")
    r = an.trend(m).first()
    k = [i for i, v in enumerate(y) if v is not None]
    known = [v for v in y if v is not None]
    assert r.slope == pytest.approx(np.polyfit(k, known, 1)[0]) and r.icir_std == pytest.approx(np.std(known, ddof=1))


def test_subsamples_are_shares_of_the_dates(spark, frame):
    """Each part has the asked share of dates, whole dates, its own choice, and the same one again; stability is that of the parts' means."""
    parts = an.subsamples(frame, 6, 0.8, seed=3)
    got = parts.groupBy("part").agg(F.count_distinct("timestamp").alias("days"), F.count("*").alias("n"), F.sort_array(F.collect_set("timestamp")).alias("t")).orderBy("part").collect()
    assert [(r.part, r.days, r.n) for r in got] == [(k, 16, 192) for k in range(6)] and len({tuple(r.t) for r in got}) > 1
    again = an.subsamples(frame, 6, 0.8, seed=3).groupBy("part").agg(F.sort_array(F.collect_set("timestamp")).alias("t")).orderBy("part").collect()
    assert [r.t for r in again] == [r.t for r in got]
    ic = an.ic_by_part(parts, "pearson", min_periods=5)
    metrics = an.ic_metrics(ic, "part") if "ic_mean" not in ic.columns else ic
    m = metrics.toPandas()
    want = {}
    d = parts.toPandas().sort_values("timestamp")
    for part, x in d.groupby("part"):
        x = x.assign(forward=x.groupby("asset")["return"].shift(-1)).dropna()
        want[part] = x.groupby("timestamp").apply(lambda s: s.factor_value.corr(s.forward), include_groups=False).mean()
    assert {r.part: r.ic_mean for r in m.itertuples()} == {k: pytest.approx(v) for k, v in want.items()}
    s, means = an.stability(metrics).first(), pd.Series(want)
    assert s.stability == pytest.approx(1 - means.std() / abs(means.mean())) and s.mean == pytest.approx(means.mean())


@pytest.mark.parametrize("missing", ["name", "description", "category"])
def test_metadata_needs_its_texts(missing):
    with pytest.raises(ValueError, match=missing):
        FactorMetadata(**({"name": "n", "description": "d", "category": "c"} | {missing: ""}))


def test_library(spark, sf_dir, tmp_path):
    path = str(tmp_path / "library.json")
    key = FactorLibrary(path).register(lib.Momentum(3), [en.daily()], FactorMetadata("mom", "momentum of three rows", "trend"))
    library = FactorLibrary(path)
    assert [m.name for m in library.list()] == ["mom"] and str(library.get(key)) == str(lib.Momentum(3))
    assert library.evaluate(key, panel(spark, sf_dir, "E"))


def test_levels_follow_the_median(spark):
    assert median_close(spark.createDataFrame([(1.0,), (9.0,), (2.0,), (None,)], "close double")) == 2.0
    assert median_close(spark.createDataFrame([], "close double")) == 50.0
    for median, first in ((0.5, 0.001), (5.0, 0.1), (50.0, 1), (500.0, 10)):
        distance = features(("round_number",), median)["round_1_distance"]
        assert any(e.op == "const" and e.params[0] == first for e in distance.walk())


@pytest.fixture(scope="module")
def minute_bars(spark):
    d = pd.concat([bars(300, "a", 1), bars(300, "b", 2), bars(40, "c", 3)])
    return spark.createDataFrame(rows(d), SCHEMA)


def test_pipeline_of_one_family(spark, minute_bars):
    p = pr.FeaturePipeline(("microstructure",), fill=-7.0)
    plain = p.process(minute_bars)
    names = list(features(("microstructure",)))
    filled = {r.code: r.asDict() for r in p.run(minute_bars).collect()}
    assert plain.count() == 3 and set(plain.columns) == {"datetime", "code", *names}
    for r in plain.collect():  # the short code has gaps, which are filled
        for n in names:
            assert filled[r.code][n] == (-7.0 if r[n] is None else r[n])
    assert any(v == -7.0 for v in filled["c"].values()) and not any(v == -7.0 for v in filled["a"].values())
    assert any(r[n] is None for r in p.run(minute_bars, fill=False).collect() for n in names)
    day = p.process(minute_bars, "2024-01-02")
    assert day.count() == 640 and p.process(minute_bars, "2024-01-03").count() == 0


def test_normalized_pipeline(spark, minute_bars):
    p = pr.FeaturePipeline(("microstructure",))
    one = p.process(minute_bars.where("code != 'c'"), "2024-01-02").where(F.date_format("datetime", "HH:mm") == "14:00").persist()
    out = p.normalize(one, "microstructure")
    by_hand = pr.nonlinear()(pr.split_mixed(list(features(("microstructure",))))(one))
    assert out.columns == by_hand.columns and set(out.columns) >= {"datetime", "code"} and out.count() == one.count()
    got, want = (df.toPandas().sort_values("code").reset_index(drop=True) for df in (out, by_hand))
    for c in got.columns[2:]:
        if got[c].dtype.kind == "f":
            assert np.allclose(got[c], want[c], equal_nan=True)


@pytest.mark.parametrize("norm", ["zscore", "rank", "minmax"])
def test_handler_views(spark, norm):
    """Raw, inference and learning views of a handler, each a chain of the ones before."""
    df = spark.createDataFrame([(datetime(2024, 1, 2), c, x) for c, x in (("a", 1.0), ("b", None), ("c", 4.0), ("d", 2.0))], "datetime timestamp_ntz, code string, x double")
    norms = {"zscore": pr.cs_zscore, "rank": pr.cs_rank, "minmax": pr.cs_minmax}
    h = pr.FeatureDataHandler(shared=[lambda d: d.withColumn("x", F.col("x") * 2)], infer=[pr.fillna(0.0), norms[norm]()], learn=[lambda d: d.where("code != 'd'")])
    assert {r.code: r.x for r in h.fetch(df, "raw").collect()} == {"a": 1.0, "b": None, "c": 4.0, "d": 2.0}
    x = pd.Series({"a": 2.0, "b": 0.0, "c": 8.0, "d": 4.0})
    want = {"zscore": (x - x.mean()) / (x.std() + 1e-8), "rank": (x.rank() / 4 - 0.5) * 3.46, "minmax": (x - x.min()) / (x.max() - x.min() + 1e-8)}[norm]
    assert {r.code: r.x for r in h.fetch(df).collect()} == {c: pytest.approx(v) for c, v in want.items()}
    assert sorted(r.code for r in h.fetch(df, "learn").collect()) == ["a", "b", "c"]
    with pytest.raises(KeyError):
        h.fetch(df, "other")


def test_default_handler_is_features_filled_and_normalised(spark, minute_bars):
    small = minute_bars.where(F.col("datetime") < datetime(2024, 1, 2, 9, 36))
    h = pr.default_handler("minmax")
    found = h.fetch(small)
    assert found.count() == 18 and len(found.columns) == 576
    values = np.concatenate([[v for v in r[2:]] for r in found.collect()]).astype(float)
    assert not np.isnan(values).any() and values.min() >= 0 and values.max() <= 1


def test_equal_values_have_no_correlation_in_many_tasks(spark):
    """(1 / 49) * 49 isn't 1, so merging the sums of two tasks of 49 rows leaves a rest of a variance."""
    rows = spark.range(0, 98, 1, 2).select(F.lit("2024-01-01").cast("timestamp_ntz").alias("timestamp"), F.lit(1.0).alias("factor_value"), F.sin("id").alias("forward"))
    assert an.daily_ic(rows, "pearson", 5).first().ic is None
    metrics = an.ic_metrics(spark.range(0, 98, 1, 2).select(F.lit(1.0).alias("ic"))).first()
    assert (metrics.ic_std, metrics.icir, metrics.t_stat) == (0.0, None, None)
    assert an.beta_alpha(rows.select("timestamp", F.lit("a").alias("series"), F.col("forward").alias("ret")), rows.limit(1).select("timestamp", F.lit(1.0).alias("bench"))).first().beta is None
    flat = rows.select(F.lit(0.1).alias("a"), F.col("forward").alias("b"))
    assert an.factor_correlation(flat, ["a", "b"]).first()["corr"] is None
