"""Readers, calendar, engine, registry, processors, streaming and monitoring."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ashlar.functions import factors as lib
from ashlar.functions import processors as pr
from ashlar.operators import nodes as n
from ashlar.plans import analysis as an
from ashlar.plans import engine as en
from ashlar.plans.registry import FactorMetadata, FactorMonitor, FactorRegistry, next_version
from ashlar.sources import readers as rd
from ashlar.sources.panels import panel
from ashlar.streaming import bars as st

DROP_HEAD = "time,code,open,close,high,low,volume,money\n"


@pytest.fixture
def bar_root(tmp_path):
    folder = tmp_path / "processed_data/日频数据/2024"
    folder.mkdir(parents=True)
    for code, k in (("510050", 1.0), ("510300", 2.0)):
        rows = [f"2024-01-{d:02d},{k * d},{k * d + 1},{k * d - 1},{k * d + 0.5},{100 * d},{1000 * d}" for d in range(1, 13)]
        (folder / f"{code}_daily.csv").write_text("date,open,high,low,close,volume,amount\n" + "\n".join(rows))
    return str(tmp_path)


def test_daily_reader(spark, bar_root):
    bars = rd.read_bars(spark, bar_root, "daily", ["510050"], "2024-01-03", "2024-01-05")
    assert [r.open for r in bars.orderBy("datetime").collect()] == [3.0, 4.0, 5.0]
    assert bars.columns == list(rd.COLUMNS)
    assert [r.code for r in rd.available_assets(spark, bar_root, "daily").collect()] == ["510050", "510300"]
    asked = spark.createDataFrame([("510050",), ("000001",)], "code string")
    assert {r.code: r.rows for r in rd.availability(asked, bars).collect()} == {"510050": 3, "000001": 0}
    with pytest.raises(ValueError):
        rd.read_bars(spark, bar_root, "yearly")


def test_engine_is_as_of_the_calendar(spark, bar_root):
    engine = en.FactorEngine(spark, bar_root)
    got = engine.compute_factor(n.Close(), None, "2024-01-08", "2024-01-12", en.daily()).where("asset = '510050'").orderBy("timestamp").collect()
    assert [r.timestamp for r in got] == [datetime(2024, 1, d, 15) for d in range(8, 13)]
    assert [r.factor_value for r in got] == [d + 0.5 for d in range(8, 13)]
    assert engine.benchmark_factor(n.Close(), None, "2024-01-08", "2024-01-09", en.daily())["total"] > 0


def test_resample(spark):
    rows = [(datetime(2024, 1, 2, 9, 30) + timedelta(minutes=m), "a", float(m), float(m + 1), float(m - 1), float(m) if m != 11 else None, 1.0, 2.0, "n") for m in range(12) if not 5 <= m < 10]
    out = rd.resample_bars(spark.createDataFrame(rows, "datetime timestamp_ntz, code string, open double, high double, low double, close double, volume double, amount double, name string"), 5).orderBy("datetime").collect()
    assert [(r.datetime.minute, r.open, r.close, r.volume) for r in out] == [(30, 0.0, 4.0, 5.0), (40, 10.0, 10.0, 2.0)]


def test_calendar(spark):
    grid = [r.datetime for r in en.calendar(spark, "2024-01-05", "2024-01-08", "30min").orderBy("datetime").collect()]
    assert len(grid) == 20 and grid[0] == datetime(2024, 1, 5, 9, 30) and grid[10].day == 8
    assert en.calendar(spark, "2024-01-01", "2024-01-07").count() == 5


def test_config():
    with pytest.raises(ValueError):
        en.FrequencyConfig("daily", 20, "minute")
    with pytest.raises(ValueError):
        en.FrequencyConfig("daily", 0)
    assert en.minute().calc_freq == "5min" and en.daily().buffer_days() == 40


def test_validation_and_bias(spark, sf_dir):
    p = panel(spark, sf_dir, "E")
    r = en.validation_report(p.unionByName(p.limit(3))).first()
    assert r.duplicates == 3 and r.missing_columns == []
    day = str(p.orderBy("datetime").first().datetime + timedelta(days=12))
    assert en.future_bias(p, lib.Momentum(3), [day]).first().differing == 0
    assert en.compare_factors(p, n.Close(), n.Close()).first().max_abs_diff == 0


def test_look_ahead_is_found_in_the_tree():
    """A planted lead is named, wherever it stands; what a lag above takes back is none."""
    from ashlar.plans.expr import field, node

    close = field("close")
    lead = node("lead", close, params=(2,))
    assert [(r.node.key, r.last) for r in en.look_ahead(n.Zscore(lib.Momentum(3) + lead))] == [(lead.key, 2)]
    assert en.look_ahead(node("lag", lead, params=(2,))) == [] and en.look_ahead(node("lag", lead, params=(5,)) + close) == []
    assert [r.node.key for r in en.look_ahead(node("lag", lead, params=(1,)))] == [lead.key]
    back = node("lag", close, params=(-3,))
    assert [(r.node.key, r.last) for r in en.look_ahead(node("part", lead * back, params=("mean", 4)))] == [(back.key, 3), (lead.key, 2)]
    reads = {r.node.op: (r.first, r.last) for r in en.row_reads(node("part", node("lag", close, params=(3,)), params=("mean", 5)))}
    assert reads == {"field": (0, 0), "lag": (-3, -3), "part": (-7, -3)}


def test_no_factor_or_feature_looks_ahead():
    from ashlar.functions.minute_features import features
    from ashlar.plans.expr import TAILS

    for rows in (None, 0, TAILS):
        assert not any(en.look_ahead(e) for e in features(rows=rows).values())
    assert en.look_ahead(lib.Momentum(3)) == []


def test_planted_lead_shows_in_both_checks(spark, sf_dir):
    from ashlar.plans.expr import field, node

    p = panel(spark, sf_dir, "E")
    day = str(p.orderBy("datetime").first().datetime + timedelta(days=12))
    for factor in (node("lead", field("close"), params=(1,)), node("lag", node("lead", field("close"), params=(1,)), params=(1,))):
        assert bool(en.look_ahead(factor)) == (en.future_bias(p, factor, [day]).first().differing > 0)


def test_times_past_the_data_are_refused(spark, sf_dir):
    p = panel(spark, sf_dir, "E")
    end = p.orderBy(F.desc("datetime")).first().datetime
    times = spark.createDataFrame([(end,), (end - timedelta(days=1),)], "datetime timestamp_ntz")
    assert en.validate_times(p, times).count() == 2
    with pytest.raises(ValueError, match="1 times are past"):
        en.validate_times(p, times.unionByName(spark.createDataFrame([(end + timedelta(seconds=1),)], "datetime timestamp_ntz")))
    with pytest.raises(ValueError, match="no rows"):
        en.validate_times(p.limit(0), times)


def test_node_report(spark, sf_dir):
    p = panel(spark, sf_dir, "E")
    r = en.node_report(p, n.Zscore(lib.Momentum(3)), en.FrequencyConfig("daily", 120))
    assert r["nodes"] == sum(1 for _ in n.Zscore(lib.Momentum(3)).walk()) and r["stages"] >= 2 and all(t > 0 for t in r["seconds"].values())
    assert len(r["seconds"]) >= 2 and any("100 rows" in a for a in r["advice"])


def test_previous_trade_date(spark):
    rows = [(datetime(2024, 1, d, 10), "a") for d in (2, 3, 5)]
    bars = spark.createDataFrame(rows, "time timestamp_ntz, symbol string")
    assert [str(rd.previous_trade_date(bars, d)) for d in ("2024-01-02", "2024-01-05", "2024-01-09")] == ["None", "2024-01-03", "2024-01-05"]


def test_registry(tmp_path, spark, sf_dir):
    path = str(tmp_path / "r.json")
    reg = FactorRegistry(path)
    a = reg.register_factor(lib.Momentum(3), [en.daily()], FactorMetadata("mom", "three days", "momentum", tags=["x"]))
    b = reg.register_factor(lib.PriceToMA(5), [en.daily()], FactorMetadata("ma", "five days", "value"))
    assert reg.create_version(a, lib.Momentum(5), [en.daily()], "longer") == "v1.1.0"
    assert reg.compare_versions(a, "v1.0.0", "v1.1.0") == {"factor_changed": True, "configs_changed": False}
    reg.rollback(a, "v1.0.0")
    again = FactorRegistry(path)
    assert again.get_factor(a)[0].key == lib.Momentum(3).key and again.list_versions(a) == ["v1.1.0", "v1.0.0"]
    assert [m.name for m in again.search_factors("FIVE")] == ["ma"] and again.counts()["testing"] == 2
    gid = again.create_group("g", [a, b], tags=["t"])
    with pytest.raises(KeyError):
        again.create_group("h", ["nope"])
    mon = FactorMonitor(again)
    got = mon.batch_evaluate([a, b], panel(spark, sf_dir, "E"))
    assert {r.factor for r in got.collect()} == {a, b} and mon.compare_groups([gid], panel(spark, sf_dir, "E")).count() == 1
    assert set(mon.evaluate(a, panel(spark, sf_dir, "E"))) == set(mon.METRICS)
    assert again.as_table(spark).where("array_contains(tags, 'x')").count() == 1
    assert next_version("v1.2.3", "patch") == "v1.2.4" and next_version("bad", "major") == "v2.0.0"


def test_processors(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), c, x) for c, x in zip("abc", [1.0, 2.0, None], strict=True)], "datetime timestamp_ntz, code string, v_5min double")
    z = {r.code: r.v_5min for r in pr.cs_zscore()(df).collect()}
    assert z["a"] == pytest.approx(-(0.5**0.5), abs=1e-6) and z["c"] is None
    s = pr.split_mixed(["v_60min"])(pr.fillna(0.0)(df)).orderBy("code").collect()
    assert [r.v_5min_ctn for r in s] == [1.0, 2.0, None] and [r.v_5min_dummy for r in s] == [True, True, False]
    assert "v_5min_exp" in pr.nonlinear()(df).columns and pr.dropna()(df).count() == 2


def test_t_distribution():
    assert an.t_p_value(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert an.t_quantile(0.975, 10) == pytest.approx(2.2281389, abs=1e-6)


def write_bar(folder, minute, codes=("000001", "600000", "200001"), bump=0.0):
    rows = [f"2024-01-02 09:{minute}:00,{c},{10 + k + bump},{10.5 + k + bump},{11 + k},{9 + k},{100 + minute},{1000}" for k, c in enumerate(codes)]
    (folder / f"kbar_09{minute}.csv").write_text(DROP_HEAD + "\n".join(rows))


def test_stream_is_batch(spark, tmp_path):
    """Minute by minute, late bars included, gives the rows of one batch."""
    drop = tmp_path / "drop"
    drop.mkdir()
    store = st.BarStore(spark, str(tmp_path / "store"), ("microstructure",))
    for minute in (31, 32, 34, 33, 35):  # 33 comes after its successor
        write_bar(drop, minute)
        if minute != 34:
            st.run_stream(spark, str(drop), store, str(tmp_path / "cp")).awaitTermination()
    streamed = store.features().drop("date", "bar")
    times = [r.time for r in store.bars().select("time").distinct().collect()]
    batch = st.features_at(rd.read_drop_files(spark, str(drop)), times, ("microstructure",))
    report = st.validate(streamed, batch)
    assert streamed.count() == batch.count() == 10 and report.where("equal_ratio < 1").count() == 0
    assert st.validation_summary(report).first().matched_columns == 41
    assert {r.symbol for r in store.bars().collect()} == {"000001", "600000"}
    assert st.feature_stats(batch).count() == 5 * 41 and st.bar_metrics(batch).first().n_symbols == 2


def test_long_codes_look_back_on_all_rows(spark):
    """Stream and pipeline over 6,000 bars of a code: exponential means of all rows, and an early date's rows."""
    import numpy as np

    from ashlar.functions.processors import FeaturePipeline

    n, rnd = 6000, np.random.default_rng(1)
    close = 10 * np.exp(np.cumsum(rnd.normal(0, 1e-3, n)))
    volume = rnd.uniform(100, 1000, n)
    times = [datetime(2024, 1, 1) + timedelta(minutes=k) for k in range(n)]
    bars = spark.createDataFrame([(t, "a", float(c), float(c), float(c), float(c), float(v), 1.0) for t, c, v in zip(times, close, volume, strict=True)], "time timestamp_ntz, symbol string, open double, close double, high double, low double, volume double, money double")
    x = np.concatenate([[0.0], np.diff(close) / close[:-1]]) * np.log1p(volume)  # a first row has a return of 0

    def mean(half_life, last):
        w = 0.5 ** (np.arange(last + 1)[::-1] / half_life)
        return (x[: last + 1] * w).sum() / w.sum()

    asked = [times[k] for k in (1000, 3000, n - 1)]
    for r in st.features_at(bars, asked, ("sentiment_cycle",)).collect():
        for h in (15, 60, 241):
            assert r[f"sentiment_memory_{h}min"] == pytest.approx(mean(h, times.index(r.datetime)), rel=1e-6, abs=1e-9)
    early = FeaturePipeline(("sentiment_cycle",)).process(st.as_panel(bars), "2024-01-01")
    assert early.count() == 1440


def test_fills(spark):
    t = lambda m: datetime(2024, 1, 2, 9, m)
    schema = "time timestamp_ntz, symbol string, open double, close double, high double, low double, volume double, money double"
    bars = spark.createDataFrame([(t(31), s, 1.0, 2.0, 2.0, 1.0, 5.0, 5.0) for s in "ab"] + [(t(32), "a", 1.0, 3.0, 3.0, 1.0, 5.0, 5.0)], schema)
    symbols = spark.createDataFrame([("a",), ("b",)], "symbol string")
    assert st.forward_fill(bars, symbols).count() == 3  # half are missing: too many
    made = st.forward_fill(bars, symbols, 0.5).where("symbol = 'b'").orderBy("time").collect()[-1]
    assert (made.time, made.open, made.volume) == (t(32), 2.0, 0.0)
    auction = rd.auction_bars(spark.createDataFrame([("a", 7.0, 1.0, 1.0)], "symbol string, current double, volume double, money double"), "2024-01-03")
    assert {r.symbol: r.open for r in st.fill_auction(auction, bars, symbols, "2024-01-03").collect()} == {"a": 7.0, "b": 2.0}
    assert st.expected_bars(spark, "2024-01-02").count() == 240
    both = rd.with_fallback(bars.where("symbol = 'a'"), bars)
    assert {(r.symbol, r.source) for r in both.collect()} == {("a", "first"), ("b", "second")}
    up = st.upsert(spark.createDataFrame([(1, 2.0, "x")], "k int, v double, s string"), spark.createDataFrame([(1, 3.0), (2, 4.0)], "k int, v double"), ["k"])
    assert {(r.k, r.v, r.s) for r in up.collect()} == {(1, 3.0, "x"), (2, 4.0, None)}


def test_dated_sink(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2024, 1, d), "a", float(d)) for d in (1, 2, 3)], "datetime timestamp_ntz, code string, x double")
    sink = rd.DatedSink(str(tmp_path / "out"))
    sink.save(df, start="2024-01-02")
    sink.save(df.where("x = 3").withColumn("x", df.x * 10))
    assert sorted(r.x for r in spark.read.parquet(sink.path).collect()) == [2.0, 30.0]
