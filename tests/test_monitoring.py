"""Metrics tables, log events, feature files as a stream, dispatchers of tests, and the registry's views."""

from datetime import datetime, timedelta

import pytest

from ashlar.functions import factors as lib
from ashlar.operators import nodes as n
from ashlar.plans import analysis as an
from ashlar.plans import engine as en
from ashlar.plans.registry import FactorMetadata, FactorMonitor, FactorRegistry
from ashlar.sources.panels import panel
from ashlar.streaming import monitoring as mo

LOG = """\
[CSV] read kbar_0931.csv rows=5190 symbols=5188 attempt 2
[1/241] Bar 2026-03-02 09:31:00 complete 21.5s, source=csv
[JQ fallback attempt 1/3] bar 09:32
[JQ fallback attempt 3/3] bar 09:32
[JQ] bar=09:32 rows 5000 symbols 4999
/out/093200.parquet rows 4999
Bar 2026-03-02 09:32:00 complete 30.25s, source=jq
第 2/5 次拉取, 期望 bar: 2026-03-02 09:33:00
get_price 异常 (attempt 2): timed out
达到最大重试次数 5，放弃本轮拉取
Bar 校验通过: time=2026-03-02 09:34:00, symbols=5100
耗时: 12.5s
/out/093400.parquet rows 5100
Bar 2026-03-02 09:35:00 两级 fallback 均失败 且 已跳过
收盘时仍有 2 个未补全 bar: [2026-03-02 10:00:00, 2026-03-02 10:01:00]
nothing of interest
交易日结束，脚本正常退出""".split("\n")


@pytest.fixture
def events(spark):
    lines = [("a.log", k, v) for k, v in enumerate(LOG)] + [("b.log", 0, LOG[0]), ("b.log", 1, LOG[1].replace("21.5", "1.5"))]
    return mo.log_events(spark.createDataFrame(lines, "path string, line long, value string"))


def test_log_events(events):
    got = [tuple(r)[2:] for r in events.orderBy("path", "line", "bar_time").collect()]
    assert got == [
        ("bar_complete", "09:31:00", 21.5, 0, 5188, None), ("bar_complete", "09:32:00", 30.25, 3, 4999, None), ("abandon", "09:33:00", None, 5, None, "timed out"), ("bar_complete", "09:34:00", 12.5, 0, 5100, None),
        ("abandon", "09:35:00", None, 0, None, "csv and jqdata fallback failed"), ("abandon", "10:00:00", None, 0, None, "market close with unfilled pending bar"), ("abandon", "10:01:00", None, 0, None, "market close with unfilled pending bar"),
        ("exit", None, None, None, None, None), ("bar_complete", "09:31:00", 1.5, 0, 5188, None),
    ]


def test_lines_of_files_keep_their_order(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(LOG), encoding="utf-8")
    got = mo.numbered(spark.read.text(str(tmp_path))).orderBy("line").collect()
    assert [r.value for r in got] == LOG


def test_metrics_store(spark, tmp_path, events):
    store = mo.MetricsStore(spark, str(tmp_path / "m"), "2026-03-02")
    t = datetime(2026, 3, 2, 9, 31)
    f = spark.createDataFrame([(t, "a", 1.0, None), (t, "b", 3.0, float("inf")), (t + timedelta(minutes=1), "a", 2.0, 5.0)], "datetime timestamp_ntz, code string, x double, y double")
    store.record_bar(f, 10.0)
    store.record_bar(f.where("code = 'a'"), 11.0, retries=1)
    store.upsert_bar_metrics("09:31:00", cost_seconds=12.0)
    store.record_abandon("09:32:00", 5, "late")
    store.record_feature_stats(f)
    store.record_timing("09:31:00", 12.0, "csv")
    store.record_validation(spark.createDataFrame([("x", 1.0, 0.0, 1.0), ("y", 0.5, 2.0, 0.1)], "feature_name string, equal_ratio double, max_abs_diff double, correlation double"), 3, ("y",))
    bars = {r.bar_time: r for r in store.read("bar_metrics").collect()}
    assert (bars["09:31:00"].cost_seconds, bars["09:31:00"].n_symbols, bars["09:31:00"].status, bars["09:32:00"].status, bars["09:32:00"].retry_count) == (12.0, 1, "ok", "abandon", 5)
    assert [r.reason for r in store.read("abandon_events").collect()] == ["late"]
    stats = {(r.bar_time, r.feature_name): r for r in store.read("feature_stats").collect()}
    assert (stats["09:31:00", "x"].mean_val, stats["09:31:00", "y"].null_count, stats["09:31:00", "y"].inf_count) == (2.0, 1, 1)
    s = store.read("validation_summary").first()
    assert (s.total_columns, s.matched_columns, s.total_rows) == (2, 1, 3) and {r.feature_name: r.is_known_divergent for r in store.read("validation_columns").collect()} == {"x": False, "y": True}
    assert store.read("timing").first().source == "csv"
    store.record_events(events.where("path = 'a.log'"))
    assert store.read("bar_metrics").where("status = 'abandon'").count() == 4


def test_new_feature_files_come_once(spark, tmp_path):
    f = spark.createDataFrame([(datetime(2026, 3, 2, 9, 31), "a", 1.0)], "datetime timestamp_ntz, code string, x double")
    folder, seen = str(tmp_path / "f"), []
    for _ in range(2):
        f.write.mode("append").parquet(folder)
        mo.watch_features(spark, folder, f.schema, lambda df, _: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination()
    assert seen == [1, 1]


@pytest.fixture
def frame(spark, sf_dir):
    from ashlar.queries import base

    return base(spark, sf_dir)


def test_factor_data(frame, spark, tmp_path):
    d = an.FactorData.from_frame(frame, "f", "2024-01-05", "2024-01-12")
    days = [r.timestamp.day for r in d.dates().collect()]
    assert days and min(days) >= 5 and max(days) <= 12
    asset = d.assets().first().asset
    assert d.time_series(asset).count() <= len(days) and d.cross_section(d.dates().first().timestamp).count() > 0
    assert d.summary().first()["count"] == d.frame.where("factor_value IS NOT NULL").count() and d.validate().first().rows == d.frame.count()
    engine = an.FactorData.from_engine_output(frame.select("timestamp", "asset", "factor_value"), frame.select("timestamp", "asset", "return"), "f")
    assert engine.frame.count() == frame.count()
    with pytest.raises(ValueError):
        an.FactorData.from_frame(frame.drop("return"), "f")
    an.AnalysisResult("r", {"summary": d.summary()}).save(str(tmp_path))
    assert an.AnalysisResult.load(spark, str(tmp_path), "r", ["summary"]).data["summary"].count() == 1


def test_dispatchers(frame):
    groups = frame.select("asset").distinct().selectExpr("asset", "cast(cast(asset as long) % 2 as string) as part")
    assert an.robustness_test(frame, "universe", min_periods=5, groups=groups).first().n_parts == 2
    assert an.robustness_test(frame, "subsample", min_periods=5, n=3).first().n_parts == 3
    twice = frame.withColumn("r2", frame["return"] * 2).withColumnRenamed("return", "r1")
    r = an.robustness_test(twice, "return_period", min_periods=5, columns=["r1", "r2"]).first()
    assert r.n_parts == 2 and r.ic_range == pytest.approx(0, abs=1e-12) and r.stability == pytest.approx(1)
    assert an.out_of_sample_test(frame, split_date="2024-01-15", min_periods=5).count() == 1
    assert an.out_of_sample_test(frame, kind="walk_forward", min_periods=5, folds=3).count() == 3
    slope = an.trend(an.ic_by_part(an.rolling_parts(frame, 10, 5), "spearman", 1, 5)).first()
    assert slope.slope is not None
    for f in (an.robustness_test, an.out_of_sample_test):
        with pytest.raises(ValueError):
            f(frame, kind="nothing")


def test_all_metrics(spark):
    rets = [0.01, -0.02, 0.03, 0.0, 0.01]
    rows = [("s", datetime(2024, 1, d + 1), x) for d, x in enumerate(rets)]
    r = an.all_metrics(spark.createDataFrame(rows, "series string, timestamp timestamp_ntz, ret double"), spark.createDataFrame([(t, 0.5 * x) for _, t, x in rows], "timestamp timestamp_ntz, bench double")).first()
    assert r.beta == pytest.approx(2) and r.total_return == pytest.approx(1.01 * 0.98 * 1.03 * 1.01 - 1) and r.tracking_error > 0 and r.cvar >= r["var"]


def test_registry_views(spark, sf_dir, tmp_path):
    reg = FactorRegistry(str(tmp_path / "r.json"))
    a = reg.register_factor(lib.Momentum(3), [en.daily(), en.FrequencyConfig("minute", 30)], FactorMetadata("mom", "three days", "momentum", tags=["x"]))
    b = reg.register_factor(n.Close(), [en.daily()], FactorMetadata("close", "the price", "price", status="active"))
    assert reg.version_info(a)["current"] and reg.version_info(a, "v1.0.0")["expression"] == str(lib.Momentum(3))
    with pytest.raises(KeyError):
        reg.version_info(a, "v9.0.0")
    reg.update_metadata(a, status="active")
    assert reg.get_metadata(a).is_active() and len(reg.list_factors(status="active")) == 2 and len(reg.list_factors(category="price")) == 1
    p, mon = panel(spark, sf_dir, "E"), FactorMonitor(reg)
    assert [r.frequency for r in mon.multi_frequency(a, {"daily": p, "minute": p}).collect()] == ["daily", "minute"]
    mon.evaluate(a, p)
    assert reg.performance_summary(a)["by_frequency"]["daily"]["coverage"] is not None
    now, later = (mon.batch_evaluate([a], p, k).first().ic_mean for k in (0, 1))
    assert now != later and mon.detect_decay(a, p)["ratio"] is not None
    gid = reg.create_group("g", [a])
    reg.add_to_group(gid, [b])
    assert mon.best_of_group(gid, p).count() == 2 and len(reg.group_details(gid)["factors"]) == 2 and reg.group_statistics()["groups"] == 1
    reg.remove_from_group(gid, [b])
    assert reg.list_groups()[0]["factors"] == [a] and reg.delete_group(gid) and not reg.list_groups()
    other = FactorRegistry(str(tmp_path / "other.json"))
    assert other.import_registry(str(tmp_path / "r.json")) == 2 and other.delete_factor(b) and b not in other
    v = reg.create_version(a, lib.Momentum(4), [en.daily()], "longer")
    assert reg.current_version(a) == v and [h["version"] for h in reg.version_history(a)] == [v, "v1.0.0"]
    reg.delete_version(a, "v1.0.0")
    assert reg.list_versions(a) == [v]
    s = en.factor_summary(lib.RSI(5))
    assert s["window_depth"] >= 2 and en.execution_order(n.Close() + 1)[-1] == "add(close, 1.0)"


def test_a_day_of_bars_leaves_few_folders(spark, tmp_path):
    """Each bar written on its own and some again: all values are there, the folders stay few."""
    store = mo.MetricsStore(spark, f"file://{tmp_path}/m", "2024-01-02", most_folders=6, grace=0)
    for k in range(40):
        store.upsert_bar_metrics(f"09:{k:02}:00", cost_seconds=float(k))
        assert len(store.log("bar_metrics")._names()) <= 3 * 6 + 3
    store.upsert_bar_metrics("09:05:00", n_symbols=7)
    store.upsert_bar_metrics("09:06:00", cost_seconds=-1.0)
    got = {r.bar_time: (r.cost_seconds, r.n_symbols) for r in store.read("bar_metrics").collect()}
    assert got == {f"09:{k:02}:00": (-1.0 if k == 6 else float(k), 7 if k == 5 else None) for k in range(40)}
    mo.MetricsStore(spark, f"file://{tmp_path}/m", "2024-01-03").upsert_bar_metrics("09:00:00", n_symbols=1)
    assert store.read("bar_metrics").count() == 41


def test_writers_at_once_lose_nothing(spark, tmp_path):
    """Threads write and put together the same table at the same time."""
    from concurrent.futures import ThreadPoolExecutor

    def work(w):
        store = mo.MetricsStore(spark, f"file://{tmp_path}/m", "2024-01-02", most_folders=3, grace=3600)
        for k in range(6):
            store.upsert_bar_metrics(f"{w:02}:{k:02}:00", n_symbols=10 * w + k)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(work, range(3)))
    got = {r.bar_time: r.n_symbols for r in mo.MetricsStore(spark, f"file://{tmp_path}/m", "x").read("bar_metrics").collect()}
    assert got == {f"{w:02}:{k:02}:00": 10 * w + k for w in range(3) for k in range(6)}


def test_putting_together_that_dies_midway_changes_nothing(spark, tmp_path):
    store = mo.MetricsStore(spark, f"file://{tmp_path}/m", "2024-01-02", grace=0)
    for k in range(3):
        store.upsert_bar_metrics(f"09:{k:02}:00", n_symbols=k)
    log = store.log("bar_metrics")
    log.read().write.parquet(f"{log.path}/c00000000000000000001-dead")  # written, not entered
    log.fs.create(log._path("_log/00000001"), False).close()  # entered, not written
    assert len(log.folders()) == 3 and store.read("bar_metrics").count() == 3
    log.compact()
    assert len(log.folders()) == 1 and log.entries()[0]["number"] == 2 and store.read("bar_metrics").count() == 3


def test_a_growing_log_gives_the_events_of_the_whole_once_each(spark, tmp_path):
    """A hundred cuts a file, in any order and some again, over several runs that go on from the checkpoint."""
    import random

    from ashlar.streaming import log_tail as lt

    texts = {"a.log": "\n".join(LOG) + "\n", "b.log": "\r\n".join([*LOG[3:], *LOG]) + "\n"}
    (tmp_path / "logs").mkdir()
    for name, text in texts.items():
        (tmp_path / "logs" / name).write_bytes(text.encode())
    rows = mo.log_events(mo.numbered(spark.read.text(str(tmp_path / "logs")))).collect()
    want = sorted((r.path.rsplit("/", 1)[1], r.line, r.type, r.bar_time, r.cost_seconds, r.retry_count, r.n_symbols, r.reason) for r in rows)
    rnd = random.Random(4)
    cuts = []
    for name, text in texts.items():
        data = text.encode()
        ends = [0, *sorted(rnd.sample(range(1, len(data)), 99)), len(data)]
        cuts += [(name, a, data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    rnd.shuffle(cuts)
    cuts += rnd.sample(cuts, 20)
    got = []
    for k in range(0, len(cuts), 60):
        spark.createDataFrame([(p, a, bytearray(d)) for p, a, d in cuts[k : k + 60]], "path string, at long, data binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "cuts"))
        stream = spark.readStream.schema("path string, at long, data binary").parquet(str(tmp_path / "cuts"))
        q = lt.tail_events(stream).writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) > 10
