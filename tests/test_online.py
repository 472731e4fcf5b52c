"""The recurrence against the batch values, the gate, and the stream with late, repeated and missing bars."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ashlar.functions.minute_features import features
from ashlar.plans.expr import TAILS
from ashlar.plans.recurrence import Recurrence
from ashlar.plans.snapshot import compute
from ashlar.plans.tails import Program
from ashlar.streaming import online as on
from ashlar.streaming.bars import as_panel

FAMILY = ("microstructure",)


def cells(codes, rows, seed=1):
    rnd = np.random.default_rng(seed)
    close = 50 + np.cumsum(rnd.standard_normal((codes, rows)) * 0.05, axis=1)
    out = {"close": close, "open": close + rnd.standard_normal((codes, rows)) * 0.03, "high": close + rnd.random((codes, rows)) * 0.1, "low": close - rnd.random((codes, rows)) * 0.1}
    return out | {"volume": np.floor(rnd.random((codes, rows)) * 5000)}


def test_every_feature_bar_by_bar_is_that_of_the_batch():
    """All 574, from a history on and from nothing on, with short codes, holes and missing closes."""
    exprs = features(median=50.0, rows=TAILS)
    step, program, rnd = Recurrence(exprs), Program(exprs), np.random.default_rng(2)
    columns, bars = cells(8, 1100), 25
    there = np.arange(1100) >= 1100 - np.array([1100, 1100, 1000, 300, 26, 12, 3, 1])[:, None]
    columns = {c: np.where(there, x, np.nan) for c, x in columns.items()}
    columns["close"][:, -20:-18] = np.nan
    held = step.built({c: x[:, :-bars] for c, x in columns.items()}, there[:, :-bars])
    for j in range(1100 - bars, 1100):
        idx = np.flatnonzero(there[:, j])
        part = held[idx]
        got = step.advance(part, {c: x[idx, j] for c, x in columns.items()})
        held[idx] = part
        if rnd.random() < 0.2 or j == 1099:
            want = program.run({c: x[:, : j + 1] for c, x in columns.items()}, there[:, : j + 1])
            for n in exprs:
                assert np.allclose(got[n], want[n][idx, -1], rtol=1e-9, atol=1e-9, equal_nan=True), n


def minute(m):
    return datetime(2024, 1, 2, 9, 31) + timedelta(minutes=m)


def make_bars(codes, minutes, seed=3):
    rnd = random.Random(seed)
    return {(minute(m), f"6000{c:02}"): (*(10 + c + rnd.random() for _ in range(4)), float(rnd.randint(0, 900)), 1.0) for m in range(minutes) for c in range(codes)}


SCHEMA = on.BAR


def frame(spark, bars):
    return spark.createDataFrame([(*k, v[0], v[1], v[2], v[3], v[4], v[5]) for k, v in bars.items()], SCHEMA)


def batch_values(spark, bars):
    """Features of all rows by window functions over all bars."""
    found = compute(as_panel(frame(spark, bars)), features(median=50.0, rows=None, families=FAMILY)).toPandas()
    return found.sort_values(["datetime", "code"]).reset_index(drop=True)


def check(spark, online, bars):
    got = online.features().drop("date", "bar").toPandas().sort_values(["datetime", "code"]).reset_index(drop=True)
    want = batch_values(spark, bars)
    assert len(got) == len(want) and (got[["datetime", "code"]] == want[["datetime", "code"]]).all().all()
    for c in want.columns[2:]:
        assert np.allclose(got[c], want[c], rtol=1e-7, atol=1e-7), c


def test_batches_in_and_out_of_order(spark, tmp_path):
    bars = make_bars(5, 12)
    bars = {k: v for k, v in bars.items() if not (k[1] == "600003" and k[0].minute % 4 == 0) and not (k[1] == "600004" and k[0] < minute(6))}
    online = on.OnlineFeatures(spark, f"file://{tmp_path}", FAMILY, blocks=3, keep=3)
    of = lambda *m: {k: v for k, v in bars.items() if k[0] in [minute(x) for x in m]}
    for batch, part in enumerate([of(0, 1), of(2), of(4), of(3), of(5, 7), of(8), of(9), of(10), of(6), of(11)]):
        online.process(frame(spark, part), batch)
        online.process(frame(spark, part), batch)  # again, as after a failure
        assert len(online.generations()) <= 4
    check(spark, online, bars)
    changed = {k: (*v[:3], v[3] + 1, *v[4:]) for k, v in of(2).items()}  # older than all generations: state is built anew
    online.process(frame(spark, changed), 10)
    check(spark, online, bars | changed)


def test_history_comes_first(spark, tmp_path):
    bars = make_bars(4, 30, 5)
    old = {k: v for k, v in bars.items() if k[0] < minute(25)}
    online = on.OnlineFeatures(spark, f"file://{tmp_path}", FAMILY, blocks=2)
    online.build(frame(spark, old))
    for m in range(25, 30):
        online.process(frame(spark, {k: v for k, v in bars.items() if k[0] == minute(m)}), m)
    got = online.features().toPandas().sort_values(["datetime", "code"]).reset_index(drop=True)
    want = batch_values(spark, bars)
    want = want[want["datetime"] >= minute(25)].reset_index(drop=True)
    assert len(got) == len(want) == 20
    for c in want.columns[2:]:
        assert np.allclose(got[c], want[c], rtol=1e-7, atol=1e-7), c


def rows_of(*given):
    return pd.DataFrame([(s, x) for s, x in given], columns=["symbol", "source"])


@pytest.mark.parametrize(("held", "gone", "new", "patient", "last", "want"), [
    ([("a", "first"), ("b", "first")], None, None, True, False, ("complete", 2)),
    ([("a", "first"), ("a", "second"), ("b", "second")], None, None, True, False, None),
    ([("a", "first"), ("a", "second"), ("b", "second")], None, None, False, False, ("fallback", 2)),
    ([("a", "first")], None, None, False, False, None),
    ([("a", "first"), ("a", "second")], None, None, False, True, ("partial", 1)),
    ([("a", "second")], None, None, False, True, ("partial", 1)),
    ([("a", "first"), ("b", "first"), ("c", "first")], "first", [("c", "first")], True, False, ("late", 1)),
    ([("a", "first"), ("b", "first"), ("c", "second")], "first", [("c", "second")], True, False, None),
    ([("a", "first"), ("b", "first"), ("a", "second"), ("b", "second")], "second", [("b", "first")], False, False, ("complete", 2)),
])
def test_decisions(held, gone, new, patient, last, want):
    out, status = on.decided(on.Held(rows_of(*held), gone), None if new is None else rows_of(*new), 2, patient, last)
    assert (None if out is None else (status, len(out))) == want


def test_stream_with_late_short_and_missing_sources(spark, tmp_path):
    """Each file is a run of its own, which goes on from the checkpoint."""
    bars = make_bars(3, 30, 7)
    (tmp_path / "in").mkdir()
    sources = lambda m, source, codes=3: [(*k, *v, source) for k, v in bars.items() if k[0] == minute(m) and int(k[1][-1]) < codes]
    shifted = lambda rows: [(*r[:5], r[5] + 5, *r[6:]) for r in rows]  # the second source has other closes
    files = [
        sources(0, "first"), sources(2, "first"), sources(1, "first"),  # out of order
        sources(3, "first", 2) + shifted(sources(3, "second")),  # short: the second source after the tolerance
        sources(4, "first"), sources(5, "first"),
        sources(6, "first", 1),  # short in both: partial at the horizon
        shifted(sources(7, "second")),  # missing first
        sources(8, "first"), sources(9, "first"), sources(8, "first"), sources(4, "first", 1), sources(20, "first"), sources(29, "first"), sources(2, "first"),
    ]
    online = on.OnlineFeatures(spark, f"file://{tmp_path}/store", FAMILY, blocks=2, keep=2)
    schema = f"{SCHEMA}, source string"
    states = []
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        q = on.run_online(stream, online, f"{tmp_path}/cp", least=3, tolerance=timedelta(minutes=1), horizon=timedelta(minutes=5))
        q.awaitTermination()
        assert q.exception() is None
        states.append(max([sum(s.numRowsTotal for s in p.stateOperators) for p in q.recentProgress], default=0))
    want = {k: v for k, v in bars.items() if k[0] in {minute(m) for m in (0, 1, 2, 4, 5, 8, 9, 20, 29)}}
    want |= {(r[0], r[1]): r[2:8] for m in (3, 7) for r in shifted(sources(m, "second"))}
    want |= {(r[0], r[1]): r[2:8] for r in sources(6, "first", 1)}
    check(spark, online, want)
    assert max(states) <= 7  # the bars of a horizon at most, whatever has passed
    assert online.bars().where(F.col("time") == F.lit(minute(3)).cast("timestamp_ntz")).count() == 3
