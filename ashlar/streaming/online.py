"""Features bar by bar from kept state, and a gate that holds incomplete and late bars.

``gated`` is a stateful stream with a group per bar time. A bar goes on when the first source has enough symbols; once later bars have come for
``tolerance``, from the second source if that has enough; and at the ``horizon`` with the symbols there are. Symbols that come after
their bar went on follow it at once, until the horizon; then the state of the bar is dropped, and so are later rows.

``OnlineFeatures`` keeps the vectors of ``plans.recurrence`` for blocks of codes, a generation of them after each micro-batch. A batch
of new bars reads the last generation and its own rows, and nothing older. Rows that are older than the last generation
go back to the newest one before them, and the bars since are taken anew, so that features always are those of a batch over the bars
in the order of their times. A generation counts when Spark has committed it, and is told by the batch that made it: a batch that
is run again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.minute_features import features
from ..plans.expr import TAILS
from ..plans.recurrence import Recurrence
from ..sources.readers import last_of_each

PRICES = ("open", "high", "low", "close")
BAR = "time timestamp_ntz, symbol string, open double, high double, low double, close double, volume double, money double"
#: Rows of new bars that are broadcast to the blocks, at most; more are left to Spark to join.
FEW_ROWS = 100_000
BYTES_A_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
EPOCH = datetime(1970, 1, 1)


# the gate


@dataclass
class Held:
    """Rows of one bar by source, and what went on: ``gone`` is the source, or None."""

    rows: pd.DataFrame
    gone: str | None = None

    def to_bytes(self) -> bytes:
        table = pa.Table.from_pandas(self.rows, preserve_index=False).replace_schema_metadata({"gone": self.gone or ""})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def of(data: bytes) -> Held:
        table = pa.ipc.open_stream(data).read_all()
        return Held(table.replace_schema_metadata(None).to_pandas(), table.schema.metadata[b"gone"].decode() or None)


def decided(held: Held, new: pd.DataFrame | None, least: int, patient: bool, last: bool) -> tuple[pd.DataFrame | None, str]:
    """What goes on now, and as what: complete, fallback, partial or late. patient: the first source may still come; last: nothing is waited for any more."""
    of = lambda source: held.rows[held.rows["source"] == source]
    first, second = of("first"), of("second")
    if held.gone is None:
        if len(first) >= least:
            held.gone = "first"
            return first, "complete"
        if not patient and len(second) >= least:
            held.gone = "second"
            return second, "fallback"
        if last and len(held.rows):
            held.gone = "first" if len(first) else "second"
            return of(held.gone), "partial"
        return None, ""
    if held.gone == "second" and len(first) >= least:
        held.gone = "first"
        return first, "complete"
    if new is not None and len(late := new[new["source"] == held.gone]):
        return late, "late"
    return None, ""


def gated(bars: DataFrame, least: int = 100, tolerance: timedelta = timedelta(minutes=1), horizon: timedelta = timedelta(minutes=10)) -> DataFrame:
    """A stream of bars (time, symbol, prices, volume, money, source: first or second) as the gate lets them go on, with ``status``.

    Times are told by the bars' own clock: the watermark stands ``horizon`` behind the newest bar.
    """
    ahead, back = int(tolerance.total_seconds() * 1000), int(horizon.total_seconds() * 1000)

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at = (key[0].to_pydatetime().replace(tzinfo=None) - EPOCH) // timedelta(milliseconds=1)
        given = pd.concat([*parts]) if not state.hasTimedOut else None
        new = given.drop(columns="event") if given is not None else None
        held = Held.of(bytes(state.get[0])) if state.exists else Held(new.iloc[:0])
        if new is not None:
            held.rows = pd.concat([held.rows, new]).drop_duplicates(["symbol", "source"], keep="last")
        now = state.getCurrentWatermarkMs()
        out, status = decided(held, new, least, now < at + ahead - back, now >= at)
        if now >= at:
            if state.exists:
                state.remove()
        else:
            state.update((held.to_bytes(),))
            state.setTimeoutTimestamp(max(now + 1, at + ahead - back if now < at + ahead - back else at))
        if out is not None:
            yield out.drop(columns="source").assign(source=held.gone, status=status)

    columns = ["time", "symbol", *PRICES, "volume", "money"]
    given = bars.select(*columns, "source", F.col("time").cast("timestamp").alias("event")).withWatermark("event", f"{back} milliseconds")
    return given.groupBy("event").applyInPandasWithState(step, f"{BAR}, source string, status string", "held binary", "append", "EventTimeTimeout")


# the state


@dataclass(frozen=True)
class Generation:
    """Vectors after all bars up to a time; ``since``: the first bar that its batch brought."""

    number: int
    upto: datetime | None
    since: datetime | None
    batch: int


@contextmanager
def bytes_a_batch(spark: SparkSession, most: int = 64 << 20) -> Iterator[None]:
    """Rows of the state are large; few of them go to Python at once."""
    was = spark.conf.get(BYTES_A_BATCH, None)
    spark.conf.set(BYTES_A_BATCH, str(most))
    try:
        yield
    finally:
        spark.conf.unset(BYTES_A_BATCH) if was is None else spark.conf.set(BYTES_A_BATCH, was)


def made(names: list[str], kind: str, n: int, **columns) -> pa.RecordBatch:
    """n rows of a generation's table, null where no column is given."""
    types = {"kind": pa.string(), "block": pa.int32(), "upto": pa.timestamp("us"), "since": pa.timestamp("us"), "batch": pa.int64(), "codes": pa.list_(pa.string()), "held": pa.binary(), "datetime": pa.timestamp("us"), "code": pa.string()}
    known = {"kind": pa.array([kind] * n, pa.string()), **columns}
    types |= dict.fromkeys(names, pa.float64())
    return pa.RecordBatch.from_arrays([known.get(c, pa.nulls(n, t)) for c, t in types.items()], [*types])


class OnlineFeatures:
    """Bars, generations of state and features as tables in a folder that all executors share.

    ``blocks`` deals the codes; a block's vectors are one row. ``keep`` generations stay, to go back to.
    """

    def __init__(self, spark: SparkSession, path: str, families: tuple[str, ...] | None = None, median: float = 50.0, blocks: int = 64, keep: int = 3, fill: float | None = 0.0):
        self.spark, self.path, self.blocks, self.keep, self.fill = spark, path, blocks, keep, fill
        self.exprs = features(median=median, rows=TAILS, **({"families": families} if families else {}))
        self.step = Recurrence(self.exprs)

    # files
    def _fs(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        where, fs = self._fs(name)
        return fs.exists(where)

    def _drop(self, name: str) -> None:
        where, fs = self._fs(name)
        fs.delete(where, True)

    def generations(self) -> list[Generation]:
        """Committed generations, the newest first."""
        where, fs = self._fs("state")
        numbers = sorted((int(s.getPath().getName().removeprefix("g")) for s in (fs.listStatus(where) if fs.exists(where) else []) if self._exists(f"state/{s.getPath().getName()}/_SUCCESS")), reverse=True)
        rows = [(n, self._state(n).select("upto", "since", "batch").first()) for n in numbers]
        return [Generation(n, r.upto, r.since, r.batch) for n, r in rows if r is not None]

    def _table(self, number: int) -> DataFrame:
        return self.spark.read.schema(f"{self._schema()}, kind string").parquet(f"{self.path}/state/g{number}")

    def _state(self, number: int) -> DataFrame:
        return self._table(number).where("kind = 'state'")

    def _schema(self) -> str:
        return "block int, upto timestamp_ntz, since timestamp_ntz, batch long, codes array<string>, held binary, datetime timestamp_ntz, code string, " + ", ".join(f"`{n}` double" for n in self.step.names)

    def bars(self) -> DataFrame | None:
        """All bars, of rows for one symbol and time the last."""
        return last_of_each(self.spark.read.parquet(f"{self.path}/bars"), "batch").drop("date") if self._exists("bars") else None

    def features(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/features") if self._exists("features") else None

    def _block(self):
        return F.pmod(F.xxhash64("symbol"), F.lit(self.blocks)).cast("int")

    # rows to state and features
    def _write(self, rows: DataFrame, number: int) -> None:
        with bytes_a_batch(self.spark):
            rows.write.mode("overwrite").option("compression", "lz4").partitionBy("kind").parquet(f"{self.path}/state/g{number}")

    def build(self, history: DataFrame | None, number: int = 0, batch: int = -1) -> Generation:
        """The first generation: vectors of the codes of a history (time, symbol, prices, volume), in one pass over the rows that count."""
        step, program, fields = self.step, self.step.program, self.step.fields
        blocks = self.spark.range(self.blocks).select(F.col("id").cast("int").alias("block"))
        if history is None:
            upto, rows = None, blocks.select("block", F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("timestamp_ntz").alias("time"), *[F.lit(None).cast("double").alias(c) for c in fields])
        else:
            upto = history.agg(F.max("time")).first()[0]
            age = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("time")))
            kept = history.select(self._block().alias("block"), "symbol", "time", *[F.col(c).cast("double").alias(c) for c in fields], age.alias("age")).where(F.col("age") <= program.reach).drop("age")
            rows = kept.unionByName(blocks, allowMissingColumns=True)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, codes, vectors, held = None, [], [], []

            def close_code() -> None:
                if held and held[0][0] is not None:
                    arrays = [np.concatenate(x) for x in zip(*(h[1] for h in held), strict=True)]
                    codes.append(held[0][0])
                    vectors.append(step.built({c: x[None] for c, x in zip(fields, arrays, strict=True)}, np.ones((1, len(arrays[0])), bool)))
                held.clear()

            def row() -> pa.RecordBatch:
                data = np.concatenate(vectors) if vectors else step.empty(0)
                return made(step.names, "state", 1, block=pa.array([block], pa.int32()), upto=pa.array([upto], pa.timestamp("us")), batch=pa.array([batch], pa.int64()), codes=pa.array([codes], pa.list_(pa.string())), held=pa.array([data.tobytes()], pa.binary()))

            for b in batches:
                of, symbols = b.column("block").to_numpy(), b.column("symbol").to_pylist()
                cells = [b.column(c).to_numpy(zero_copy_only=False) for c in fields]
                edges = [k for k in range(len(of)) if k == 0 or of[k] != of[k - 1] or symbols[k] != symbols[k - 1]] + [len(of)]
                for i, j in zip(edges, edges[1:], strict=False):
                    if of[i] != block or (held and symbols[i] != held[0][0]):
                        close_code()
                    if of[i] != block:
                        if block is not None:
                            yield row()
                        block, codes, vectors = int(of[i]), [], []
                    held.append((symbols[i], [x[i:j] for x in cells]))
            close_code()
            if block is not None:
                yield row()

        dealt = rows.repartition(self.blocks, "block").sortWithinPartitions("block", "symbol", "time")
        self._write(dealt.select("block", "symbol", *fields).mapInArrow(run, f"kind string, {self._schema()}"), number)
        return Generation(number, upto, None, batch)

    def advance(self, start: Generation, new: DataFrame, since: datetime, batch: int, number: int) -> Generation:
        """The next generation from another one and all bars after it."""
        step, fields, fill = self.step, self.step.fields, self.fill
        upto = max(x for x in (new.agg(F.max("time")).first()[0], start.upto) if x is not None)
        bars = new.select(self._block().alias("block"), F.struct("time", "symbol", *[F.col(c).cast("double").alias(c) for c in fields]).alias("bar"))
        bars = bars.groupBy("block").agg(F.array_sort(F.collect_list("bar")).alias("bars"))  # a block's part of the new bars
        bars = F.broadcast(bars) if new.count() <= FEW_ROWS else bars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    codes = b.column("codes")[i].as_py()
                    held = np.frombuffer(b.column("held")[i].as_buffer()).reshape(-1, step.size).copy()
                    given = b.column("bars").slice(i, 1).flatten()
                    times, symbols = given.field("time").to_numpy(zero_copy_only=False), given.field("symbol").to_pylist()
                    if more := sorted(set(symbols) - set(codes)):
                        codes, held = codes + more, np.concatenate([held, step.empty(len(more))])
                    place = {c: k for k, c in enumerate(codes)}
                    at = np.array([place[s] for s in symbols], np.int64)
                    cells = {c: given.field(c).to_numpy(zero_copy_only=False) for c in fields}
                    edges = [*np.flatnonzero(np.concatenate([[True], times[1:] != times[:-1]])).tolist(), len(times)] if len(times) else [0]
                    for j, k in zip(edges, edges[1:], strict=False):
                        rows = at[j:k]
                        part = held[rows]
                        found = step.advance(part, {c: x[j:k] for c, x in cells.items()})
                        held[rows] = part
                        if times[j] >= np.datetime64(since):
                            values = {n: pa.array(x if fill is None else np.where(np.isnan(x), fill, x), from_pandas=True) for n, x in found.items()}
                            yield made(step.names, "features", k - j, datetime=pa.array(times[j:k].astype("datetime64[us]")), code=pa.array(symbols[j:k]), **values)
                    one = {"block": b.column("block").slice(i, 1), "upto": pa.array([upto], pa.timestamp("us")), "since": pa.array([since], pa.timestamp("us")), "batch": pa.array([batch], pa.int64())}
                    yield made(step.names, "state", 1, codes=pa.array([codes], pa.list_(pa.string())), held=pa.array([held.tobytes()], pa.binary()), **one)

        joined = self._state(start.number).select("block", "codes", "held").join(bars, "block", "left")
        self._write(joined.mapInArrow(run, f"kind string, {self._schema()}"), number)
        return Generation(number, upto, since, batch)

    def process(self, bars: DataFrame, batch: int) -> None:
        """One micro-batch of bars, which may be new, late, or again."""
        known = self.generations()
        if known and known[0].batch >= batch:
            self._publish(known[0])
            return
        rows = bars.select("time", "symbol", *PRICES, "volume", "money", F.to_date("time").alias("date"), F.lit(batch).cast("long").alias("batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(f"{self.path}/bars")
        since = self._since(None).where(F.col("batch") == batch).agg(F.min("time")).first()[0]
        if since is None:
            return
        number, start, stale = (known[0].number + 1 if known else 0), None, None
        for g in known:  # a generation that a later batch went back behind lacks that batch's bars
            if (stale is None or g.upto is None or g.upto < stale) and (g.upto is None or g.upto < since):
                start = g
                break
            if g.since is not None:
                stale = g.since if stale is None else min(stale, g.since)
        if start is None:
            before = last_of_each(self._since(None).where(F.col("time") < F.lit(since).cast("timestamp_ntz")), "batch")
            start = self.build(None if before.isEmpty() else before, number)
            number += 1
        new = last_of_each(self._since(start.upto), "batch")
        self._publish(self.advance(start, new, since, batch, number))
        for g in [*known[self.keep - 1 :], *([start] if start not in known else [])]:
            self._drop(f"state/g{g.number}")

    def _since(self, upto: datetime | None) -> DataFrame:
        """Stored bars after a time; older dates aren't read."""
        bars = self.spark.read.schema(f"{BAR}, date date, batch long").parquet(f"{self.path}/bars")
        return bars if upto is None else bars.where((F.col("date") >= F.lit(upto.date())) & (F.col("time") > F.lit(upto).cast("timestamp_ntz")))

    def _publish(self, g: Generation) -> None:
        """Put a generation's features in their table, a folder per bar; again does no harm."""
        found = self._table(g.number).where("kind = 'features'").select("datetime", "code", *[F.col(f"`{n}`") for n in self.step.names])
        found = found.withColumn("date", F.to_date("datetime")).withColumn("bar", F.date_format("datetime", "HHmmss"))
        found.repartition(8, "date", "bar").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "bar").parquet(f"{self.path}/features")


def run_online(bars: DataFrame, online: OnlineFeatures, checkpoint: str, trigger: str | None = None, **gate):
    """Start the stream of bars (with ``source``) through the gate into the features: every ``trigger``, or over what is there and then end."""
    writer = gated(bars, **gate).writeStream.outputMode("append").foreachBatch(online.process).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()
