"""Bar-by-bar features from a folder of minute files, and their monitoring.

Each micro-batch adds its bars to a store (of rows for one symbol and time the last stays), finds the times
without output, and computes them from the store with the batch functions, so that a stream, a backfill
and a batch give the same rows. Output is written per (date, bar) and replaced when it is written again.
"""

from __future__ import annotations

import itertools
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.processors import KEYS
from ..plans.columns import as_array, compared
from ..plans.snapshot import minute_features
from ..sources.readers import DROP_SCHEMA, drop_bars, last_of_each

#: Bars of a trading day: 09:31 to 11:30 and 13:01 to 15:00.
BAR_RUNS = (("09:31", "11:30"), ("13:01", "15:00"))
#: Days that features look back on: 13,631 rows of 241 a day, with weekends and holidays.
LOOK_BACK = timedelta(days=120)
#: Share of symbols that may be carried forward at a bar.
MOST_MISSING = 0.01


def expected_bars(spark: SparkSession, day: str, end: str | None = None) -> DataFrame:
    at = lambda clock: F.to_timestamp_ntz(F.lit(f"{day} {clock}:00"))
    grid = spark.range(1).select(F.explode(F.concat(*[F.sequence(at(a), at(b), F.expr("interval 1 minute")) for a, b in BAR_RUNS])).alias("time"))
    return grid if end is None else grid.where(F.date_format("time", "HH:mm") <= end)


def fill_auction(auction: DataFrame, history: DataFrame, symbols: DataFrame, day: str) -> DataFrame:
    """Symbols without an auction bar get the close of the last earlier bar, without volume."""
    last = history.where(F.col("time") < F.to_timestamp_ntz(F.lit(f"{day} 00:00:00"))).groupBy("symbol").agg(F.max_by("close", "time").alias("p"))
    missing = symbols.join(auction.select("symbol"), "symbol", "left_anti").join(last, "symbol")
    made = missing.select(F.to_timestamp_ntz(F.lit(f"{day} 09:30:00")).alias("time"), "symbol", *[F.col("p").alias(c) for c in ("open", "close", "high", "low")], F.lit(0.0).alias("volume"), F.lit(0.0).alias("money"))
    return auction.unionByName(made)


def forward_fill(bars: DataFrame, symbols: DataFrame, most: float = MOST_MISSING) -> DataFrame:
    """At the latest bar, carry forward the symbols that lack it, if they are few."""
    latest = bars.agg(F.max("time").alias("latest"))
    have = bars.join(F.broadcast(latest), F.col("time") == F.col("latest")).select("symbol")  # latest is one row
    missing = symbols.join(have, "symbol", "left_anti")
    share = missing.agg(F.count("*").alias("m")).crossJoin(symbols.agg(F.count("*").alias("n"))).select((F.col("m") <= F.col("n") * most).alias("few"))  # one row each
    last = bars.groupBy("symbol").agg(F.max_by("close", "time").alias("p"))
    made = missing.join(last, "symbol").crossJoin(F.broadcast(latest)).crossJoin(F.broadcast(share)).where("few")  # both one row
    made = made.select(F.col("latest").alias("time"), "symbol", *[F.col("p").alias(c) for c in ("open", "close", "high", "low")], F.lit(0.0).alias("volume"), F.lit(0.0).alias("money"))
    return bars.unionByName(made)


def as_panel(bars: DataFrame) -> DataFrame:
    return bars.select(F.col("time").alias("datetime"), F.col("symbol").alias("code"), "open", "high", "low", "close", "volume", F.col("money").alias("amount"))


def features_at(bars: DataFrame, times: list, families: tuple[str, ...] | None = None) -> DataFrame:
    """Features of the asked bar times, each from the bars up to it. No window looks ahead, so all from the first
    asked time on are computed in one pass; bars further back than any window reaches aren't kept."""
    upto = bars.where(F.col("time") <= F.lit(max(times)).cast("timestamp_ntz"))
    return minute_features(as_panel(upto), families, since=min(times)).where(F.col("datetime").isin(times))


class BarStore:
    """Bars and features as tables in a folder."""

    def __init__(self, spark: SparkSession, path: str, families: tuple[str, ...] | None = None, least_symbols: int = 1):
        self.spark, self.path, self.families, self.least = spark, path, families, least_symbols

    def _read(self, name: str) -> DataFrame | None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.parquet(f"{self.path}/{name}") if there else None

    def bars(self) -> DataFrame:
        return last_of_each(self._read("bars"), "batch")

    def features(self) -> DataFrame | None:
        return self._read("features")

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch. A batch that is run again writes its own folder again."""
        where = f"{self.path}/bars/run={batch_id}"
        drop_bars(batch).withColumns({"batch": F.lit(batch_id), "date": F.to_date("time")}).write.mode("overwrite").partitionBy("date").parquet(where)
        dates = [r.date for r in self.spark.read.schema("date date").parquet(where).distinct().collect()]
        if dates:
            self.compute_missing(dates)

    def compute_missing(self, dates: list[date] | None = None) -> int:
        """Compute all complete bar times without output, of some dates or all; of bars and output, only these dates and what features look back on are read."""
        bars, done = self.bars().drop("run"), self.features()
        if dates:
            bars = bars.where(F.col("date").between(F.lit(min(dates) - LOOK_BACK), F.lit(max(dates))))
            done = None if done is None else done.where(F.col("date").isin(dates))
        asked = bars.where(F.col("date").isin(dates)) if dates else bars
        times = asked.groupBy("time").agg(F.count_distinct("symbol").alias("n")).where(F.col("n") >= self.least).select("time")
        if done is not None:
            times = times.join(done.select(F.col("datetime").alias("time")).distinct(), "time", "left_anti")
        todo = [r.time for r in times.orderBy("time").collect()]  # a row per bar time: 241 a day
        for day, group in itertools.groupby(todo, key=lambda t: t.date()):  # what a pass holds of a code is a day and its look-back
            near = bars.where(F.col("date").between(F.lit(day - LOOK_BACK), F.lit(day))).drop("date")
            out = features_at(near, list(group), self.families).withColumn("date", F.to_date("datetime")).withColumn("bar", F.date_format("datetime", "HHmmss"))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "bar").parquet(f"{self.path}/features")
        return len(todo)


def run_stream(spark: SparkSession, folder: str, store: BarStore, checkpoint: str, trigger: str | None = None):
    """Start the stream: every ``trigger`` (as '1 minute'), or over what is there and then end (backfill)."""
    source = spark.readStream.schema(DROP_SCHEMA).option("header", True).csv(folder)
    writer = source.writeStream.foreachBatch(store.add).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


# monitoring
def feature_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "double" and c not in KEYS]


def long(df: DataFrame, columns: list[str], name: str = "value") -> DataFrame:
    return df.unpivot(list(KEYS), [F.col(f"`{c}`") for c in columns], "feature_name", name)


def feature_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per bar and feature: mean, deviation, least and largest finite value, nulls and infinities."""
    x = F.col("value")
    finite = F.when(x.isNotNull() & (F.abs(x) != float("inf")) & ~F.isnan(x), x)
    return long(df, columns or feature_columns(df)).groupBy("datetime", "feature_name").agg(F.avg(finite).alias("mean_val"), F.stddev_samp(finite).alias("std_val"), F.min(finite).alias("min_val"), F.max(finite).alias("max_val"), F.count_if(x.isNull()).alias("null_count"), F.count_if(F.abs(x) == float("inf")).alias("inf_count"))


def bar_metrics(df: DataFrame, cost_seconds: float | None = None, retries: int = 0, status: str = "ok") -> DataFrame:
    """A row per bar: symbols, null and infinite cells."""
    cols = [F.col(f"`{c}`") for c in feature_columns(df)]
    count = lambda test: F.sum(sum((F.when(test(c), 1).otherwise(0) for c in cols), F.lit(0))).cast("long")
    return df.groupBy("datetime").agg(F.count_distinct("code").alias("n_symbols"), count(lambda c: c.isNull()).alias("n_null_cells"), count(lambda c: F.abs(c) == float("inf")).alias("n_inf_cells")).withColumns({"cost_seconds": F.lit(cost_seconds).cast("double"), "retry_count": F.lit(retries), "status": F.lit(status)})


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """New values where they are known, old ones elsewhere."""
    if old is None:
        return new
    both = old.alias("o").join(new.alias("n"), keys, "full_outer")
    values = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    pick = lambda c: F.coalesce(*[F.col(f"{s}.{c}") for s, d in (("n", new), ("o", old)) if c in d.columns]).alias(c)
    return both.select(*keys, *[pick(c) for c in values])


def validate(online: DataFrame, offline: DataFrame, relative: float = 1e-3, absolute: float = 1e-2, special: dict[str, float] | None = None) -> DataFrame:
    """Per column: share of equal values, largest difference, correlation; without the 15:00 bar.

    Values are equal if both are missing or they differ by less than the relative or the absolute bound. The sides are joined
    once, by row, with their columns as one array.
    """
    columns = [c for c in feature_columns(online) if c in offline.columns]
    clean = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)
    side = lambda df, name: df.where(F.date_format("datetime", "HH:mm") != "15:00").select(*KEYS, F.transform(as_array(columns), clean).alias(name))
    special = special or {"money": 1e4}
    return compared(side(online, "a").join(side(offline, "b"), list(KEYS)), columns, relative, [special.get(c, absolute) for c in columns])


def validation_summary(columns: DataFrame, least: float = 0.999) -> DataFrame:
    return columns.agg(F.count("*").alias("total_columns"), F.count_if(F.col("equal_ratio") >= least).alias("matched_columns"), F.count_if(F.col("equal_ratio") < least).alias("diverged_columns"), F.avg("equal_ratio").alias("mean_equal_ratio"))
