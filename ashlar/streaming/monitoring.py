"""What is kept of a run: metrics tables that only grow, events from log lines, and new feature files as a stream."""

from __future__ import annotations

import json
import time
import uuid
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bars import bar_metrics, feature_stats, validation_summary

#: Kinds of log lines with their patterns, in the order in which a line is tried.
LOG_LINES = {
    "csv": r"\[CSV\].*?kbar_(\d{4})\.csv.*?(\d+).*?(\d+).*?attempt\s+(\d+)",
    "fallback_attempt": r"\[JQ fallback attempt (\d+)/(\d+)\].*?(\d{2}:\d{2})",
    "fallback": r"\[JQ\].*?bar=(\d{2}:\d{2}).*?(\d+).*?(\d+)",
    "done": r"(?:\[\d+/\d+\]\s*)?Bar\s+(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}).*?([\d.]+)s,\s*source=([A-Za-z0-9_]+)",
    "first_done": r".*?bar:\s*(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}).*?([\d.]+)s",
    "skipped": r"Bar (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) 两级 fallback 均失败 .*跳过",
    "failed": r"Bar (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) 两级 fallback 均失败.*记入待补列表",
    "unfilled": r"收盘时仍有 (\d+) 个未补全 bar: \[(.*)\]",
    "retry": r"第 (\d+)/(\d+) 次拉取, 期望 bar: (\S+ \S+)",
    "validated": r"Bar 校验通过: time=(\S+ \S+), symbols=(\d+)",
    "cost": r"耗时[:\s]*([\d.]+)s",
    "error": r"get_price 异常 \(attempt (\d+)\): (.+)",
    "written": r".*?(\d{6})\.parquet.*?(\d+)",
    "abandoned": r"达到最大重试次数 (\d+)，放弃本轮拉取",
    "exit": r"已过收盘时间，脚本退出|交易日结束，脚本正常退出",
}
#: Group of a line's pattern that holds each piece.
BAR = {"csv": 1, "fallback_attempt": 3, "fallback": 1, "done": 1, "first_done": 1, "skipped": 1, "failed": 1, "retry": 3, "validated": 1, "written": 1}
SYMBOLS = {"csv": 3, "fallback": 3, "validated": 2, "written": 2}
RETRIES = {"fallback_attempt": 1, "retry": 1, "abandoned": 1}
SECONDS = {"done": 2, "first_done": 2, "cost": 1}
#: Reasons for giving a bar up.
REASONS = {"skipped": "csv and jqdata fallback failed", "failed": "csv and jqdata fallback failed; pending backfill", "unfilled": "market close with unfilled pending bar", "abandoned": "max retry exceeded"}
ENDS = ("done", "first_done", "skipped", "unfilled", "written", "abandoned")


def piece(groups: dict[str, int]) -> Column:
    """The group of a line's own pattern."""
    return F.coalesce(*[F.when(F.col("line_kind") == k, F.regexp_extract("value", LOG_LINES[k], g)) for k, g in groups.items()])


def clock(text: Column) -> Column:
    """HH:MM:SS of a date and time, of HH:MM, HHMM or HHMMSS."""
    digits = F.regexp_replace(F.element_at(F.split(F.trim(text), " "), -1), ":", "")
    digits = F.rpad(digits, 6, "0")
    return F.when(text.isNotNull(), F.concat_ws(":", F.substring(digits, 1, 2), F.substring(digits, 3, 2), F.substring(digits, 5, 2)))


def log_events(lines: DataFrame) -> DataFrame:
    """(path, line, type, bar_time, cost_seconds, retry_count, n_symbols, reason) from log lines (path, line, value).

    What lines tell of a bar (retries, symbols, seconds, errors) belongs to the next line that ends it: a
    completed or skipped bar, or a written file. A file that is written before its seconds are known is completed
    by the bar's later line. Each log file is one window.
    """
    kind = F.coalesce(*[F.when(F.col("value").rlike(p), k) for k, p in LOG_LINES.items()])
    d = lines.withColumn("line_kind", kind).where("line_kind IS NOT NULL")
    d = d.select("path", "line", "value", "line_kind", clock(piece(BAR)).alias("bar"), piece(SYMBOLS).cast("int").alias("symbols"), piece(RETRIES).cast("int").alias("retries"), piece(SECONDS).cast("double").alias("seconds"), F.when(F.col("line_kind") == "error", F.trim(piece({"error": 2}))).when(F.col("line_kind") == "failed", F.lit(REASONS["failed"])).alias("why"))
    file = Window.partitionBy("path").orderBy("line")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    ended = lambda kinds: F.coalesce(F.sum(F.col("line_kind").isin(*kinds).cast("int")).over(before), F.lit(0))
    d = d.withColumn("part", ended(ENDS)).withColumn("span", ended([k for k in ENDS if k != "written"]))
    # the lines of a part up to the one that ends it; a CSV poll sets the retries back
    mine = Window.partitionBy("path", "part").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("polls", F.sum((F.col("line_kind") == "csv").cast("int")).over(mine))
    tries = Window.partitionBy("path", "part", "polls").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({
        "tried": F.coalesce(F.max(F.when(F.col("line_kind").isin("fallback_attempt", "retry"), F.col("retries"))).over(tries), F.lit(0)), "took": F.last(F.when(F.col("line_kind") == "cost", F.col("seconds")), True).over(mine),
        "seen": F.coalesce(F.last("symbols", True).over(mine), F.lit(0)), "said": F.last("why", True).over(mine), "at": F.last("bar", True).over(mine),
    })
    waits = (F.col("line_kind") == "written") & F.col("took").isNull()
    pending = Window.partitionBy("path", "span", "bar").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    held = F.last(F.when(waits, F.struct("seen", "tried")), True).over(pending)
    d = d.withColumn("held", held)
    done = F.col("line_kind").isin("done", "first_done")
    type_ = F.when(done | (F.col("line_kind") == "written"), "bar_complete").when(F.col("line_kind").isin("skipped", "unfilled", "abandoned"), "abandon").when(F.col("line_kind") == "exit", "exit")
    events = d.where(type_.isNotNull() & ~waits)
    many = F.transform(F.regexp_extract_all("value", F.lit(r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"), F.lit(0)), clock)
    bars = F.when(F.col("line_kind") == "unfilled", many).when(F.col("line_kind") == "abandoned", F.array(F.coalesce("at", F.lit("unknown")))).otherwise(F.array("bar"))
    zero = F.col("line_kind").isin("first_done", "unfilled")
    return events.select(
        "path", "line", type_.alias("type"), F.explode(bars).alias("bar_time"), F.when(done, F.col("seconds")).when(F.col("line_kind") == "written", F.col("took")).alias("cost_seconds"),
        F.when(zero, 0).when(F.col("line_kind") == "abandoned", F.col("retries")).when(done, F.coalesce("held.tried", "tried")).when(F.col("line_kind") != "exit", F.col("tried")).alias("retry_count"),
        F.when(done, F.coalesce("held.seen", "seen")).when(F.col("line_kind") == "written", F.col("seen")).alias("n_symbols"),
        F.coalesce(*[F.when(F.col("line_kind") == k, F.coalesce("said", F.lit(v)) if k == "abandoned" else F.lit(v)) for k, v in REASONS.items() if k != "failed"]).alias("reason"),
    )


def numbered(lines: DataFrame) -> DataFrame:
    """(path, line, value) of text files read by spark.read.text; a file's lines keep their order."""
    path = lines.select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("id"))
    return path.select("path", F.row_number().over(Window.partitionBy("path").orderBy("id")).cast("long").alias("line"), "value")


#: Columns that tell a row of each table from others, after the date.
TABLES = {"bar_metrics": ["bar_time"], "abandon_events": ["bar_time", "seq"], "feature_stats": ["bar_time", "feature_name"], "validation_summary": [], "validation_columns": ["feature_name"], "timing": ["bar_time", "seq"]}


class Log:
    """Rows of one table and day as folders that are only added, by any number of writers, and put together now and then.

    Each write is a folder of its own, which counts once Spark has committed it. Putting together writes one more folder and then an
    entry, under the next free number, that names it and the folders it stands for; a folder of that kind counts by its entry alone, and
    the others go once they have been replaced for ``grace`` seconds, so that who has listed them can still read them. Two that
    put together at once, or one that dies midway, may leave rows twice but never lose one; twice does no harm, as the
    last known values of a key count.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = 32, grace: float = 600.0):
        self.spark, self.path, self.most, self.grace = spark, path, most, grace
        self.root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str = "") -> list[str]:
        where = self._path(folder) if folder else self.root
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def entries(self) -> list[dict]:
        """What was put together: number, adds, removes, at (seconds). Entries that are still being written don't count."""
        found = []
        for name in self._names("_log"):
            where = self._path(f"_log/{name}")
            stream = self.fs.open(where)
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            with suppress(ValueError):
                found.append(json.loads(text) | {"number": int(name)})
        return found

    def folders(self) -> list[str]:
        """Names of the folders that count."""
        entries = self.entries()
        gone, made = {n for e in entries for n in e["removes"]}, {e["adds"] for e in entries}
        names = [n for n in self._names() if n[0] in "pc" and n not in gone and (n[0] == "p" or n in made)]
        return [n for n in names if self.fs.exists(self._path(f"{n}/_SUCCESS"))]

    def add(self, rows: DataFrame) -> None:
        rows.coalesce(1).write.parquet(f"{self.path}/p{time.time_ns():020d}-{uuid.uuid4().hex}")  # a bar's metrics
        if len(self.folders()) > self.most:
            self.compact()

    def read(self) -> DataFrame | None:
        names = self.folders()
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{n}" for n in names]) if names else None

    def compact(self) -> None:
        """Put the folders that count together in one, and delete those that were replaced long enough ago."""
        names = self.folders()
        if len(names) > 1:
            made = f"c{time.time_ns():020d}-{uuid.uuid4().hex}"
            self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{n}" for n in names]).coalesce(1).write.parquet(f"{self.path}/{made}")
            self._enter({"adds": made, "removes": names, "at": time.time()})
        for e in self.entries():
            if e["at"] + self.grace <= time.time():
                for n in e["removes"]:
                    self.fs.delete(self._path(n), True)

    def _enter(self, entry: dict) -> None:
        number = 1 + max([int(n) for n in self._names("_log")], default=0)
        while True:
            try:
                out = self.fs.create(self._path(f"_log/{number:08d}"), False)
                break
            except Exception as e:  # another writer has this number
                if "exist" not in str(e).lower():
                    raise
                number += 1
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()


class MetricsStore:
    """Metrics of trading days; of the values written for a key the last known ones count. Any number of stores may write at once."""

    def __init__(self, spark: SparkSession, path: str, day: str, most_folders: int = 32, grace: float = 600.0):
        self.spark, self.path, self.day, self.most, self.grace = spark, path, day, most_folders, grace

    def log(self, name: str, day: str | None = None) -> Log:
        return Log(self.spark, f"{self.path}/{name}/{day or self.day}", self.most, self.grace)

    def _put(self, name: str, rows: DataFrame) -> None:
        rows = rows.select(*[F.col(c).cast("long") if t == "int" else F.col(c) for c, t in rows.dtypes], F.lit(self.day).alias("trade_date"), F.lit(time.time_ns()).alias("seq"))
        self.log(name).add(rows)

    def read(self, name: str) -> DataFrame:
        """A table of all days with a row per key."""
        days = [f"{self.path}/{name}/{d}/{n}" for d in Log(self.spark, f"{self.path}/{name}")._names() for n in self.log(name, d).folders()]
        df = self.spark.read.option("mergeSchema", True).parquet(*days)
        keys = ["trade_date", *TABLES[name]]
        values = [c for c in df.columns if c not in keys and c != "seq"]
        return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in values])

    def record_bar(self, features: DataFrame, cost_seconds: float | None = None, retries: int = 0, status: str = "ok") -> None:
        """A row for each bar of a feature frame: symbols, null and infinite cells, seconds, retries, status."""
        self._put("bar_metrics", _by_bar(bar_metrics(features, cost_seconds, retries, status)))

    def record_feature_stats(self, features: DataFrame, names: list[str] | None = None) -> None:
        self._put("feature_stats", _by_bar(feature_stats(features, names)))

    def upsert_bar_metrics(self, bar_time: str, **values) -> None:
        """Some of a bar's values; the others stay."""
        self._put("bar_metrics", self.spark.range(1).select(F.lit(bar_time).alias("bar_time"), *[F.lit(v).alias(k) for k, v in values.items()]))

    def record_abandon(self, bar_time: str, retries: int, reason: str = "") -> None:
        """An event, and the bar's status."""
        self._put("abandon_events", self.spark.range(1).select(F.lit(bar_time).alias("bar_time"), F.lit(retries).alias("retry_count"), F.lit(reason).alias("reason")))
        self.upsert_bar_metrics(bar_time, retry_count=retries, status="abandon")

    def record_timing(self, bar_time: str, cost_seconds: float, source: str = "") -> None:
        self._put("timing", self.spark.range(1).select(F.lit(bar_time).alias("bar_time"), F.lit(float(cost_seconds)).alias("cost_seconds"), F.lit(source).alias("source")))

    def record_validation(self, columns: DataFrame, total_rows: int, known_divergent: tuple[str, ...] = ()) -> None:
        """The comparison of online and offline features: a row per column, and the day's summary."""
        self._put("validation_columns", columns.withColumn("is_known_divergent", F.col("feature_name").isin(*known_divergent) if known_divergent else F.lit(False)))
        self._put("validation_summary", validation_summary(columns).withColumn("total_rows", F.lit(total_rows).cast("long")))

    def record_events(self, events: DataFrame) -> None:
        """Events of a day's log: seconds, symbols and retries of completed bars, and bars given up."""
        done, left = events.where("type = 'bar_complete'"), events.where("type = 'abandon'")
        self._put("bar_metrics", done.select("bar_time", "cost_seconds", "n_symbols", "retry_count", F.lit("ok").alias("status")))
        self._put("abandon_events", left.select("bar_time", "retry_count", "reason"))
        self._put("bar_metrics", left.select("bar_time", "retry_count", F.lit("abandon").alias("status")))


def _by_bar(df: DataFrame) -> DataFrame:
    return df.withColumn("bar_time", F.date_format("datetime", "HH:mm:ss")).drop("datetime")


def watch_features(spark: SparkSession, folder: str, schema, each, checkpoint: str, trigger: str | None = None):
    """Call each(new rows, batch id) for feature files that appear in a folder, every ``trigger`` or over what is there.

    Which files were seen is in the stream's checkpoint, so none is taken twice after a restart.
    """
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)
    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()
