"""Panel readers and writers: bar files by frequency, minute drop files, dated sinks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")
COLUMNS = ("datetime", "code", *PRICES, "volume", "amount", "name")
MINUTES = {"minute": 1, "5min": 5, "30min": 30}
#: Folders of the bar files by frequency, and how a file's name gives the code.
LAYOUTS = {
    "daily": ("processed_data/日频数据/*/*_daily.csv", r"([^/]+)_daily\.csv$"),
    "30min": ("processed_data/三十分钟频数据/*_30min.csv", r"([^/]+)_30min\.csv$"),
    "minute": ("raw_data/wind_etf_data/*/*.csv", r"([^/]+)_\d{4}\.csv$"),
}
#: Drop files of one minute each.
DROP_SCHEMA = "time string, code string, open double, close double, high double, low double, volume double, money double"


def standardized(df: DataFrame) -> DataFrame:
    """The panel's columns with their types: absent prices null, absent volume and amount 0, code UNKNOWN, name the code."""
    have = set(df.columns)
    number = lambda c: F.expr(f"try_cast(`{c}` as double)") if c in have else F.lit(None).cast("double")
    code = F.coalesce(F.col("code").cast("string"), F.lit("UNKNOWN")) if "code" in have else F.lit("UNKNOWN")
    clean = lambda c: F.when(~F.isnan(number(c)), number(c))
    return df.select(
        F.col("datetime").cast("timestamp_ntz").alias("datetime"), code.alias("code"), *[clean(c).alias(c) for c in PRICES],
        *[F.coalesce(clean(c), F.lit(0.0)).alias(c) for c in ("volume", "amount")], (F.coalesce(F.col("name").cast("string"), code) if "name" in have else code).alias("name"),
    )


def read_bars(spark: SparkSession, root: str, frequency: str, assets: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of a frequency between two dates, both inclusive; 5min bars are made from minute bars."""
    if frequency == "5min":
        return resample_bars(read_bars(spark, root, "minute", assets, start, end), 5)
    if frequency not in LAYOUTS:
        raise ValueError(f"unknown frequency {frequency}")
    glob, pattern = LAYOUTS[frequency]
    raw = spark.read.option("header", True).csv(f"{root}/{glob}")
    named = F.regexp_extract(F.input_file_name(), pattern, 1)
    raw = raw.withColumn("datetime", F.expr("try_cast(date as timestamp_ntz)" if frequency == "daily" else "try_cast(datetime as timestamp_ntz)"))
    if frequency != "minute" or "code" not in raw.columns:
        raw = raw.withColumn("code", named)
    out = standardized(raw)
    if assets is not None:
        out = out.where(F.col("code").isin(assets))
    if start is not None:
        out = out.where(F.col("datetime") >= F.to_date(F.lit(start)).cast("timestamp_ntz"))
    return out if end is None else out.where(F.col("datetime") < F.date_add(F.to_date(F.lit(end)), 1).cast("timestamp_ntz"))


def available_assets(spark: SparkSession, root: str, frequency: str) -> DataFrame:
    """Codes by the names of the files."""
    glob, pattern = LAYOUTS["minute" if frequency == "5min" else frequency]
    files = spark.read.format("binaryFile").load(f"{root}/{glob}").select("path")
    return files.select(F.regexp_extract(F.url_decode("path"), pattern, 1).alias("code")).distinct().orderBy("code")


def availability(assets: DataFrame, bars: DataFrame) -> DataFrame:
    """Per asked code: rows, first and last time; missing codes have 0 rows."""
    found = bars.groupBy("code").agg(F.count("*").alias("rows"), F.min("datetime").alias("first"), F.max("datetime").alias("last"))
    return assets.join(found, "code", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long"))).withColumn("missing", F.col("rows") == 0)


def resample_bars(bars: DataFrame, minutes: int) -> DataFrame:
    """Left-closed bins labelled by their start; bins without a close are dropped."""
    bin_ = F.window(F.col("datetime").cast("timestamp"), f"{minutes} minutes")["start"].cast("timestamp_ntz")
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("datetime"))
    out = bars.groupBy("code", bin_.alias("datetime")).agg(
        F.min_by("open", known("open")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", known("close")).alias("close"),
        F.sum("volume").alias("volume"), F.sum("amount").alias("amount"), F.min_by("name", "datetime").alias("name"),
    )
    return out.where("close IS NOT NULL").select(*COLUMNS)


def keep_symbol(symbol: Column) -> Column:
    """Symbols that start with 2 or 9 are left out."""
    return ~(symbol.startswith("2") | symbol.startswith("9"))


def drop_bars(raw: DataFrame, *extra: str) -> DataFrame:
    """Rows of drop files as minute bars: (time, symbol, prices, volume, money)."""
    symbol = F.substring("code", 1, 6)
    return raw.select(F.to_timestamp_ntz("time").alias("time"), symbol.alias("symbol"), *[F.col(c) for c in ("open", "close", "high", "low", "volume", "money")], *extra).where(keep_symbol(F.col("symbol")))


def read_drop_files(spark: SparkSession, folder: str, end_time: str | None = None) -> DataFrame:
    """All drop files up to a time; of rows for one symbol and time the one of the last file stays."""
    raw = spark.read.schema(DROP_SCHEMA).option("header", True).csv(f"{folder}/kbar_*.csv").withColumn("file", F.input_file_name())
    bars = drop_bars(raw, "file")
    if end_time is not None:
        bars = bars.where(F.date_format("time", "HH:mm") <= end_time)
    return last_of_each(bars, "file").orderBy("symbol", "time")


def last_of_each(bars: DataFrame, order: str) -> DataFrame:
    """Of rows for one symbol and time, the last in an order."""
    w = Window.partitionBy("symbol", "time").orderBy(F.desc(order))
    return bars.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", order)


def auction_bars(auction: DataFrame, day: str) -> DataFrame:
    """Opening auction (symbol, current, volume, money) as 09:30 bars."""
    price = [F.col("current").cast("double").alias(c) for c in ("open", "close", "high", "low")]
    return auction.select(F.to_timestamp_ntz(F.lit(f"{day} 09:30:00")).alias("time"), "symbol", *price, F.col("volume").cast("double").alias("volume"), F.col("money").cast("double").alias("money"))


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """Bars of the first source, and of the second where the first has none; ``source`` tells which."""
    rest = second.join(first.select("symbol", "time"), ["symbol", "time"], "left_anti")
    return first.withColumn("source", F.lit("first")).unionByName(rest.withColumn("source", F.lit("second")))


def complete(bars: DataFrame, least: int = 100) -> DataFrame:
    """Bars of the times that have enough symbols."""
    times = bars.groupBy("time").agg(F.count_distinct("symbol").alias("n")).where(F.col("n") >= least).select("time")
    return bars.join(times, "time", "left_semi")


def previous_trade_date(bars: DataFrame, day: str):
    """The last date with bars before a day; None if there is none."""
    return bars.where(F.col("time") < F.to_timestamp_ntz(F.lit(f"{day} 00:00:00"))).agg(F.max(F.to_date("time"))).first()[0]


def last_days(bars: DataFrame, day: str, days: int = 5) -> DataFrame:
    """Bars of the last trading days before a day."""
    found = bars.where(F.to_date("time") < F.to_date(F.lit(day))).select(F.to_date("time").alias("d")).distinct().orderBy(F.desc("d")).limit(days)
    return bars.withColumn("d", F.to_date("time")).join(found, "d", "left_semi").drop("d")


@dataclass
class DatedSink:
    """Writes a frame in one folder per date of ``datetime``; rewriting a date replaces it."""

    path: str
    file_format: str = "parquet"

    def save(self, df: DataFrame, start: str | None = None, end: str | None = None) -> None:
        d = df.withColumn("_date", F.to_date("datetime"))
        d = d if start is None else d.where(F.col("_date") >= F.to_date(F.lit(start)))
        d = d if end is None else d.where(F.col("_date") <= F.to_date(F.lit(end)))
        d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("_date").format(self.file_format).save(self.path)


PANEL_SCHEMA = T.StructType([T.StructField("datetime", T.TimestampNTZType()), T.StructField("code", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in (*PRICES, "volume", "amount")], T.StructField("name", T.StringType())])
