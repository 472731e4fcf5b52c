"""OHLCV panels: rows (datetime, code, open, high, low, close, volume, amount) built from event-like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Table, code, time, truncation, price, sum for the volume (None: rows), order of rows within a bar.
PANELS = {
    "E": ("events", "user_id", "ts", "day", "value", None, ("ts", "event_id")),
    "H": ("events", "event_type", "ts", "hour", "value", None, ("ts", "event_id")),
    "D": ("lineitem", "l_returnflag", "l_shipdate", "day", "l_extendedprice", "l_quantity", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")),
    "L": ("lineitem", "l_partkey", "l_shipdate", "month", "l_extendedprice", "l_quantity", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")),
}


def bars(df: DataFrame, code: str, time: str, unit: str, price: str, quantity: str | None, order: tuple[str, ...]) -> DataFrame:
    """Bars by one aggregation with map-side combine; open and close are the first and last price in a total order."""
    at = F.struct(time, *[c for c in order if c != time])
    value = F.col(price).cast("double")
    return df.groupBy(F.date_trunc(unit, F.col(time)).cast("timestamp_ntz").alias("datetime"), F.col(code).cast("string").alias("code")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"),
        (F.count("*") if quantity is None else F.sum(F.col(quantity).cast("double"))).cast("double").alias("volume"), F.sum(value).alias("amount"),
    )


def panel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, *rest = PANELS[name]
    return bars(spark.read.parquet(f"{sf_dir}/{table}.parquet"), *rest)


def panel_sql(name: str) -> str:
    """The same panel as DuckDB SQL."""
    table, code, time, unit, price, quantity, order = PANELS[name]
    o = ", ".join([time, *[c for c in order if c != time]])
    p = f"cast({price} as double)"
    volume = "count(*)" if quantity is None else f"sum(cast({quantity} as double))"
    return f"select cast(date_trunc('{unit}', {time}) as timestamp) as datetime, cast({code} as varchar) as code, first({p} order by {o}) as open, max({p}) as high, min({p}) as low, last({p} order by {o}) as close, cast({volume} as double) as volume, sum({p}) as amount from {table} group by 1, 2"
