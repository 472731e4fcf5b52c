"""Statistics of many columns at once: covariances, average ranks, and two frames compared column by column.

Rows go to Python as one array each, and a task keeps sums whose size follows from the number of columns alone. The sums of
tasks are merged by Spark, block of columns by block, in two steps; means and squared deviations are merged as such, so that nothing is lost
by taking large numbers from each other. What comes to the driver is a number per pair of columns.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of a block of a covariance matrix; parts that the sums of tasks are first merged in.
BLOCK, LOTS = 64, 32


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``; without one, only a local master may use a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[.*])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ashlar-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """The frame as a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def as_array(names: list[str]) -> Column:
    """Columns as one array of doubles."""
    return F.array(*[F.col(f"`{c}`").cast("double") for c in names])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column as a matrix; null is NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, width)


# covariances


def with_rows(n: int, mean: np.ndarray, square: np.ndarray, x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and co-moments after some more complete rows."""
    m = x[0] + (x - x[0]).mean(axis=0)  # equal values have this mean exactly, and no rest of a variance
    d = x - m
    return merged((n, mean, square), (len(x), m, d.T @ d), slice(None))


def merged(a: tuple, b: tuple, rows: slice) -> tuple[int, np.ndarray, np.ndarray]:
    """Counts, means and the co-moments of some rows of the matrix, of two parts together."""
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d[rows], d) * (a[0] * b[0] / n)


MOMENTS = "block int, lot int, part int, n long, mean binary, square binary"


def moments(arrays: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and covariances of an array column ``x`` without nulls; NaN where there are too few rows."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = (0, np.zeros(width), np.zeros((width, width)))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                held = with_rows(*held, matrix(batch.column("x").slice(at, 4096), width))
        if held[0]:
            part = TaskContext.get().partitionId()
            for b in range(0, width, BLOCK):
                yield row(b // BLOCK, part % LOTS, part, (*held[:2], held[2][b : b + BLOCK]))

    def row(block: int, lot: int, part: int, held: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([lot], pa.int32()), pa.array([part], pa.int32()), pa.array([held[0]], pa.int64()), pa.array([held[1].tobytes()], pa.binary()), pa.array([np.ascontiguousarray(held[2]).tobytes()], pa.binary())], ["block", "lot", "part", "n", "mean", "square"])

    def added(by: tuple[str, ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, held = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    b = r["block"] * BLOCK
                    key, own = tuple(r[c] for c in by), (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["square"]).reshape(-1, width))
                    if key != last and last is not None:
                        yield row(last[0], last[-1], 0, held)
                    held = own if key != last else merged(held, own, slice(b, b + BLOCK))
                    last = key
            if last is not None:
                yield row(last[0], last[-1], 0, held)

        return run

    rows = arrays.select("x").mapInArrow(of_task, MOMENTS).repartition("block", "lot").sortWithinPartitions("block", "lot", "part").mapInArrow(added(("block", "lot")), MOMENTS)
    rows = rows.repartition("block").sortWithinPartitions("block", "lot").mapInArrow(added(("block",)), MOMENTS).collect()
    if not rows:
        return 0, np.full(width, np.nan), np.full((width, width), np.nan)
    rows = sorted(rows, key=lambda r: r.block)
    square = np.concatenate([np.frombuffer(r.square).reshape(-1, width) for r in rows])
    return rows[0].n, np.frombuffer(rows[0]["mean"]), square / (rows[0].n - 1) if rows[0].n > 1 else np.full((width, width), np.nan)


def correlations(covariance: np.ndarray) -> np.ndarray:
    """Correlation matrix; NaN without variance."""
    with np.errstate(all="ignore"):
        sd = np.sqrt(np.diag(covariance))
        return np.where((sd > 0)[:, None] & (sd > 0), covariance / np.outer(sd, sd), np.nan)


# ranks


def ranks(arrays: DataFrame, width: int) -> DataFrame:
    """``x`` with each value replaced by its average rank in its column, from 1; rows come in any order.

    All columns are ranked by one range partitioning of (column, value). Within a part and column, a window that spills tells each
    value its first and its last place among equal ones; a table of a row per part and column tells how many stand in the
    parts before. A last exchange puts the rows together again. Python has no share in it.
    """
    rows = saved(arrays.select("x").withColumn("row", F.monotonically_increasing_id()))
    long = rows.select("row", F.posexplode("x").alias("column", "value"))
    ranged = long.repartitionByRange("column", "value").withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("column", "part").orderBy("value")  # up to the current value, equal ones included
    placed = saved(ranged.select("row", "column", "part", ((F.rank().over(w) + F.count("*").over(w)) / 2).alias("middle")))
    parts = placed.groupBy("column", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.join(parts.select("column", "part", before.alias("before")), ["column", "part"]).select("row", "column", (F.col("before") + F.col("middle")).alias("rank"))
    together = ranked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("column", "rank"))).alias("r"))  # width entries a row
    return together.select(F.transform("r", lambda r: r["rank"]).alias("x"))


def section_percentiles(df: DataFrame, column: str, shares: list[float], by: str = "timestamp") -> DataFrame:
    """(by, percentiles): exact interpolated percentiles of the known values of each section, as an array in the order of shares.

    Rows are ranged by (section, value), so that a section of any size is dealt to many tasks. A table of a row per section and part tells
    in which part and where the wanted places stand, and these rows alone are joined.
    """
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(F.col(by).alias("of"), x.alias("x"))
    rows = saved(rows.repartitionByRange("of", "x").sortWithinPartitions("of", "x").withColumn("place", F.monotonically_increasing_id()))
    parts = rows.groupBy("of", F.expr("shiftright(place, 33)").alias("part")).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    section = Window.partitionBy("of")
    before = F.coalesce(F.sum("n").over(section.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = saved(parts.select("of", "n", "first", before.alias("before"), F.sum("n").over(section).alias("total")))
    at = F.col("share") * (F.col("total") - 1)
    wanted = parts.select("of", "total").distinct().select("of", "total", F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("k", "share"))
    wanted = wanted.select("of", "k", at.alias("at"), F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("index"))
    holds = (F.col("w.of") == F.col("p.of")) & (F.col("index") >= F.col("before")) & (F.col("index") < F.col("before") + F.col("n"))
    placed = wanted.alias("w").join(parts.alias("p"), holds).select("w.of", "k", "at", "index", (F.col("index") - F.col("before") + F.col("first")).alias("place"))
    found = placed.join(rows.select("place", "x"), "place")  # two rows a section and share
    ends = found.groupBy("of", "k").agg(F.min_by("x", "index").alias("low"), F.max_by("x", "index").alias("high"), (F.first("at") - F.floor(F.first("at"))).alias("rest"))
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + F.col("rest") * (F.col("high") - F.col("low")))
    arrays = ends.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("k", value.alias("v")))).alias("a"))
    return arrays.select(F.col("of").alias(by), F.transform("a", lambda a: a["v"]).alias("percentiles"))


# two frames


COMPARED = "feature int, part int, n long, equal long, most double, pairs long, mean_a double, mean_b double, aa double, bb double, ab double"


def compared(pairs: DataFrame, names: list[str], relative: float, absolute: list[float]) -> DataFrame:
    """feature_name, equal_ratio, max_abs_diff, correlation of array columns ``a`` and ``b`` (null: missing), a row per name.

    Values are equal if both are missing, or differ by less than the relative bound (of b) or the column's absolute one.
    """
    width, bounds = len(names), np.array(absolute, float)
    fields = [f.split()[0] for f in COMPARED.split(", ")]

    def of_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Per column what COMPARED lists from n on."""
        with np.errstate(all="ignore"):
            diff, none = np.abs(a - b), np.isnan(a) & np.isnan(b)
            equal = none | (diff / np.where(b == 0, np.nan, np.abs(b)) < relative) | (diff < bounds)
            ok = ~np.isnan(diff)
            n = ok.sum(axis=0)
            ma, mb = (np.where(n > 0, np.where(ok, x, 0).sum(axis=0) / n, 0.0) for x in (a, b))
            da, db = np.where(ok, a - ma, 0), np.where(ok, b - mb, 0)
            most = np.where(n > 0, np.where(ok, diff, -np.inf).max(axis=0, initial=-np.inf), np.nan)
        return np.stack([np.full(width, len(a), float), equal.sum(axis=0), most, n, ma, mb, (da * da).sum(axis=0), (db * db).sum(axis=0), (da * db).sum(axis=0)])

    def both(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        n = p[3] + q[3]
        share = np.where(n > 0, q[3] / np.maximum(n, 1), 0)
        da, db, w = q[4] - p[4], q[5] - p[5], p[3] * share
        return np.stack([p[0] + q[0], p[1] + q[1], np.fmax(p[2], q[2]), n, p[4] + da * share, p[5] + db * share, p[6] + q[6] + da * da * w, p[7] + q[7] + db * db * w, p[8] + q[8] + da * db * w])

    def batch_of(features, part: int, held: np.ndarray) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), *[pa.float64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(features, pa.int32()), pa.array([part] * len(features), pa.int32()), *[pa.array(x if k == pa.float64() else x.astype(np.int64), k) for x, k in zip(held, kinds, strict=True)]], fields)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                own = of_rows(*(matrix(batch.column(c).slice(at, 1024), width) for c in ("a", "b")))
                held = own if held is None else both(held, own)
        if held is not None:
            yield batch_of(np.arange(width), TaskContext.get().partitionId(), held)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            given = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in fields[2:]])
            for k, f in enumerate(batch.column("feature").to_pylist()):
                own = given[:, k : k + 1]
                if f != last and last is not None:
                    yield batch_of([last], 0, held)
                held = own if f != last else both(held, own)
                last = f
        if last is not None:
            yield batch_of([last], 0, held)

    sums = pairs.select("a", "b").mapInArrow(of_task, COMPARED).repartition("feature").sortWithinPartitions("feature", "part").mapInArrow(added, COMPARED)
    name = F.element_at(F.array(*map(F.lit, names)), F.col("feature") + 1)
    most = F.when(F.col("pairs") > 0, F.col("most"))
    spread = F.sqrt("aa") * F.sqrt("bb")
    return sums.select(name.alias("feature_name"), (F.col("equal") / F.col("n")).alias("equal_ratio"), most.alias("max_abs_diff"), F.when(F.col("pairs") > 1, F.try_divide("ab", spread)).alias("correlation"))


def columns_of(spark: SparkSession, values: np.ndarray, names: list[str]) -> DataFrame:
    """(a, b, corr) of the pairs of a matrix, a before b; null for NaN."""
    pairs = [(a, names[j], None if np.isnan(values[i, j]) else float(values[i, j])) for i, a in enumerate(names) for j in range(i + 1, len(names))]
    return spark.createDataFrame(pairs, "a string, b string, corr double")
