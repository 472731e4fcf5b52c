"""Shared pieces of the corpus operators: where intermediate tables live and how documents are read."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's settings: rows that go to Python at once, and whether a query's shuffle files go when it has ended.
ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
DROPS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``.

    Where the cluster names none, only a local master may use a folder of this machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[.*])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ashlar-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.conf.get(ROWS_A_BATCH) == "10000":  # Spark's own; texts are large rows
        spark.conf.set(ROWS_A_BATCH, "2000")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/ashlar/{name}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder with Hadoop's file system; a session that has ended is left alone."""
    if spark.sparkContext._jsc is None:
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffle_files_dropped(spark: SparkSession) -> Iterator[None]:
    """Let Spark drop a query's shuffle files when the query has ended; they serve none of what follows."""
    was = spark.conf.get(DROPS, None)
    spark.conf.set(DROPS, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROPS) if was is None else spark.conf.set(DROPS, was)


def save(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write a table to the shared folder, in a folder per value of some columns if told, and read it back: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    with shuffle_files_dropped(spark):
        df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A task's batches in small cuts, so that few of their values are Python objects at once; Arrow's spare memory goes back at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(column):
    """Lower-case A-Z only; Spark's ``lower`` would fold other letters too."""
    return F.translate(column, UPPER, LOWER)
