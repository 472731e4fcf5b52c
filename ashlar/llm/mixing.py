"""Mix sources to target weights with a low-discrepancy schedule (DataFrame functions only).

Sources get targets by weight; a source that would be read more than ``max_epochs`` times is held at
that and the excess goes to the others by weight. Each source's documents, in shuffled order, form a
stream that is cut into blocks of about ``block_words`` words. Slot i of the schedule takes the source
in whose share of the cumulative weights the i-th golden-ratio point falls; the r-th slot of a source
takes the source's block r modulo its number of blocks.

Defined cases: null or empty texts have size 0 and are never taken; a null source is a source of its own,
last in order; repeated rows count each, and those of one doc_id stand together in the order of their sizes; rows
without a doc_id are mixed like others, as one document; texts of any length are cut into blocks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, save

#: Points are multiples of this step modulo RING: the golden ratio's fraction in 31 bits, made odd.
RING, STEP = 1 << 31, 1327217885
#: Shuffled streams and schedules are summed up in two levels, over so many hash buckets or slots.
BUCKETS, SLOT_RUN = 4096, 65536
#: Cells into which the cumulative weights are cut, to find a point's source by an equality join.
CELLS = 1024
#: A table of sources is broadcast up to so many rows only (under 1 MB); else the joins shuffle.
MAX_BROADCAST_SOURCES = 10_000


@dataclass
class Mix:
    """sized: a row per document; sources: targets; schedule: slots; pieces: the documents' parts of blocks."""

    sized: DataFrame
    sources: DataFrame
    schedule: DataFrame
    pieces: DataFrame


def with_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and the number of words."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights=(5, 2, 1), share=1.5, max_epochs=2, block_words=32) -> DataFrame:
    """One row per source: sid, source, source_size, target, blocks, lo and hi (its share of the ring).

    The fill level is found in closed form: with sources ordered by cap/weight, the first k that aren't
    above their cap when the k-1 before them are held at theirs fixes the level.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(ordered))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("cap", F.col("source_size") * float(max_epochs))
    every = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    before, after = every.rowsBetween(Window.unboundedPreceding, -1), every.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("level", level)
    holds = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("cap_rank", "level"))
    s = s.withColumn("cap_rank", F.row_number().over(every)).withColumn("level", F.min(holds).over(whole)["level"])
    s = s.withColumn("target", F.least(F.coalesce(F.col("level") * F.col("w"), F.col("cap")), F.col("cap")))
    s = s.withColumn("blocks", F.when(F.col("source_size") > 0, F.greatest(F.lit(1), F.round(F.col("source_size") / block_words))).otherwise(0).cast("long"))
    wanted = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    up_to = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("wanted", wanted).withColumn("sum_wanted", F.sum("wanted").over(up_to)).withColumn("all_wanted", F.sum("wanted").over(whole))
    ring = lambda c: F.when(F.col("all_wanted") > 0, F.round(c / F.col("all_wanted") * RING)).otherwise(0).cast("long")
    return s.select(
        "sid", "source", "source_size", "target", "blocks", F.lit(int(max_epochs)).alias("max_epochs"),
        ring(F.col("sum_wanted") - F.col("wanted")).alias("lo"), ring(F.col("sum_wanted")).alias("hi"),
        F.round("all_wanted").cast("long").alias("slots"),
    )


def small(sources: DataFrame) -> DataFrame:
    """Broadcast the sources where they're few; a count over the bound leaves the choice to Spark."""
    return F.broadcast(sources) if sources.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES else sources


def schedule(sources: DataFrame) -> DataFrame:
    """slot, sid, block, epoch: golden-ratio points through the cumulative shares, ranked per source.

    Ranks are made in two levels (runs of slots, then slots in a run), so that a source with most slots
    isn't one task's work.
    """
    spark = sources.sparkSession
    n = sources.agg(F.coalesce(F.max("slots"), F.lit(0))).first()[0]
    width = RING // CELLS
    cells = sources.where("hi > lo").select("sid", "blocks", "max_epochs", "lo", "hi", F.explode(F.sequence((F.col("lo") / width).cast("long"), ((F.col("hi") - 1) / width).cast("long"))).alias("cell"))
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("x", (F.col("slot") % RING) * STEP % RING)
    slots = slots.withColumn("cell", (F.col("x") / width).cast("long")).withColumn("run", (F.col("slot") / SLOT_RUN).cast("long"))
    hit = slots.join(small(cells), "cell").where("x >= lo AND x < hi").select("slot", "run", "sid", "blocks", "max_epochs")
    runs = hit.groupBy("sid", "run").agg(F.count("*").alias("n"))
    runs = runs.select("sid", "run", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")) - 1
    ranked = hit.join(runs, ["sid", "run"]).withColumn("rank", rank).where(F.col("rank") < F.col("blocks") * F.col("max_epochs"))
    return ranked.select("slot", "sid", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("epoch"))


def cut(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """sid, doc_id, at (its first word's place in the source's stream), block, words: the documents' parts of blocks."""
    d = sized.where("size > 0").join(small(sources.select("sid", "source", "source_size", "blocks")), F.expr("sized_source <=> source")).drop("source", "sized_source")
    d = d.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    sums = d.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(sums, ["sid", "bucket"]).withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # block b holds the words w with floor(w * blocks / source_size) = b; the products pass 64 bits from some 17 G words a source on
    wide = lambda x: f"cast({x} as decimal(38, 0))"
    block_of = lambda w: F.expr(f"({wide(w)} * blocks) div source_size")
    d = d.withColumn("block", F.explode(F.sequence(block_of("at"), block_of("(at + size - 1)"))))
    first, end = (F.expr(f"({wide(b)} * source_size + blocks - 1) div blocks") for b in ("block", "block + 1"))
    return d.select("sid", "doc_id", "at", "size", "block", (F.least(end, F.col("at") + F.col("size")) - F.greatest(first, F.col("at"))).alias("words"))


def mix(docs: DataFrame, weights=(5, 2, 1), share=1.5, max_epochs=2, block_words=32, seed=11) -> Mix:
    sized = save(with_sizes(docs), "mix-sizes")
    sources = save(targets(sized, weights, share, max_epochs, block_words), "mix-sources")
    return Mix(sized, sources, schedule(sources), cut(sized.withColumnRenamed("source", "sized_source"), sources, seed))


def taken(m: Mix) -> DataFrame:
    """Per document row: doc_id, size, source_size, target, taken."""
    times = m.schedule.groupBy("sid", "block").agg(F.count("*").alias("times"))
    got = m.pieces.join(times, ["sid", "block"], "left").groupBy("sid", "at", "doc_id", "size").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    got = got.join(small(m.sources.select("sid", "source_size", "target")), "sid").select("doc_id", "size", "source_size", "target", "taken")
    none = m.sized.where("size = 0").withColumnRenamed("source", "sized_source").join(small(m.sources.select("source", "source_size", "target")), F.expr("sized_source <=> source"))
    return got.unionByName(none.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The documents as often as the mix takes them (words taken over size, rounded), with their columns.

    Documents without words can't be taken and stay once.
    """
    times = taken(mix(docs, **parameters)).groupBy("doc_id").agg(F.max(F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1)).cast("int").alias("_times"))
    times = times.where("_times > 0").select(F.col("doc_id").alias("_doc_id"), F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy"))
    return docs.join(times, docs["doc_id"].eqNullSafe(F.col("_doc_id"))).select(*[docs[c] for c in docs.columns])


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(mix(documents(spark, sf_dir)))
