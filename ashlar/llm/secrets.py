"""Incremental secret scan over a ledger of content-addressed blobs (DataFrame functions only).

Every version of every path is addressed by the SHA-256 of its text. The ledger holds which rule versions
have been tried on which blobs; a rule's version is its name with a digest of its pattern and bounds. A scan
reads one copy of each blob that lacks some of the rules asked for, tries these alone, writes what they found
and that they were tried, and joins the findings back to all paths that hold the blob. So a changed rule is
tried on all blobs, and no other rule is.

Defined cases: a null text is the empty blob; empty texts have no findings; repeated rows and paths give
a row each; null is a path like the others; the work on a text is in proportion to its length, whatever the
number of its matches; an empty table adds nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, save, table_path

#: Fixed patterns. kind: (pattern, least length, group whose length counts, pattern that a text without a match can be told by).
RULES = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    "access": (r"AKIA[A-Z0-9]{14,}", 18, 0),
    "hex": (r"[0-9a-f]{16,}", 16, 0),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", 1, 0),
}
BASE = ("assign", "access", "hex")
#: Text that any match of a rule has; looked for before the pattern is tried.
HAS = {"access": "AKIA", "pem": "PRIVATE KEY-----", "jwt": "eyJ"}
FINDING = "array<struct<start:int,rank:int,kind:string,end:int,rule:string>>"
LEDGER = f"blob string, rules array<string>, spans {FINDING}"
#: Matches whose places are summed up at once.
RUN = 256


def version(kind: str) -> str:
    """A rule's name with a digest of what it does."""
    return f"{kind}-{hashlib.sha256(repr(RULES[kind][:3]).encode()).hexdigest()[:12]}"


def bound(value: Column, use) -> Column:
    """Use a value in an expression, worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, kind: str) -> Column:
    """Array of (start, rank, kind, end, rule) of a rule's matches, in code points.

    The pieces between the matches and the matches themselves tile the text, so the places are running
    sums of their lengths: over runs of RUN matches, then inside each run.
    """
    pattern, least, group = RULES[kind]
    rank = list(RULES).index(kind)
    counted = (lambda hit: F.length(F.regexp_extract(hit, pattern, group))) if group else F.length

    def placed(t: Column) -> Column:
        last = F.size(t["hits"]) - 1
        gap, hit = lambda i: F.length(F.get(t["gaps"], i)), lambda i: F.get(t["hits"], i)
        inside = lambda r: F.sequence(r * RUN, F.least(r * RUN + RUN - 1, last))
        runs = F.sequence(F.lit(0), F.floor(last / RUN).cast("int"))
        starts = F.aggregate(runs, F.array(F.lit(0)), lambda acc, r: F.array_append(acc, F.element_at(acc, -1) + F.aggregate(inside(r), F.lit(0), lambda n, i: n + gap(i) + F.length(hit(i)))))
        step = lambda acc, i: F.struct(
            (acc["at"] + gap(i) + F.length(hit(i))).alias("at"),
            F.array_append(acc["out"], F.struct((acc["at"] + gap(i)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (acc["at"] + gap(i) + F.length(hit(i))).alias("end"), F.lit(version(kind)).alias("rule"))).alias("out"),
        )
        none = F.from_json(F.lit("[]"), FINDING)
        each = F.zip_with(runs, F.slice(starts, 1, F.size(runs)), lambda r, at: F.aggregate(inside(r), F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"]))
        return F.filter(F.flatten(each), lambda x, i: counted(hit(i)) >= least)

    likely = text.contains(HAS[kind]) & text.rlike(pattern) if kind in HAS else text.rlike(pattern)
    found = bound(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps")), placed)
    return F.when(likely, found).otherwise(F.from_json(F.lit("[]"), FINDING))


class Ledger:
    """Which rules were tried on which blobs, and what they found: a Parquet table that only grows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """blob, rules, spans; empty before the first scan. A blob has a row for each scan that tried rules on it."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def unseen(self, named: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
        """blob, _path (of one copy), todo: the asked rules that haven't been tried on the blob."""
        asked = F.array(*[F.lit(version(k)) for k in kinds])
        tried = self.read().groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("tried"))  # a row per scan and blob
        blobs = named.groupBy("blob").agg(F.min("_path").alias("_path")).join(tried, "blob", "left")
        return blobs.select("blob", "_path", F.array_except(asked, F.coalesce("tried", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0)

    def scan(self, versions: DataFrame, path_column: str, kinds: tuple[str, ...] = tuple(RULES)) -> DataFrame:
        """Try what hasn't been tried on versions(path_column, text), and return path_column, blob, spans for all of them.

        One copy of each blob with untried rules is picked by its path, so only its text is moved and scanned;
        the ledger row is written with the findings in one append, so a scan that breaks off is done again.
        """
        named = versions.select(F.col(path_column).alias("_path"), F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
        unseen = save(self.unseen(named, kinds), "unseen")
        todo = {r.rule for r in unseen.select(F.explode("todo").alias("rule")).distinct().collect()}  # a row per rule
        wanted = [k for k in kinds if version(k) in todo]
        if wanted:
            # a text that lacks what all untried rules need isn't moved
            needed = [F.col("text").contains(HAS[k]) if k in HAS else F.lit(True) for k in wanted]
            moved = F.when(F.exists(F.array(*needed), lambda x: x), F.col("text")).otherwise("")
            # null paths must match: a blob may have no other
            u = unseen.select(F.col("blob").alias("_blob"), F.col("_path").alias("_least"), "todo")
            texts = named.select("_path", "blob", moved.alias("text")).join(u.hint("shuffle_hash"), (F.col("blob") == F.col("_blob")) & F.col("_path").eqNullSafe(F.col("_least")))
            none = F.from_json(F.lit("[]"), FINDING)
            spans = [F.when(F.array_contains("todo", version(k)), matches(F.col("text"), k)).otherwise(none) for k in wanted]
            # repeated rows of one path and text come once; rows are already dealt by these columns
            found = texts.select("blob", "_path", "todo", F.array_sort(F.concat(*spans)).alias("spans")).dropDuplicates(["blob", "_path"])
            found.select("blob", F.col("todo").alias("rules"), "spans").write.mode("append").parquet(self.path)
        asked = [version(k) for k in kinds]
        found = self.read().where(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        found = found.select("blob", F.array_sort(F.filter("spans", lambda x: x["rule"].isin(asked))).alias("spans"))
        return named.select("blob", F.col("_path").alias(path_column)).join(found, "blob", "left")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans of all documents: by the base rules, then by all; the second tries the added rules alone."""
    ledger, docs = Ledger(spark, table_path(spark, "secret-ledger")), documents(spark, sf_dir)
    ledger.scan(docs, "doc_id", BASE)
    found = ledger.scan(docs, "doc_id")
    spans = F.coalesce("spans", F.from_json(F.lit("[]"), FINDING))
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda x: x["rank"] < len(BASE))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
