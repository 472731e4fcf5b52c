"""URL filtering by host and path rules, and by a Bloom filter cascade (DataFrame functions only).

A cascade gives exact membership over a known key universe: level 1 encodes the listed keys, level 2 the
unlisted keys that pass level 1, level 3 the listed keys that pass level 2, and so on until nothing passes
wrongly. Each level is one row with an array of 64-bit words, read as a scalar subquery, so that judging a
key takes no join. Filters have a size at most; beyond it there is a cascade per shard of the keys.

Defined cases: a null url or one without ``://`` has an empty host and path, and is judged as the empty
key; repeated rows get a row each; an empty list blocks nothing; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import operator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, save, table_path

#: (verdict, host, path); a rule fits its host and all subdomains where the url's path starts with its own.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Hash functions of a level at least; a level lets 2**-HASHES of the wrong keys pass.
HASHES = 4
#: Words of a filter at most (64 MB); the keys of a longer list are dealt into shards with a cascade each.
MOST_WORDS = 8_000_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    cases = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))]
    return F.coalesce(*cases)


def places(key: Column, level: int, bits: int, hashes: int = HASHES) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits)) for j in range(hashes)]


def words_for(n: int, hashes: int) -> int:
    """64-bit words of a filter that holds n keys with this number of hash functions."""
    return max(1, math.ceil(n * hashes / math.log(2) / 64))


def bloom(keys: DataFrame, level: int, n: int, hashes: int) -> DataFrame:
    """A one-row table with the words of the keys' filter."""
    words = words_for(n, hashes)
    spot = keys.select(F.explode(F.array(*places(F.col("key"), level, words * 64, hashes))).alias("p"))
    parts = spot.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits"))
    every = keys.sparkSession.range(words).withColumnRenamed("id", "w").join(parts, "w", "left").agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("x"))
    return save(every.select(F.transform("x", lambda s: s["bits"]).alias("words")), f"bloom-{level}")


class Level(NamedTuple):
    """One filter of a cascade."""

    table: DataFrame
    number: int
    bits: int
    hashes: int

    def passes(self, key: Column) -> Column:
        """Whether all of the key's bits are set."""
        words = self.table.select("words").scalar()
        tests = [F.getbit(F.get(words, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1 for p in places(key, self.number, self.bits, self.hashes)]
        return functools.reduce(operator.and_, tests)


def levels_of(inside: DataFrame, outside: DataFrame) -> list[Level]:
    """The cascade's levels for listed and unlisted keys, each once.

    The first level lets no more unlisted keys pass than there are listed ones, however many there are of the
    former, so that no later level is larger than the first.
    """
    levels: list[Level] = []
    n = inside.count()
    hashes = first_hashes(n, outside.count())
    while n:
        level = Level(bloom(inside, len(levels) + 1, n, hashes), len(levels) + 1, words_for(n, hashes) * 64, hashes)
        levels.append(level)
        inside, outside = save(outside.where(level.passes(F.col("key"))), "passed"), inside
        n, hashes = inside.count(), HASHES
    return levels


def first_hashes(listed: int, unlisted: int) -> int:
    return max(HASHES, math.ceil(math.log2(max(1, unlisted) / max(1, listed))))


def listed_by(levels: list[Level], key: Column) -> Column:
    found = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        found = F.when(~level.passes(key), F.lit(level.number % 2 == 0)).otherwise(found)
    return found


class Cascade:
    """Exact membership in a list, over a universe of keys.

    Where a filter would have more than most_words words, keys are dealt into shards by hash, with a cascade
    each. Rows are then written by shard, and a shard's rows are judged by its own cascade alone.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame, most_words: int = MOST_WORDS):
        """listed(key), universe(key). Keys of the list that aren't in the universe are encoded as well."""
        inside = save(listed.select("key").where("key IS NOT NULL").distinct(), "listed")
        outside = save(universe.select("key").where("key IS NOT NULL").distinct().join(inside, "key", "left_anti"), "unlisted")
        n, m = inside.count(), outside.count()
        self.shards = math.ceil(words_for(n, first_hashes(n, m)) / most_words)
        if self.shards == 1:
            self.parts = [levels_of(inside, outside)]
        else:
            inside, outside = self.dealt(inside, "key", "listed-shards"), self.dealt(outside, "key", "unlisted-shards")
            self.parts = [levels_of(inside.where(f"_shard = {i}"), outside.where(f"_shard = {i}")) for i in range(self.shards)]
        self.levels = self.parts[0]

    def dealt(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """rows written by shard of the key; a null key has shard 0. A shard with a very common key takes several tasks."""
        shard = F.coalesce(F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(self.shards)), F.lit(0)).cast("int")
        return save(rows.withColumn("_shard", shard).hint("rebalance", "_shard"), name, by=["_shard"])

    def judge(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """rows with a boolean column: is the key listed?"""
        if self.shards == 1:
            return rows.withColumn(name, listed_by(self.levels, F.col(key)))
        path = table_path(rows.sparkSession, "judged")
        dealt, out = self.dealt(rows, key, "rows-by-shard"), None
        for i, levels in enumerate(self.parts):
            out = dealt.where(f"_shard = {i}").drop("_shard").withColumn(name, listed_by(levels, F.col(key)))
            out.write.mode("append").parquet(path)
        return rows.sparkSession.read.schema(out.schema).parquet(path)


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, most_words: int = MOST_WORDS) -> DataFrame:
    """page_id, host, path, rule, verdict: the longest rule's verdict, else block for listed host-and-path keys and allow for others."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("key", F.concat("host", "path")).withColumn("fit", fitting(F.col("host"), F.col("path"), rules))
    cascade = Cascade(listed, rows.where("fit IS NULL").select("key"), most_words)
    judged = cascade.judge(rows, "key", "is_listed")
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), F.when(F.col("is_listed"), "block").otherwise("allow")).alias("verdict"))


def listed_keys(pages: DataFrame) -> DataFrame:
    """A stand-in for a block list, which the tables don't have: the eighth of the keys whose MD5 starts with 0 or 1."""
    host, path = host_and_path(F.col("url"))
    return pages.select(F.concat(host, path).alias("key")).where(F.substring(F.md5("key"), 1, 1).isin("0", "1")).distinct()


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, listed_keys(pages))


ORACLE = r"""
    WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
    f AS (SELECT *, CASE
            WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
            WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
            WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
            WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM h)
    SELECT page_id, host, path, rule, CASE
        WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
        WHEN substr(md5(host || path), 1, 1) IN ('0', '1') THEN 'block' ELSE 'allow' END AS verdict
    FROM f"""
