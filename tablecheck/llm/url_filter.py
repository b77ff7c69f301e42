"""Longest-match URL rules decided by cascades of Bloom filters, without a join on the keys."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.llm.common import materialise

#: Bits per key and probes of every level.
BITS_PER_KEY, PROBES = 12, 6
#: A level larger than this is refused: filters travel to every task.
MAX_LEVEL_BYTES = 64 << 20


def host_of(url: Column) -> Column:
    """Host of a url, A-Z lower-cased; empty for null and for urls without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty for null and for urls without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass
class Cascade:
    """Levels of one list: level 1 encodes the listed keys, level 2 the keys of the universe that level 1 takes for
    listed, level 3 the listed keys that level 2 takes, and so on until nothing is mistaken."""

    levels: list[tuple[int, DataFrame]]

    def contains(self, key: Column) -> Column:
        """Exact membership for every key of the universe: the first level that misses a key decides."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels), 0, -1):
            words, table = self.levels[number - 1]
            answer = F.when(_all_set(table.scalar(), words, number, key), answer).otherwise(F.lit(number % 2 == 0))
        return answer


def _probes(words: int, level: int, key: Column) -> list[Column]:
    """Bit numbers of every probe: double hashing, with other hashes on every level."""
    a, b = (F.shiftrightunsigned(F.xxhash64(F.lit(2 * level + i), key), 33) for i in (0, 1))
    return [F.pmod(a + F.lit(i) * b, F.lit(words * 64)) for i in range(PROBES)]


def _all_set(bits: Column, words: int, level: int, key: Column) -> Column:
    found = F.lit(True)
    for s in _probes(words, level, key):
        found = found & (F.getbit(F.get(bits, F.shiftright(s, 6).cast("int")), (s % 64).cast("int")) == 1)
    return found


def _level(keys: DataFrame, count: int, number: int) -> tuple[int, DataFrame]:
    """One filter as a table of one row: the bits as an array of 64-bit words."""
    words = max(1, math.ceil(count * BITS_PER_KEY / 64))
    if words * 8 > MAX_LEVEL_BYTES:
        raise ValueError(f"a filter of {count} keys takes {words * 8} bytes, more than {MAX_LEVEL_BYTES}")
    bits = keys.select(F.explode(F.array(*_probes(words, number, F.col("key")))).alias("s"))
    bits = bits.select(F.shiftright("s", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(s % 64 AS int))").alias("mask"))
    bits = bits.groupBy("word").agg(F.bit_or("mask").alias("mask"))
    full = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("word")).join(bits, "word", "left")
    packed = F.array_sort(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))))
    return words, materialise(full.agg(packed.alias("w")).select(F.col("w.mask").alias("bits")), "bloom")


def build_cascade(universe: DataFrame) -> Cascade:
    """``universe``: distinct ``key`` and whether it is ``listed``. Every level is a job over what the last one mistook."""
    levels: list[tuple[int, DataFrame]] = []
    side, other = universe.filter("listed").select("key"), universe.filter("not listed").select("key")
    count = side.count()
    while count:
        level = _level(side, count, len(levels) + 1)
        levels.append(level)
        mistaken = materialise(other.filter(_all_set(level[1].scalar(), level[0], len(levels), F.col("key"))), "mistaken")
        side, other, count = mistaken, side, mistaken.count()
    return Cascade(levels)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules ``(verdict, "host/path")`` as a table; verdicts are ``allow`` and ``block``."""
    return spark.createDataFrame([(v, r, r[: r.index("/")], r[r.index("/") :]) for v, r in rules], "verdict string, rule string, host string, path string")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """Judge every url by the longest rule (host, path) that fits.

    A rule fits its host and all subdomains if the path starts with the rule's; longest in characters wins, of
    equally long ones the one with the longer host. A url offers one candidate key for each shape (labels of the
    host, characters of the path) that occurs in the rules. All distinct candidates of the table are the
    universe over which the two cascades, for blocking and allowing rules, are built; so the filters are exact
    for these urls and looking up a url needs no join. ``otherwise`` is the verdict where no rule fits.

    ``rules``: verdict, rule, host, path; its size bounds every filter. Result: id, ``host``, ``path``, ``rule``,
    ``verdict``, one row per input row, repeated rows included. Null urls and urls without ``://`` have empty host
    and path and fit no rule. Empty tables and empty rule lists work; other columns are ignored.
    """
    spark = pages.sparkSession
    shapes = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.char_length("path").alias("chars")).distinct().collect()
    shapes = sorted(((s.labels, s.chars) for s in shapes), reverse=True)
    base = pages.select(F.col(id_col).alias("__id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))

    def key(labels: int, chars: int) -> Column:
        fits = (F.size(F.split("host", r"\.")) >= labels) & (F.char_length("path") >= chars) & (F.col("host") != "")
        return F.when(fits, F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, chars)))

    keys = [key(*s) for s in shapes]
    if not keys:
        return base.select(F.col("__id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    seen = base.select("host", "path").distinct().select(F.explode(F.array(*keys)).alias("key")).filter("key is not null").distinct()
    # a key string names a host and a path, as hosts hold no "/"
    listed = rules.groupBy(F.col("rule").alias("key")).agg(F.max(F.col("verdict") == "block").alias("block"), F.max(F.col("verdict") == "allow").alias("allow"))
    known = seen.join(listed, "key", "left")
    known = materialise(known.select("key", F.coalesce("block", F.lit(False)).alias("block"), F.coalesce("allow", F.lit(False)).alias("allow")), "url-keys")
    blocked, allowed = (build_cascade(known.select("key", F.col(v).alias("listed"))) for v in ("block", "allow"))

    found = [F.when(k.isNotNull() & (blocked.contains(k) | allowed.contains(k)), F.struct(F.char_length(k).alias("n"), F.lit(labels).alias("labels"), k.alias("rule"))) for k, (labels, _) in zip(keys, shapes, strict=True)]
    best = F.greatest(*found)["rule"] if len(found) > 1 else found[0]["rule"]
    judged = base.withColumn("rule", best)
    verdict = F.when(F.col("rule").isNull(), otherwise).when(blocked.contains(F.col("rule")), "block").otherwise("allow")
    return judged.select(F.col("__id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
