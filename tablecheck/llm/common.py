"""What several operators share: size-checked joins, uniform keys, distributed running totals."""

from __future__ import annotations

import ctypes
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.sources.storage import materialise

__all__ = ["BLANKS", "give_back", "materialise", "running_total", "sized_join", "spread_key", "unit", "words_in"]

#: Fixed value: the white space that separates words, as a Java character class.
BLANKS = r"[\x20\x09-\x0D]"
#: A side of a join is broadcast only below this many (narrow) rows, counted before.
BROADCAST_ROWS = 100_000
#: Rows per bucket and buckets per coarse bucket of a running total.
BUCKET_ROWS, COARSE = 512, 4096


def give_back() -> None:
    """Hand memory that numpy and Arrow have freed back to the system. A Python worker outlives its task, and what it
    keeps would add to the memory of every later stage on its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library alone has it, and needs to be told
    if trim:
        trim(0)


def words_in(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def spread_key(seed: str, *parts: Column) -> Column:
    """60 evenly spread bits of the text form of ``parts``: the same in every engine that has MD5."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def unit(key: Column) -> Column:
    """A :func:`spread_key` as a number strictly between 0 and 1."""
    return (F.shiftrightunsigned(key, 8).cast("double") + 0.5) / float(2**52)


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a side whose rows are counted first: broadcast when there are few, else a shuffle join that
    adaptive execution may split. ``small`` should be cheap to count (a written table)."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def running_total(rows: DataFrame, group: list[str], key: str, ties: list[str], value: Column, out: str, total: int) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that come before, in order of ``key``.

    ``key`` holds 60 evenly spread bits, so cutting its range cuts every group into buckets of about
    ``BUCKET_ROWS`` rows however large the group is. Buckets are summed, the sums are added up in two levels,
    and only the rows of one bucket are ever ordered together. ``group`` columns must not be null.
    """
    fine = max(1, math.ceil(total / BUCKET_ROWS))
    bucket = F.floor(F.shiftrightunsigned(F.col(key), 29).cast("double") * F.lit(fine / 2.0**31)).cast("long")
    marked = rows.withColumn("__bucket", bucket).withColumn("__coarse", F.expr(f"__bucket div {COARSE}"))
    sums = marked.groupBy(*group, "__coarse", "__bucket").agg(F.sum(value).alias("__sum"))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    coarse = sums.groupBy(*group, "__coarse").agg(F.sum("__sum").alias("__whole"))
    before = F.coalesce(F.sum("__whole").over(earlier(*group).orderBy("__coarse")), F.lit(0))
    coarse = coarse.select(*group, "__coarse", before.alias("__before_coarse"))
    inside = F.coalesce(F.sum("__sum").over(earlier(*group, "__coarse").orderBy("__bucket")), F.lit(0))
    starts = sums.withColumn("__inside", inside).join(coarse, [*group, "__coarse"])
    starts = starts.select(*group, "__bucket", (F.col("__inside") + F.col("__before_coarse")).alias("__start"))
    there = F.coalesce(F.sum(value).over(earlier(*group, "__bucket").orderBy(key, *ties)), F.lit(0))
    placed = marked.join(starts, [*group, "__bucket"]).withColumn(out, F.col("__start") + there)
    return placed.drop("__bucket", "__coarse", "__start")
