"""Exact duplicate rows, found without shuffling whole rows.

A 64-bit row hash is grouped first (8 bytes per row instead of the row). Only rows whose hash
repeats are compared in full, so hash collisions never change a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.functions.columns import NESTED, TEXT, as_key, class_of, col
from tablecheck.sources.storage import materialise

NARROW = 8  # fixed-width columns that are about as cheap to shuffle as a hash
BROADCAST_HASHES = 1_000_000  # 8 MB of hashes; beyond it rows are grouped in full
_HASH = "__row_hash"


def row_hash(df: DataFrame) -> Column:
    """Hash of all cells plus the positions of the nulls, which ``xxhash64`` alone would skip."""
    parts: list[Column] = []
    for f in df.schema.fields:
        c = as_key(df, f.name) if class_of(f.dataType) == NESTED else col(f.name)
        parts += [c, c.isNull()]
    return F.xxhash64(*parts)


def _comparable(df: DataFrame) -> list[Column]:
    """Grouping keys; maps cannot be grouped, so nested cells are compared as JSON."""
    return [
        (as_key(df, f.name) if class_of(f.dataType) == NESTED else col(f.name)).alias(f"__g{i}")
        for i, f in enumerate(df.schema.fields)
    ]


def _is_narrow(df: DataFrame) -> bool:
    return len(df.columns) <= NARROW and all(class_of(f.dataType) not in (TEXT, NESTED) for f in df.schema.fields)


def repeated_hashes(df: DataFrame) -> tuple[DataFrame, int]:
    """Hashes that occur more than once, and how many there are.

    They are written out, so that the passes that use them do not group all rows again.
    """
    hashes = df.select(row_hash(df).alias(_HASH)).groupBy(_HASH).count().where("count > 1").select(_HASH)
    kept = materialise(hashes, "row-hashes")
    return kept, kept.count()


def _suspects(df: DataFrame) -> DataFrame:
    """All rows whose hash repeats (the whole table where that is cheaper than finding out)."""
    if _is_narrow(df):
        return df
    hashes, repeated = repeated_hashes(df)
    if repeated > BROADCAST_HASHES:
        return df
    return df.withColumn(_HASH, row_hash(df)).join(F.broadcast(hashes), _HASH, "left_semi").drop(_HASH)


def duplicate_rows(df: DataFrame) -> int:
    """Rows equal to an earlier row; nulls equal each other."""
    suspects = _suspects(df)
    groups = suspects.groupBy(*_comparable(suspects)).agg(F.count("*").alias("n")).where("n > 1")
    return int(groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0])


def repeated_rows(df: DataFrame, name: str) -> DataFrame:
    """One of each group of equal rows, with the number of its further copies as ``name``."""
    suspects = _suspects(df)
    keys = _comparable(suspects)
    row = F.first(F.struct(*[col(c) for c in df.columns])).alias("__row")
    groups = suspects.groupBy(*keys).agg(row, (F.count("*") - 1).alias("__more")).where("__more > 0")
    return groups.select("__row.*", F.col("__more").alias(name))


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One copy of every distinct row.

    Rows whose hash is unique pass straight from the scan to the result; only suspected copies are
    shuffled. With very many repeated hashes a plain ``dropDuplicates`` does less work.
    """
    if any(isinstance(f.dataType, T.MapType) for f in df.schema.fields):
        keys = _comparable(df)
        return df.select("*", *keys).dropDuplicates([f"__g{i}" for i in range(len(keys))]).select(
            *[col(c) for c in df.columns]
        )
    if _is_narrow(df):
        return df.dropDuplicates()
    hashes, repeated = repeated_hashes(df)
    if repeated == 0:
        return df
    if repeated > BROADCAST_HASHES:
        return df.dropDuplicates()
    hashed = df.withColumn(_HASH, row_hash(df))
    unique = hashed.join(F.broadcast(hashes), _HASH, "left_anti").drop(_HASH)
    copies = hashed.join(F.broadcast(hashes), _HASH, "left_semi").drop(_HASH)
    return unique.unionByName(copies.dropDuplicates())
