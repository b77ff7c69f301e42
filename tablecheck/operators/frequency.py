"""Value frequencies: the shared basis of distinct counts, modes and category comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.functions.columns import as_key, col, long_form


def value_counts(df: DataFrame, columns: list[str], keep: list[Column] = ()) -> DataFrame:
    """``(kept columns, column, value, n)`` over non-null cells; value as text.

    Counting merges equal cells before the shuffle, so a value that fills a third of the table
    costs one row per task.
    """
    values = {c: col(c).cast("string") for c in columns}
    long = long_form(df, values, keep).where("value is not null")
    return long.groupBy(*long.columns).agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """``(column, distinct)`` over non-null cells.

    Exact: one row per distinct cell is shuffled, numbers and times as 8 bytes, long text as a
    digest. ``approx`` shuffles only HyperLogLog sketches.
    """
    out = None
    for cells in _typed_cells(df, columns):
        if approx:
            part = cells.groupBy("slot").agg(F.approx_count_distinct("value").alias("distinct"))
        else:
            each = cells.where("value is not null").groupBy("slot", "value").agg(F.lit(1).alias("one"))
            part = each.groupBy("slot").agg(F.count("*").alias("distinct"))
        out = part if out is None else out.unionByName(part)
    names = F.array(*[F.lit(c) for c in columns])
    return out.select(names[F.col("slot")].alias("column"), "distinct")


def _typed_cells(df: DataFrame, columns: list[str]) -> list[DataFrame]:
    """``(slot, value)`` per kind of value; each kind scans only its own columns."""
    kinds: dict[str, list[Column]] = {}
    for i, c in enumerate(columns):
        dtype = df.schema[c].dataType
        if isinstance(dtype, (T.IntegralType, T.BooleanType)):
            kind, v = "long", col(c).cast("int").cast("long") if isinstance(dtype, T.BooleanType) else col(c).cast("long")
        elif isinstance(dtype, T.DateType):
            kind, v = "long", F.unix_date(col(c)).cast("long")
        elif isinstance(dtype, T.TimestampType):
            kind, v = "long", F.unix_micros(col(c))
        elif isinstance(dtype, T.TimestampNTZType):
            kind, v = "long", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col(c))
        elif isinstance(dtype, (T.FloatType, T.DoubleType)):
            kind, v = "double", col(c).cast("double")
        else:
            kind, v = "text", as_key(df, c)
        kinds.setdefault(kind, []).extend([F.lit(i), v])
    return [df.select(F.stack(F.lit(len(v) // 2), *v).alias("slot", "value")) for v in kinds.values()]


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value)``: the most frequent non-null text; ties go to the smallest value.

    Only maxima are compared, so no column's values ever meet in one task.
    """
    counts = value_counts(df, columns)
    top = counts.groupBy("column").agg(F.max("n").alias("n"))
    tied = counts.join(F.broadcast(top), ["column", "n"])  # one row per column
    return tied.groupBy("column").agg(F.min("value").alias("value"))
