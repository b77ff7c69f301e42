"""Type classes of columns, missing-value normalisation and the long layout."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT = "text"
NUMERIC = "numeric"
BOOLEAN = "boolean"
DATETIME = "datetime"
NESTED = "nested"


def col(name: str) -> Column:
    """Reference a column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def class_of(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return NESTED


def names_of(df: DataFrame, *classes: str) -> list[str]:
    """Names of the columns that belong to any of the given classes, in table order."""
    return [f.name for f in df.schema.fields if class_of(f.dataType) in classes]


def type_names(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def normalise_missing(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL once, so that everything later only tests for NULL.

    A column of no type at all (only NULL literals) becomes text, so that it can be written.
    """
    changes = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            changes[f.name] = F.nanvl(col(f.name), F.lit(None))
        elif isinstance(f.dataType, T.NullType):
            changes[f.name] = F.lit(None).cast("string")
    return df.withColumns(changes) if changes else df


def as_number(df: DataFrame, name: str) -> Column:
    """The column as double, negative zero folded into zero."""
    return col(name).cast("double") + F.lit(0.0)


def finite(v: Column) -> Column:
    """The value unless it is infinite; bins of equal width need finite bounds."""
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def as_key(df: DataFrame, name: str) -> Column:
    """Text that is equal for two values exactly when the values are equal.

    Long text is replaced by its SHA-256, which keeps the shuffled key short whatever the
    cells hold. The leading control character keeps digests apart from short cells.
    """
    dtype = df.schema[name].dataType
    if class_of(dtype) == TEXT:
        return F.when(F.octet_length(col(name)) <= 96, col(name)).otherwise(
            F.concat(F.lit("\u0001"), F.sha2(col(name), 256))
        )
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return as_number(df, name).cast("string")
    if class_of(dtype) == NESTED:
        return F.to_json(F.struct(col(name)))
    return col(name).cast("string")


def long_form(df: DataFrame, values: dict[str, Column], keep: Iterable[Column] = ()) -> DataFrame:
    """One row per cell: ``(kept columns, column, value)``.

    This is one Expand inside the scan stage, so a following ``groupBy("column")`` collapses to
    one row per column and task before anything is shuffled. It stays one plan of fixed size for
    tables with hundreds of columns, unlike one aggregate expression per column and measure.
    """
    keep = list(keep)
    wide = df.select(*keep, *[v.alias(n) for n, v in values.items()])
    kept = wide.columns[: len(keep)]
    return wide.unpivot([col(k) for k in kept], [col(n) for n in values], "column", "value")


def local_frame(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small result table; ``rows`` is bounded by the number of columns, never by table rows."""
    return spark.createDataFrame(rows, schema)


def by_column(df: DataFrame, values: dict[str, Column], figures: dict[str, Column]) -> dict[str, dict]:
    """``{column: {figure: value}}`` of aggregates over ``value``: the same ones for each of any number of columns.

    One scan and one plan of fixed size: cells in long form, grouped by column; a task sends one row per column.
    """
    if not values:
        return {}
    cells = long_form(df, values)
    rows = cells.groupBy("column").agg(*[f.alias(name) for name, f in figures.items()]).collect()
    found = {r["column"]: {name: r[name] for name in figures} for r in rows}
    missing = set(values) - set(found)
    if missing:  # an empty table has no cells
        empty = cells.agg(*[f.alias(name) for name, f in figures.items()]).first().asDict()
        found |= {c: dict(empty) for c in missing}
    return {c: found[c] for c in values}


def measure(df: DataFrame, figures: dict, most: int = 24) -> dict:
    """Whole-table aggregates by name, as plain values, for figures that differ from column to column.

    Map-only scans that send one row per task. A list of more aggregates than ``most`` is measured in several, as one
    generated method for all would outgrow what the JVM compiles; figures of many columns go through :func:`by_column`.
    """
    out = {}
    items = list(figures.items())
    for start in range(0, len(items), most):
        part = items[start : start + most]
        row = df.agg(*[c.alias(f"f{i}") for i, (_, c) in enumerate(part)]).first()
        out.update({name: row[i] for i, (name, _) in enumerate(part)})
    return out
