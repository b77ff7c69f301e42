"""A stored profile that grows with its table: states of parts merge, so that a new part is read and the old ones are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.functions import columns as C
from tablecheck.functions.columns import col

#: Size of a distinct sketch: 2**12 registers, a standard error of 1.6 %.
SKETCH = 12
STATE = "part string, column string, class string, rows long, non_null long, infinite long, n long, low double, high double, mean double, m2 double, sketch binary"


def profile_state(df: DataFrame, part: Column) -> DataFrame:
    """Mergeable state of each column in each part (null: part ``none``): one row per part and column.

    Counts, the finite numbers' count, extremes, mean and sum of squared deviations, and a sketch of distinct values.
    NaN is missing; infinite values are counted apart. One scan; a task sends one row per part and column. A table
    without rows has no state.
    """
    df = C.normalise_missing(df)
    cells = {}
    for c in df.columns:
        number = C.finite(C.as_number(df, c)) if c in C.names_of(df, C.NUMERIC) else F.lit(None).cast("double")
        infinite = F.abs(C.as_number(df, c)) == float("inf") if c in C.names_of(df, C.NUMERIC) else F.lit(False)
        cells[c] = F.struct(C.as_key(df, c).alias("key"), number.alias("num"), F.coalesce(infinite, F.lit(False)).alias("infinite"))
    mark = "\u0001part"  # no clash with a column of the table
    label = F.coalesce(part.cast("string"), F.lit("none")).alias(mark)
    classes = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, C.class_of(f.dataType))])
    num = F.col("value.num")
    state = C.long_form(df, cells, [label]).groupBy(col(mark).alias("part"), "column").agg(
        F.count("*").alias("rows"), F.count("value.key").alias("non_null"), F.count_if("value.infinite").alias("infinite"), F.count(num).alias("n"),
        F.min(num).alias("low"), F.max(num).alias("high"), F.avg(num).alias("mean"), (F.var_pop(num) * F.count(num)).alias("m2"),
        F.hll_sketch_agg("value.key", F.lit(SKETCH)).alias("sketch"),
    )
    state = state.withColumn("class", classes[F.col("column")])
    return state.select(*[field.split()[0] for field in STATE.split(", ")])


def add_parts(df: DataFrame, path: str, part: Column) -> None:
    """Put the state of the parts in ``df`` into the table at ``path``. A part that is there already is replaced whole, so
    a day can be loaded again after a failure; all rows of a part come in one call."""
    writer = profile_state(df, part).repartition("part").write.mode("overwrite")
    writer.partitionBy("part").option("partitionOverwriteMode", "dynamic").parquet(path)


def stored_profile(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Profile of the union of all parts (those in ``names``): ``column``, ``class``, ``rows``, ``non_null``, ``missing``,
    ``infinite``, ``low``, ``high``, ``mean``, ``std``, ``distinct_estimate``. Only states are read.

    A column that a part lacks is missing in all rows of it. A column whose class changes between parts is ``mixed`` and
    has no numbers. Means and deviations are merged about the common mean (Chan); they are of finite values.
    """
    state = spark.read.schema(STATE).parquet(path)
    if names is not None:
        state = state.filter(F.col("part").isin(names))
    n = F.sum("n")
    total = state.groupBy("part").agg(F.max("rows").alias("rows")).agg(F.sum("rows").alias("rows"))
    whole = state.groupBy(col("column")).agg(
        F.when(F.min("class") == F.max("class"), F.min("class")).otherwise("mixed").alias("class"), F.sum("non_null").alias("non_null"), F.sum("infinite").alias("infinite"),
        n.alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum(F.col("mean") * (F.col("n") / F.lit(1.0))).alias("sum"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"),
    )
    whole = whole.withColumn("mean", F.when(F.col("n") > 0, F.col("sum") / F.col("n")))
    apart = state.select("column", "n", "m2", F.col("mean").alias("own")).join(whole.select("column", "mean"), "column")
    spread = apart.groupBy("column").agg(F.sum(F.col("m2") + F.col("n") * F.pow(F.col("own") - F.col("mean"), 2)).alias("m2"))
    rows = total.select("rows").first()[0] or 0
    numeric = F.col("class") == C.NUMERIC
    return whole.join(spread, "column").select(
        "column", "class", F.lit(rows).cast("long").alias("rows"), "non_null", (F.lit(rows) - F.col("non_null")).alias("missing"), "infinite",
        *[F.when(numeric, F.col(c)).alias(c) for c in ("low", "high", "mean")],
        F.when(numeric & (F.col("n") > 1), F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"), "distinct_estimate",
    )
