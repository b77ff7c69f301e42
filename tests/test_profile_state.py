"""Stored profiles: the states of parts together say what one pass over all rows says."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from tablecheck.operators.profile_state import add_parts, profile_state, stored_profile


def by_column(df):
    return {r["column"]: r for r in df.collect()}


def test_parts_added_one_by_one_equal_the_whole(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = [(d, None if i % 7 == 0 else 1e9 + d * 10.0 + i, f"v{i % 40}") for d in range(4) for i in range(90)]
    df = spark.createDataFrame(rows, "day int, x double, s string")
    for day in range(4):
        add_parts(df.filter(F.col("day") == day), path, F.col("day"))
    add_parts(df.filter("day = 2"), path, F.col("day"))  # loaded again: replaced, not added
    got = by_column(stored_profile(spark, path))
    x = [v for _, v, _ in rows if v is not None]
    assert (got["x"].rows, got["x"].non_null, got["x"].missing) == (360, len(x), 360 - len(x))
    assert (got["x"].low, got["x"].high) == (min(x), max(x))
    assert got["x"]["mean"] == pytest.approx(statistics.fmean(x), rel=1e-12)
    assert got["x"].std == pytest.approx(statistics.stdev(x), rel=1e-6)
    assert got["s"].distinct_estimate == 40 and got["s"]["class"] == "text" and got["s"]["mean"] is None
    assert by_column(stored_profile(spark, path, ["0", "1"]))["x"].rows == 180


def test_new_columns_changed_classes_and_odd_values(spark, tmp_path):
    path = str(tmp_path / "state")
    add_parts(spark.createDataFrame([("a", 1.0), ("a", math.inf), ("a", math.nan)], "p string, x double"), path, F.col("p"))
    add_parts(spark.createDataFrame([(None, "t", 5)], "p string, x string, part int"), path, F.col("p"))
    got = by_column(stored_profile(spark, path))
    assert (got["x"]["class"], got["x"].rows, got["x"].non_null, got["x"].infinite, got["x"]["mean"]) == ("mixed", 4, 3, 1, None)
    assert (got["part"].rows, got["part"].missing, got["part"]["mean"], got["part"].std) == (4, 3, 5.0, None)
    assert (got["p"].rows, got["p"].missing) == (4, 1)


def test_empty_table_has_no_state(spark):
    assert profile_state(spark.createDataFrame([], "a int, b string"), F.lit("x")).count() == 0
