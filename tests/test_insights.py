import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tablecheck.operators import insights as I
from tablecheck.operators.profile import Profile


def test_column_choices(spark):
    rows = [(i, i % 3, 7, f"g{i % 4}", f"t{i}", f"2024-01-{1 + i % 28:02d}") for i in range(40)]
    p = Profile(spark.createDataFrame(rows, "id int, code int, fixed int, g string, t string, data_x string"))
    assert I.analysable_columns(p) == ["code"]
    assert I.grouping_columns(p) == ["g"]
    assert I.date_columns(p) == ["data_x"]
    assert I.display_columns(p, "id") == ["id", "g", "code"]


def test_date_column_by_name_needs_all_cells(spark):
    rows = [(i, "2024-01-01" if i < 40 else "x", "2024-01-01" if i != 3 else "x", 20240100 + i % 28 + 1, 20240100 + i, None) for i in range(60)]
    p = Profile(spark.createDataFrame(rows, "k int, mes string, dia string, date_key int, date_num int, ano string"))
    # One is suggested by its values; of those named like dates only some hold nothing else.
    assert I.date_columns(p) == ["dia", "date_key", "ano"]


def test_timestamp_column_named_like_a_date(spark):
    p = Profile(spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "order_date timestamp"))
    assert I.date_columns(p) == ["order_date"]


def test_describe_equals_pandas(spark):
    x = np.random.default_rng(1).gamma(2, 3, 200)
    r = I.describe(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double"), ["v"]).first()
    s = pd.Series(x)
    assert r["count"] == 200
    for got, want in [
        (r["min"], s.min()), (r.q1, s.quantile(0.25)), (r.median, s.median()), (r["mean"], s.mean()), (r.q3, s.quantile(0.75)),
        (r["max"], s.max()), (r["std"], s.std()), (r.skewness, s.skew()), (r.kurtosis, s.kurt()),
    ]:
        assert got == pytest.approx(want)


def test_describe_of_constant_and_tiny_columns(spark):
    r = I.describe(spark.createDataFrame([(5.0,)] * 4, "v double"), ["v"]).first()
    assert (r.std, r.skewness, r.kurtosis) == (0.0, 0.0, 0.0)
    r = I.describe(spark.createDataFrame([(5.0,)], "v double"), ["v"]).first()
    assert r["std"] is None and r.skewness is None


def test_histogram_keeps_the_largest_value(spark):
    h = I.histogram(spark.createDataFrame([(float(i),) for i in range(31)], "v double"), "v").collect()
    assert sum(r.n for r in h) == 31 and max(r.bin for r in h) == 30
    assert I.histogram(spark.createDataFrame([(5.0,), (5.0,)], "v double"), "v").first().n == 2
    assert I.histogram(spark.createDataFrame([(None,)], "v double"), "v").count() == 0


def test_boxplot(spark):
    r = I.boxplot(spark.createDataFrame([(float(v),) for v in [*range(1, 20), 1000]], "v double"), ["v"]).first()
    assert (r.whisker_low, r.whisker_high, r.beyond, r.median) == (1.0, 19.0, 1, 10.5)


@pytest.mark.parametrize("how, want", [
    ("mean", [("b", 1.0), ("a", 2.5)]), ("sum", [("b", 1.0), ("a", 5.0)]), ("count", [("b", 1), ("a", 2)]),
    ("median", [("b", 1.0), ("a", 2.5)]), ("max", [("b", 1.0), ("a", 4.0)]), ("min", [("a", 1.0), ("b", 1.0)]),
])
def test_group_aggregates(spark, how, want):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 1.0), (None, 9.0), ("b", None)], "g string, v double")
    assert [tuple(r) for r in I.group_aggregate(df, "g", "v", how).collect()] == want


def test_group_of_nulls(spark):
    df = spark.createDataFrame([("a", None)], "g string, v double")
    assert I.group_aggregate(df, "g", "v", "sum").first()["value"] == 0.0
    assert I.group_aggregate(df, "g", "v", "median").first()["value"] is None


def test_resample_keeps_empty_buckets(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-04", 3.0), ("bad", 9.0)], "d string, v double")
    D = dt.date
    assert [tuple(r) for r in I.resample(df, "d", "v", "mean").collect()] == [
        (D(2024, 1, 1), 1.0), (D(2024, 1, 2), None), (D(2024, 1, 3), None), (D(2024, 1, 4), 3.0),
    ]
    assert [r["value"] for r in I.resample(df, "d", "v", "sum").collect()] == [1.0, 0.0, 0.0, 3.0]
    assert [r["value"] for r in I.resample(df, "d", "v", "count").collect()] == [1, 0, 0, 1]


@pytest.mark.parametrize("days, rule", [(10, "D"), (15, "W"), (40, "W"), (61, "ME"), (400, "ME")])
def test_resample_equals_pandas(spark, days, rule):
    start = dt.datetime(2024, 1, 17, 5)
    rows = [(start + dt.timedelta(days=i), float(i)) for i in range(0, days + 1, 5)] + [(start + dt.timedelta(days=days), 1.0)]
    got = [(r.bucket, r["value"]) for r in I.resample(spark.createDataFrame(rows, "t timestamp, v double"), "t", "v", "sum").collect()]
    want = pd.DataFrame(rows, columns=["t", "v"]).set_index("t")["v"].resample(rule).sum()
    assert got == [(k.date(), v) for k, v in want.items()]


def test_resample_without_dates(spark):
    assert I.resample(spark.createDataFrame([("x", 1.0)], "d string, v double"), "d", "v").count() == 0


def test_correlation(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, None, 5.0), (4.0, 7.9, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, k double")
    got = {(r.x, r.y): r.r for r in I.correlation(df, ["a", "b", "k"]).collect()}
    want = pd.DataFrame(rows, columns=["a", "b", "k"]).corr()
    assert got["a", "b"] == pytest.approx(want.loc["a", "b"]) == got["b", "a"]
    assert got["a", "a"] == 1.0 and got["a", "k"] is None and got["k", "k"] is None
    assert I.correlation_matrix(df, ["a", "b"]).columns == ["x", "a", "b"]


def test_top_and_bottom(spark):
    df = spark.createDataFrame([(i, None if i == 3 else float(i % 5)) for i in range(10)], "k int, v double")
    assert [r.k for r in I.top_n(df, "v", 3, None, ["k"]).collect()] == [4, 9, 8]
    assert [r.k for r in I.bottom_n(df, "v", 3, None, ["k"]).collect()] == [0, 5, 1]
    assert [r.k for r in I.bottom_n(df, "v", 10, None, ["k"]).collect()][-1] == 3


def test_scatter(spark):
    df = spark.createDataFrame([(float(i), float(i * i), "ab"[i % 2]) for i in range(20)], "x double, y double, g string")
    assert I.scatter(df, "x", "y", "g").columns == ["x", "y", "colour"]
    assert sum(r.n for r in I.scatter_bins(df, "x", "y", 4).collect()) == 20


def test_missing_map_and_patterns(spark):
    df = spark.createDataFrame([(2, None), (1, "x"), (3, None)], "k int, c string")
    assert [tuple(r) for r in I.missing_map(df, ["k"], rows=2).collect()] == [(1, 0, 0), (2, 0, 1)]
    assert {(r.columns, r.n) for r in I.missing_patterns(df).collect()} == {("", 1), ("c", 2)}
    assert I.preview(df, 1, ["k"]).first().k == 1
