import statistics

import pytest

from tablecheck.operators import clean as K
from tablecheck.operators.profile import Profile


def data(df):
    return [tuple(r) for r in df.collect()]


OFF = {"fill_numeric": "none", "fill_text": "none", "drop_duplicates": False}


@pytest.mark.parametrize(
    "names, want",
    [
        (["First Name", "first name"], ["first_name", "first_name_1"]),
        (["A B", "a_b", "A_B"], ["a_b", "a_b_1", "a_b_2"]),
        (["  $$x-y!! ", "***", ""], ["x_y", "col_1", "col_2"]),
        (["x", "x_1", "X"], ["x", "x_1", "x_2"]),
        (["São Paulo"], ["s_o_paulo"]),
    ],
)
def test_names(names, want):
    assert K.normalised_names(names) == want


def test_simple_clean(spark):
    df = spark.createDataFrame([(" Ana ", 30.0, "Recife"), ("Ana", 30.0, "Recife"), ("Bia", None, None)], "Name string, Age double, City string")
    r = K.clean(df)
    assert r.df.columns == ["name", "age", "city"]
    assert sorted(data(r.df)) == [("Ana", 30.0, "Recife"), ("Bia", 30.0, "Recife")]
    assert r.report["columns_renamed"] == 3 and r.report["trimmed_text_columns"] == 2
    assert r.report["dropped_duplicate_rows"] == 1 and r.report["missing_cells_after"] == 0
    assert (r.report["rows_before"], r.report["rows_after"]) == (3, 2)


def test_names_can_be_kept(spark):
    r = K.clean(spark.createDataFrame([(1,)], "`A b` int"), normalise_names=False)
    assert r.df.columns == ["A b"] and r.report["columns_renamed"] == 0


def test_unicode_white_space_is_trimmed(spark):
    r = K.clean(spark.createDataFrame([(" \tx y \n",)], "c string"), **OFF)
    assert data(r.df) == [("x y",)]


def test_tokens_only_in_one_case(spark):
    values = ["na", "NA", " N/A ", "Null", "None", "-", "", "nan", "x"]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    r = K.clean(df, **OFF)
    assert [v for (v,) in data(r.df)] == [None, None, None, "Null", "None", None, None, None, "x"]
    assert r.report["null_tokens_converted"] == 6
    assert K.clean(df, token_match="insensitive", **OFF).report["null_tokens_converted"] == 8
    kept = K.clean(df, replace_null_tokens=False, **OFF)
    assert kept.report["null_tokens_converted"] == 0 and kept.report["missing_cells_after"] == 0


def test_sparse_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "x"), (3, 1.0, "x")], "a int, b double, c string")
    r = K.clean(df, max_missing_pct=50.0, **OFF)
    assert r.df.columns == ["a", "c"] and r.report["dropped_sparse_columns"] == ["b"]
    assert K.clean(df, max_missing_pct=100.0, **OFF).df.columns == ["a", "b", "c"]


def test_limit_is_strict_and_never_drops_everything(spark):
    df = spark.createDataFrame([(None, "x"), (1, "y")], "a int, b string")
    assert K.clean(df, max_missing_pct=50.0, **OFF).df.columns == ["a", "b"]
    empty = spark.createDataFrame([(None, None), (None, None)], "a int, b string")
    assert K.clean(empty, max_missing_pct=0.0, drop_duplicates=False).df.columns == ["a", "b"]


@pytest.mark.parametrize("how, value", [("median", 2.5), ("mean", 4.0), ("zero", 0.0), ("none", None)])
def test_numeric_fill(spark, how, value):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,), (None,)], "v int")
    r = K.clean(df, fill_numeric=how, drop_duplicates=False)
    assert [v for (v,) in data(r.df) if v is not None] == [1, 2, 3, 10] + ([] if value is None else [value])
    assert r.report["numeric_fill"] == how


@pytest.mark.parametrize("how, value", [("mode", "a"), ("unknown", "unknown"), ("none", None)])
def test_text_fill(spark, how, value):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "c string")
    r = K.clean(df, fill_text=how, drop_duplicates=False)
    assert data(r.df)[-1] == (value,)  # of two equally frequent values the smaller one


def test_all_null_text_becomes_unknown_and_all_null_number_stays(spark):
    df = spark.createDataFrame([(None, None, 1)], "c string, v double, k int")
    assert data(K.clean(df).df) == [("unknown", None, 1)]
    assert data(K.clean(df, fill_numeric="zero").df) == [("unknown", 0.0, 1)]


VALUES = [*range(1, 20), 1000, 2000]


@pytest.mark.parametrize("method", ["iqr", "zscore"])
def test_cap(spark, method):
    df = spark.createDataFrame([(v,) for v in VALUES], "v int")
    r = K.clean(df, outliers="cap", outlier_method=method)
    got = [v for (v,) in data(r.df)]
    assert len(got) == len(VALUES) and max(got) < 2000
    if method == "zscore":
        high = statistics.mean(VALUES) + 3 * statistics.stdev(VALUES)
        assert max(got) == pytest.approx(high)
    else:
        assert max(got) == 16 + 1.5 * (16 - 6)
    assert r.report["capped_columns"] == ["v"] and r.report["outlier_rows_removed"] == 0


@pytest.mark.parametrize("method, removed", [("iqr", 2), ("zscore", 1)])
def test_remove(spark, method, removed):
    df = spark.createDataFrame([(v,) for v in VALUES], "v int")
    r = K.clean(df, outliers="remove", outlier_method=method)
    assert r.report["outlier_rows_removed"] == removed
    assert r.df.count() == r.report["rows_after"] == len(VALUES) - removed
    assert r.report["capped_columns"] == []


def test_remove_uses_one_snapshot(spark):
    # Removing by one column must not move the bounds of the other.
    rows = [(i, i) for i in range(20)] + [(1000, 10), (10, 1000)]
    r = K.clean(spark.createDataFrame(rows, "a int, b int"), outliers="remove")
    assert r.report["outlier_rows_removed"] == 2


def test_removed_rows_take_their_nulls_along(spark):
    rows = [(i, "x") for i in range(20)] + [(1000, None), (5, None)]
    r = K.clean(spark.createDataFrame(rows, "a int, c string"), outliers="remove", fill_text="none", drop_duplicates=False)
    assert r.report["missing_cells_after"] == 1


def test_zero_iqr_removes_nothing(spark):
    df = spark.createDataFrame([(5,)] * 5, "v int")
    assert K.clean(df, outliers="remove", drop_duplicates=False).df.count() == 5


def test_cap_keeps_nulls(spark):
    df = spark.createDataFrame([(v,) for v in [*VALUES, None]], "v int")
    assert None in [v for (v,) in data(K.clean(df, outliers="cap", fill_numeric="none").df)]


def test_cleaning_is_idempotent_without_outliers(spark):
    df = spark.createDataFrame([(" x ", None, "NA"), ("x", 2.0, "k"), ("y", 3.0, None), ("y", 3.0, None)], "A string, B double, C string")
    once = K.clean(df).df
    again = K.clean(once)
    assert sorted(data(once)) == sorted(data(again.df))
    assert again.report["dropped_duplicate_rows"] == again.report["null_tokens_converted"] == again.report["columns_renamed"] == 0


def test_report_frame(spark):
    r = K.clean(spark.createDataFrame([(1, "x")], "a int, b string"))
    assert r.report_frame().first().rows_after == 1


def test_recommended_options(spark):
    dirty = spark.createDataFrame([(v, "na" if v == 3 else None if v == 4 else "x") for v in VALUES + [1]], "v int, c string")
    o = K.recommended_options(Profile(dirty))
    assert o.replace_null_tokens and o.drop_duplicates and o.max_missing_pct == 70.0
    assert (o.fill_numeric, o.fill_text, o.outliers) == ("median", "mode", "cap")
    tidy = K.recommended_options(Profile(spark.range(5)))
    assert not tidy.replace_null_tokens and not tidy.drop_duplicates
    assert (tidy.max_missing_pct, tidy.fill_numeric, tidy.outliers) == (100.0, "none", "none")


def test_change_log(spark):
    df = spark.createDataFrame([(1, " a ", 1), (2, "NA", 2), (3, "b", None), (4, "b", 3), (4, "b", 3)], "Id int, C string, N int")
    r = K.clean(df)
    log = [tuple(x) for x in K.change_log(df, r.plan, ["Id"]).collect()]
    assert log == [(1, "c", " a ", "a"), (2, "c", "NA", "b"), (3, "n", None, "2.0")]


def test_plan_applies_to_new_rows(spark):
    r = K.clean(spark.createDataFrame([(v, "x") for v in VALUES], "v int, c string"), outliers="cap")
    out = r.plan.apply(spark.createDataFrame([(9999, " null ")], "v int, c string"))
    assert out.first().v == 31.0


def test_clashing_names_and_untyped_columns(spark):
    df = spark.sql("SELECT 'a' AS Name, 'b ' AS name, NULL AS void FROM range(2)")
    r = K.clean(df)
    assert data(r.df) == [("a", "b", "unknown")]
    assert [x.column for x in K.change_log(df, r.plan, []).collect()] == ["name_1", "void"] * 2
