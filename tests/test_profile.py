import pytest

from tablecheck.operators.profile import Profile

ERROR_TABLES = [
    "missing_table", "column_profile", "constant_table", "placeholder_table", "type_suggestions", "outlier_table",
    "pattern_table", "cardinality_table", "near_dup_table", "functional_deps",
]


def column(df, name):
    return [r[name] for r in df.collect()]


@pytest.mark.parametrize("schema", ["", "a double, b string"])
def test_empty_table_gives_error_and_empty_results(spark, schema):
    p = Profile(spark.createDataFrame([], schema or "struct<>"))
    assert p.error
    assert p.summary().first().rows == 0
    for name in ERROR_TABLES:
        assert getattr(p, name)().count() == 0


def test_text_only_table(spark):
    p = Profile(spark.createDataFrame([("Ana", "Recife"), ("Bia", "Natal")], "name string, city string"))
    assert p.error is None
    assert p.outlier_table().count() == 0
    assert p.summary().first().rows == 2


def test_missing_counts_null_and_nan(spark):
    p = Profile(spark.createDataFrame([(1.0, None), (float("nan"), 2.0), (3.0, None)], "a double, b double"))
    s = p.summary().first()
    assert (s.missing_cells, s.missing_cells_pct) == (3, 50.0)
    assert [tuple(r) for r in p.missing_table().collect()] == [("b", 2, 66.67), ("a", 1, 33.33)]


def test_infinity_is_not_missing(spark):
    p = Profile(spark.createDataFrame([(float("inf"),), (1.0,)], "a double"))
    assert p.missing_cells == 0


def test_duplicates_count_nulls_as_equal(spark):
    p = Profile(spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (2, None), (None, "2")], "a int, b string"))
    assert p.duplicate_rows == 2
    assert p.summary().first().duplicate_rows_pct == 40.0


def test_null_position_matters_for_duplicates(spark):
    p = Profile(spark.createDataFrame([("x", None), (None, "x"), ("x", None)], "a string, b string"))
    assert p.duplicate_rows == 1


def test_duplicates_with_nested_cells(spark):
    df = spark.sql("SELECT * FROM VALUES (map('a', 1), array(1)), (map('a', 1), array(1)), (map('a', 2), array(1)) v(m, l)")
    p = Profile(df)
    assert p.duplicate_rows == 1
    assert p.column_profile().count() == 2


def test_constant_columns(spark):
    df = spark.createDataFrame([(5, 1, None, "x"), (5, 2, None, None), (5, 3, None, "x")], "a int, b int, c string, d string")
    p = Profile(df)
    assert p.constant_columns == ["a", "c"]  # one value plus nulls is two values
    assert p.summary().first().constant_columns == 2


def test_column_profile(spark):
    p = Profile(spark.createDataFrame([(1, "x"), (2, None), (2, "x")], "a int, b string"))
    assert [tuple(r) for r in p.column_profile().collect()] == [
        ("a", "int", 3, 0, 0.0, 2, False),
        ("b", "string", 2, 1, 33.33, 1, False),
    ]


def test_negative_zero_is_zero(spark):
    assert Profile(spark.createDataFrame([(0.0,), (-0.0,)], "a double")).distinct == {"a": 1}


def test_placeholders_any_case_and_padding(spark):
    values = ["NA", " none ", "Null", "-", "", "n/a", "ok", None]
    p = Profile(spark.createDataFrame([(v,) for v in values], "c string"))
    assert [tuple(r) for r in p.placeholder_table().collect()] == [("c", 6, 75.0)]


@pytest.mark.parametrize("values", [["1", "2.5", "-3", "1e5", "+7", ".5", "x"], ["inf", "1", "2", "3", "4"]])
def test_numeric_like_text(spark, values):
    p = Profile(spark.createDataFrame([(v,) for v in values], "c string"))
    assert column(p.type_suggestions(), "suggested_type") == ["numeric"]


def test_not_numeric_like_text(spark):
    p = Profile(spark.createDataFrame([(v,) for v in ["1,5", "1_000", "0x1F", "1d", "1f", "nan", ""]], "c string"))
    assert p.text_figures["c"]["numbers"] == 0
    assert p.type_suggestions().count() == 0


def test_distinct_local_times_are_counted_as_numbers(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'1960-01-01 00:00:00.000001'), (TIMESTAMP_NTZ'1960-01-01 00:00:00.000002'), (TIMESTAMP_NTZ'2500-01-01'), (NULL), (TIMESTAMP_NTZ'2500-01-01') t(x)")
    p = Profile(df)
    assert p.distinct["x"] == 3
    from tablecheck.operators.frequency import _typed_cells

    assert dict(_typed_cells(df, ["x"])[0].dtypes)["value"] == "bigint"


def test_datetime_like_text(spark):
    good = ["2024-01-31", "31/12/2023", "12/31/2023", "2024-01-31 10:20:30", "2024-01-31T10:20", "20240105", "2024-01", "2023", "Jan 5 2024", "5 Jan 2024", "2024/1/5", "2024-01-31 10:20:30.25"]
    bad = ["2024-02-30", "34", "May", "01310-100", "4500", "1500", "13/13/2024", "x"]
    p = Profile(spark.createDataFrame([(g, b) for g, b in zip(good, bad + [None] * 4)], "g string, b string"))
    assert p.text_figures["g"]["dates"] == len(good)
    assert p.text_figures["b"]["dates"] == 0
    assert [tuple(r) for r in p.type_suggestions().select("column", "suggested_type", "confidence_pct").collect()] == [("g", "datetime", 100.0)]


def test_numbers_win_over_dates_on_a_tie(spark):
    p = Profile(spark.createDataFrame([("2021",), ("2022",), ("2023",)], "year string"))
    assert column(p.type_suggestions(), "suggested_type") == ["numeric"]


def test_outlier_found(spark):
    p = Profile(spark.createDataFrame([(v,) for v in [*range(1, 20), 1000]], "v int"))
    r = p.outlier_table().first()
    assert (r.outlier_count_iqr, r.outlier_pct_iqr, r.outlier_count_zscore, r.outlier_pct_zscore) == (1, 5.0, 1, 5.0)


def test_no_outliers_without_spread_or_rows(spark):
    assert Profile(spark.createDataFrame([(5,)] * 5, "v int")).outlier_table().count() == 0
    assert Profile(spark.createDataFrame([(5,)], "v int")).outlier_table().count() == 0
    assert Profile(spark.createDataFrame([(None, 1), (None, 2), (None, 3)], "a double, b int")).outlier_table().count() == 0


def test_booleans_are_not_numeric(spark):
    p = Profile(spark.createDataFrame([(i % 2 == 0, i) for i in range(12)], "flag boolean, v int"))
    assert p.numeric == ["v"]
    assert ("flag", 2) in [(r.column, r.unique_values) for r in p.cardinality_table().collect()]


def test_high_cardinality_text(spark):
    p = Profile(spark.createDataFrame([(f"ID{i:03d}", i % 7) for i in range(20)], "id string, v int"))
    r = p.cardinality_table().first()
    assert (r.column, r.unique_pct) == ("id", 100.0) and "high" in r.flag


def test_low_cardinality_code(spark):
    p = Profile(spark.createDataFrame([(i % 3, i) for i in range(12)], "status int, v int"))
    r = p.cardinality_table().first()
    assert (r.column, r.unique_values) == ("status", 3) and "low" in r.flag


def test_many_valued_double_is_not_flagged(spark):
    p = Profile(spark.createDataFrame([(i * 1.5,) for i in range(30)], "price double"))
    assert p.cardinality_table().count() == 0


def test_cardinality_needs_more_than_ten_values(spark):
    p = Profile(spark.createDataFrame([(f"x{i}", 1) for i in range(10)], "a string, b int"))
    assert p.cardinality_table().count() == 0


@pytest.mark.parametrize(
    "pattern, value",
    [
        ("email", "Joana.Souza+x@mail.example.org"),
        ("cpf", "123.456.789-09"),
        ("cpf", "12345678909"),
        ("cnpj", "12.345.678/0001-95"),
        ("cep", "01310-100"),
        ("phone", "+55 (11) 98765-4321"),
        ("plate", "abc-1234"),
        ("plate", "ABC1D23"),
        ("date_br", "3/12/2024"),
        ("url", "HTTPS://example.org/a?b=1"),
    ],
)
def test_patterns(spark, pattern, value):
    # Exactly at the limit: 60 % of the non-null values.
    values = [f" {value} "] * 6 + ["zzz"] * 4 + [None] * 5
    p = Profile(spark.createDataFrame([(v,) for v in values], "c string"))
    r = p.pattern_table().first()
    assert (r.column, r.pattern, r.match_pct) == ("c", pattern, 60.0)


def test_pattern_below_limit_or_with_line_break(spark):
    p = Profile(spark.createDataFrame([(v,) for v in ["a@b.co", "a@b.co", "x", "y"]], "c string"))
    assert p.pattern_table().count() == 0
    p = Profile(spark.createDataFrame([("01310-100\n01310-100",)], "c string"))
    assert p.pattern_table().count() == 0


def test_dependency(spark):
    cities = {"Recife": "PE", "Olinda": "PE", "Natal": "RN"}
    p = Profile(spark.createDataFrame([(c, s) for c, s in cities.items() for _ in range(10)], "city string, state string"))
    assert [tuple(r) for r in p.functional_deps().collect()] == [("city", "state", 3)]


def test_column_names_with_dots_and_spaces(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, None)], "`a.b c` double, `x y` string")
    p = Profile(df)
    assert [r.column for r in p.column_profile().collect()] == ["a.b c", "x y"]
    assert p.numeric_figures["a.b c"]["mean"] == 1.5


def test_many_columns_in_batches(spark):
    n = 230
    df = spark.range(3).selectExpr(*[f"id + {i} AS c{i}" for i in range(n)])
    p = Profile(df)
    assert p.summary().first().columns == n
    assert set(p.distinct.values()) == {3}


def test_approximate_distinct_counts(spark):
    p = Profile(spark.range(5000).selectExpr("id", "CAST(id % 10 AS STRING) AS s"), approx_distinct=True)
    assert abs(p.distinct["id"] - 5000) < 500 and p.distinct["s"] == 10


def test_infinite_values_do_not_break_statistics(spark):
    from tablecheck.operators import insights as I

    df = spark.createDataFrame([(float(i), float(i)) for i in range(20)] + [(float("inf"), 1.0)], "v double, w double")
    p = Profile(df)
    r = p.outlier_table().first()
    assert (r.column, r.outlier_count_iqr, r.outlier_count_zscore) == ("v", 1, 0)
    assert sum(x.n for x in I.histogram(df, "v").collect()) == 20
    assert sum(x.n for x in I.scatter_bins(df, "v", "w").collect()) == 20
    assert {x.r for x in I.correlation(df, ["v", "w"]).where("x != y").collect()} == {None}
