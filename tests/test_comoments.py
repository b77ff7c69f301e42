"""Co-moments, figures by column, removed rows, skipped columns and stable samples on small tables."""

import math
import random

import numpy as np
import pytest

from tablecheck.functions import columns as C
from tablecheck.operators.clean import clean, removed_rows
from tablecheck.operators.comoments import CoMoments, co_moments
from tablecheck.operators.dependencies import sampled_rows
from tablecheck.operators.drift import Drift
from tablecheck.operators.insights import correlation
from pyspark.sql import functions as F


def matrix(rows=400, columns=7, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, columns)) + 1e6
    x[:, 1] = 2 * x[:, 0] + rng.normal(size=rows)
    x[:, 3] = 5.0  # constant
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 4] = np.nan
    x[0, 4] = 1.0
    return x


def pairwise(x):
    k = x.shape[1]
    out = np.full((k, k), np.nan)
    for i in range(k):
        for j in range(k):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            if len(a) > 1 and a.std() > 0 and b.std() > 0:
                out[i, j] = ((a - a.mean()) * (b - b.mean())).sum() / math.sqrt(((a - a.mean()) ** 2).sum() * ((b - b.mean()) ** 2).sum())
    return out


@pytest.mark.parametrize("pieces", [1, 2, 13])
def test_states_merge_to_the_whole(pieces):
    x = matrix()
    state = CoMoments(x.shape[1])
    for part in np.array_split(x, pieces):
        state = state.merge(CoMoments.of(part))
    assert np.allclose(state.correlation(), pairwise(x), atol=1e-9, equal_nan=True)
    again = CoMoments.unpacked(state.packed(), x.shape[1])
    assert np.array_equal(again.cross, state.cross) and (state.merge(CoMoments(x.shape[1])).mean == state.mean).all()


def test_an_infinite_value_spoils_only_its_pairs():
    x = np.array([[1.0, 2, 3], [np.inf, 4, np.nan], [3, 5, 4], [4, 7, 1]])
    r = CoMoments.of(x).correlation()
    assert np.isnan(r[0, 1]) and np.isnan(r[0, 0]) and not np.isnan(r[1, 2])


def test_many_columns_in_one_scan(spark):
    x = matrix(60, 80, 3)
    names = [f"c.{i}" for i in range(80)]
    df = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"`{n}` double" for n in names)).repartition(5)
    state = co_moments(df, names)
    assert np.allclose(state.correlation(), pairwise(x), atol=1e-9, equal_nan=True)
    assert correlation(df, names).count() == 6400
    assert co_moments(df.limit(0), names).n.sum() == 0


def test_figures_by_column(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 7.0)], "a int, b double")
    figures = {"n": F.count("value"), "sum": F.sum("value")}
    values = {c: C.as_number(df, c) for c in df.columns}
    assert C.by_column(df, values, figures) == {"a": {"n": 3, "sum": 6.0}, "b": {"n": 2, "sum": 12.0}}
    assert C.by_column(df.limit(0), values, figures) == {c: {"n": 0, "sum": None} for c in "ab"}
    assert C.by_column(df, {}, figures) == {}


def test_removed_rows_and_kept_rows_make_the_table(spark):
    rows = [(i, float(i % 7), f" n{i % 3}") for i in range(40)] + [(1, 1.0, "n1"), (1, 1.0, "n1 "), (50, 1e9, "far"), (50, 1e9, "far")]
    df = spark.createDataFrame(rows, "id int, v double, `Na me` string")
    result = clean(df, outliers="remove")
    gone = removed_rows(df, result.plan).collect()
    assert sorted((r["id"], r["copies"], r["reason"]) for r in gone) == [(1, 2, "duplicate"), (50, 1, "duplicate"), (50, 1, "outlier")]
    assert result.df.count() + sum(r["copies"] for r in gone) == len(rows)
    assert removed_rows(df.limit(0), result.plan).count() == 0


def test_skipped_columns_have_a_reason(spark):
    ref = spark.createDataFrame([(f"k{i}", "a", None, float(i), "x" if i % 2 else "y", i) for i in range(60)], "many string, one string, none string, v double, fine string, old int")
    new = spark.createDataFrame([("k1", "a", "z", 1.0, "x", True)], "many string, one string, none string, v double, fine string, fresh boolean")
    d = Drift(ref, new)
    assert {r["column"]: r["reason"] for r in d.skipped().collect()} == {
        "fresh": "only in the new table", "old": "only in the reference", "v": "fewer than 5 values on a side",
        "many": "more than 50 different values", "one": "a single value", "none": "no values on a side",
    }
    assert {r["column"] for r in d.categorical_drift_all().collect()} == {"many", "one", "fine"}


def test_samples_do_not_depend_on_partitions(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.random(), rng.choice(["a", None, "b"])) for _ in range(500)], "v double, s string")
    one, two = df.coalesce(1), df.repartition(7, "v")
    assert sorted(map(repr, sampled_rows(one, 50).collect())) == sorted(map(repr, sampled_rows(two, 50).collect()))
    assert sampled_rows(df, 50).count() == 50 and sampled_rows(df, 9999).count() == 500
    assert 60 < sampled_rows(df, 0.2).count() < 140
