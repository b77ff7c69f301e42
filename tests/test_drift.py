import math
import random

import numpy as np
import pytest

from tablecheck.operators.drift import Drift

rng = np.random.default_rng(42)


def frame(spark, values, schema="v double"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], schema)


def cat(spark, counts, name="cat"):
    return spark.createDataFrame([(k,) for k, n in counts.items() for _ in range(n)], f"{name} string")


def test_schema_diff(spark):
    ref, new = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"), spark.createDataFrame([(1, 2, 3)], "a int, b int, d int")
    assert {tuple(r) for r in Drift(ref, new).schema_diff().collect()} == {
        ("d", "added"), ("c", "removed"), ("a", "common"), ("b", "common"),
    }


def test_numeric_shift(spark):
    r = Drift(frame(spark, rng.normal(0, 1, 200)), frame(spark, rng.normal(10, 1, 200))).numeric_drift().first()
    assert r.drifted and r.ks_statistic == 1.0 and r.p_value == 0.0


def test_numeric_stable(spark):
    x = rng.normal(0, 1, 200)
    assert not Drift(frame(spark, x[::2]), frame(spark, x[1::2])).numeric_drift().first().drifted


def test_small_samples_are_skipped(spark):
    d = Drift(frame(spark, [1, 2, 3, 4, None]), frame(spark, [1, 2, 3, 4, 5]))
    assert d.numeric_drift().count() == 0 and d.summary().first().drifted_numeric == 0


def test_zero_reference_mean_has_no_delta(spark):
    r = Drift(frame(spark, [-2, -1, 0, 1, 2]), frame(spark, [1, 2, 3, 4, 5])).numeric_drift().first()
    assert r.mean_ref == 0 and r.delta_pct is None


def test_booleans_count_as_numbers(spark):
    a = spark.createDataFrame([(True,)] * 50 + [(False,)] * 50, "v boolean")
    b = spark.createDataFrame([(True,)] * 95 + [(False,)] * 5, "v boolean")
    r = Drift(a, b).numeric_drift().first()
    assert (r.mean_ref, r.mean_new, r.ks_statistic, r.drifted) == (0.5, 0.95, 0.45, True)


@pytest.mark.parametrize("edges", [4, 1000])
@pytest.mark.parametrize("seed", range(3))
def test_ks_equals_brute_force(spark, edges, seed):
    r = random.Random(seed)
    a = [round(r.gauss(0, 2), 1) for _ in range(300)] + [7.0] * 150
    b = [round(r.gauss(0.3, 2), 1) for _ in range(280)] + [-3.0] * 40 + [float("inf")]
    d = Drift(frame(spark, a), frame(spark, b), edges=edges).ks_statistics["v"]
    want = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in {*a, *b})
    assert d == pytest.approx(want, abs=1e-12)


def test_ks_values_of_a_cell_in_pieces(spark, monkeypatch):
    """Two cells, twelve pieces: no window holds more than about its share, and the result stays exact."""
    r = random.Random(5)
    a, b = [r.gauss(0, 1) for _ in range(3000)], [r.gauss(0.05, 1) for _ in range(2500)] + [1.5] * 200
    seen, cut = [], Drift._in_pieces

    def watched(counts, pieces):
        out = cut(counts, pieces)
        seen.extend(x["count"] for x in out.groupBy("i", "b", "piece").count().collect())
        return out

    monkeypatch.setattr(Drift, "_in_pieces", staticmethod(watched))
    d = Drift(frame(spark, a), frame(spark, b), edges=2, piece_rows=500).ks_statistics["v"]
    want = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in {*a, *b})
    assert d == pytest.approx(want, abs=1e-12)
    assert len(seen) >= 5 and max(seen) <= 1200


def test_ks_of_itself_is_zero(spark):
    x = frame(spark, rng.normal(0, 1, 100))
    r = Drift(x, x).numeric_drift().first()
    assert (r.ks_statistic, r.p_value, r.drifted) == (0.0, 1.0, False)


def test_p_value_series(spark):
    a = frame(spark, range(100))
    b = frame(spark, [x + 20 for x in range(100)])
    r = Drift(a, b).numeric_drift().first()
    x = math.sqrt(50) * 0.2
    want = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))
    assert r.ks_statistic == 0.2 and r.p_value == pytest.approx(want, abs=1e-4)


def test_mean_shift_method(spark):
    d = Drift(frame(spark, rng.normal(0, 1, 50)), frame(spark, rng.normal(1, 1, 50)), method="mean_shift")
    r = d.numeric_drift().first()
    assert r.drifted and r.ks_statistic is None and r.p_value is None
    with pytest.raises(ValueError):
        Drift(frame(spark, [1]), frame(spark, [1]), method="x")


def test_psi_shift(spark):
    r = Drift(cat(spark, {"A": 80, "B": 20}), cat(spark, {"A": 20, "B": 80})).categorical_drift().first()
    assert r.psi == round(1.2 * math.log(4), 4) and (r.severity, r.drifted) == ("significant", True)


def test_psi_moderate_and_new_category(spark):
    r = Drift(cat(spark, {"A": 50, "B": 50}), cat(spark, {"A": 66, "B": 34})).categorical_drift().first()
    assert r.severity == "moderate" and r.drifted
    r = Drift(cat(spark, {"A": 50, "B": 50}), cat(spark, {"A": 50, "C": 50})).categorical_drift().first()
    assert (r.unique_ref, r.unique_new, r.severity) == (2, 2, "significant")


def test_psi_same_is_zero(spark):
    x = cat(spark, {"A": 50, "B": 50})
    r = Drift(x, x).categorical_drift().first()
    assert (r.psi, r.severity, r.drifted) == (0.0, "stable", False)


def test_psi_skips_many_or_single_values(spark):
    many = cat(spark, {f"x{i}": 1 for i in range(100)}), cat(spark, {f"x{i}": 1 for i in range(50, 150)})
    assert Drift(*many).categorical_drift().count() == 0
    assert Drift(cat(spark, {"A": 5}), cat(spark, {"A": 9})).categorical_drift().count() == 0


def test_text_decided_by_the_reference_side(spark):
    ref = spark.createDataFrame([("1",)] * 6 + [("2",)] * 4, "v string")
    new = spark.createDataFrame([(1,)] * 2 + [(2,)] * 8, "v int")
    assert Drift(ref, new).categorical_drift().count() == 1
    assert Drift(new, ref).categorical_drift().count() == 0


def test_no_common_columns(spark):
    d = Drift(spark.createDataFrame([(1,)] * 6, "a int"), spark.createDataFrame([(1,)] * 6, "b int"))
    assert d.numeric_drift().count() == d.categorical_drift().count() == 0
    r = d.summary().first()
    assert (r.rows_ref, r.rows_new, r.drifted_numeric, r.drifted_categorical) == (6, 6, 0, 0)
    assert d.histogram().count() == d.category_compare().count() == 0


def test_ranking_and_comparisons(spark):
    ref = spark.createDataFrame([(float(i), float(i), "A" if i % 5 else "B") for i in range(100)], "same double, moved double, c string")
    new = spark.createDataFrame([(float(i), i + 40.0, None if i % 2 else "B") for i in range(100)], "same double, moved double, c string")
    d = Drift(ref, new)
    assert [(r.kind, r.column, r.drifted) for r in d.ranked().collect()] == [
        ("categorical", "c", True), ("numeric", "moved", True), ("numeric", "same", False),
    ]
    h = d.histogram().collect()
    assert sum(r.n for r in h) == 200 and max(r.bin for r in h) == 30 and {r.source for r in h} == {"reference", "current"}
    shares = {(r.source, r.category): r.frequency for r in d.category_compare().collect()}
    assert shares[("current", "None")] == 0.5  # nulls are a category here
