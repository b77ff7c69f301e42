import pytest

from tablecheck.operators import score as S
from tablecheck.operators.profile import Profile

CLEAN = dict.fromkeys(S.DEFAULT_WEIGHTS, 0.0)


def test_clean_table_scores_100():
    assert S.score_of(CLEAN) == (100.0, "excellent", {})


@pytest.mark.parametrize("preset, cut", [("general", 10.0), ("financial", 15.0), ("marketing", 7.5), ("hr", 12.5), ("logistics", 10.0)])
def test_duplicates_by_preset(preset, cut):
    score, _, breakdown = S.score_of({**CLEAN, "duplicates": 5.0}, S.PRESETS[preset])
    assert score == 100 - cut and breakdown == {"duplicates": -cut}


def test_caps_and_range():
    score, level, breakdown = S.score_of(dict.fromkeys(CLEAN, 100.0))
    assert score == 5.0 and level == "critical"
    assert breakdown == {k: -v for k, v in S.CAPS.items()}


def test_more_missing_never_scores_higher():
    scores = [S.score_of({**CLEAN, "missing": m})[0] for m in (0, 1, 5, 10, 50)]
    assert scores == sorted(scores, reverse=True)


def test_custom_weights_override_some():
    inputs = {**CLEAN, "missing": 10.0, "duplicates": 1.0}
    assert S.score_of(inputs, {"missing": 0.0})[0] == 98.0


@pytest.mark.parametrize("score, level", [(90, "excellent"), (89.9, "good"), (75, "good"), (74.9, "attention"), (55, "attention"), (54.9, "critical"), (0, "critical")])
def test_levels(score, level):
    assert S.level_of(score) == level


def test_issues_of_a_clean_table(spark):
    p = Profile(spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(9)], "v double, c string"))
    r = S.issues(p).collect()
    assert len(r) == 1 and (r[0].priority, r[0].issue) == ("low", "no critical problem")


def test_issues_are_ranked(spark):
    rows = [(None if i < 5 else float(i), 1, f"name {i:02d}") for i in range(12)] + [(11.0, 1, "name 11")] * 120
    p = Profile(spark.createDataFrame(rows, "v double, k int, c string"))
    got = [(r.priority, r.issue) for r in S.issues(p).collect()]
    assert got[0] == ("high", "duplicate rows")
    assert ("medium", "constant column") in got and ("medium", "near-duplicate text") in got and ("medium", "missing data") in got
    assert [g[0] for g in got] == sorted((g[0] for g in got), key=lambda x: {"high": 0, "medium": 1, "low": 2}[x])


def test_limited_issues_say_what_they_leave_out(spark):
    p = Profile(spark.createDataFrame([(1, 1, 1, 1, i) for i in range(9)], "a int, b int, c int, d int, v int"))
    all_of = [r.details for r in S.issues(p).collect() if r.issue == "constant column"]
    assert all_of == [f"column {c} never varies" for c in "abcd"]
    some = [r.details for r in S.issues(p, most={"constant column": 3}).collect() if r.issue == "constant column"]
    assert some == [*all_of[:3], "1 more"]


def test_alerts_and_bands(spark):
    rows = [(None, None, "a@b.co")] * 3 + [(1, None, "c@d.org")]
    p = Profile(spark.createDataFrame(rows, "v int, w string, mail string"))
    got = {(r.severity, r.topic) for r in S.alerts(p).collect()}
    assert {("warning", "missing"), ("warning", "duplicates"), ("info", "constant"), ("info", "pattern")} <= got
    assert {r.figure: r.band for r in S.health_bands(p).collect()} == {"missing_cells": "red", "duplicate_rows": "red"}


def test_outlier_input_is_the_mean_over_flagged_columns(spark):
    rows = [(i, i % 10) for i in range(19)] + [(1000, 3)]
    p = Profile(spark.createDataFrame(rows, "v int, w int"))
    assert S.penalty_inputs(p)["outlier"] == 5.0
