"""The registered queries: contract of the entry module and a sample compared with SQL."""

import os

import pytest

import __spark_entry__ as entry
from tablecheck.plans.queries import ORACLES, QUERIES
from tests import check_oracles

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "summary", "missing_patterns", "type_suggestions", "patterns_contacts", "functional_deps_geo", "score_presets", "issues_with_near_dups", "near_dup_customer", "date_shapes", "load_guards",
    "clean_tokens", "fill_mode", "histogram", "group_median_customer", "resample_week", "correlation", "ks", "psi",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLES)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["preset", "score", "level"] and df.count() == 5


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, name):
    assert check_oracles.compare(spark, check_oracles.duck(SF), SF, name) is None


def test_scans_read_only_what_they_need(spark, capsys):
    entry.queries()["group_mean"](spark, SF).explain()
    plan = capsys.readouterr().out
    schema = next(line for line in plan.splitlines() if "ReadSchema" in line)
    assert "o_orderdate" not in schema and "o_totalprice" in schema
    assert "IsNotNull(o_orderpriority)" in schema


def test_change_log_shuffles_nothing(spark, capsys):
    from tablecheck.operators.clean import CleanPlan, CleanOptions, change_log
    from tablecheck.plans.views import table

    plan = CleanPlan(CleanOptions(), fills={"segment": "x"})
    change_log(table(spark, SF, "dirty_customer"), plan, ["id"]).explain()
    assert "Exchange" not in capsys.readouterr().out
