import random

import pytest

from tablecheck.functions.columns import as_key
from tablecheck.operators import dependencies, duplicates
from tablecheck.operators.dependencies import _confirmed, functional_dependencies
from tablecheck.operators.duplicates import drop_duplicate_rows, duplicate_rows
from tablecheck.operators.profile import Profile


def brute(rows, names, max_pairs=None):
    n = len(rows)
    out, checked = [], 0
    for i, a in enumerate(names):
        values = {r[i] for r in rows if r[i] is not None}
        if not 2 <= len(values) <= max(n * 0.5, 2):
            continue
        for j, b in enumerate(names):
            if i == j or (max_pairs is not None and checked >= max_pairs):
                continue
            checked += 1
            groups = {v: {r[j] for r in rows if r[i] == v and r[j] is not None} for v in values}
            if max(len(g) for g in groups.values()) == 1:
                out.append((a, b, len(values)))
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("max_pairs", [None, 5])
def test_equals_brute_force(spark, monkeypatch, seed, max_pairs):
    if seed % 2:
        monkeypatch.setattr(dependencies, "SCREEN_ROWS", 0)
        monkeypatch.setattr(dependencies, "SCREEN_SHARE", 2)
    rnd = random.Random(seed)
    rows = []
    for _ in range(40):
        a = rnd.choice([None, 1, 2, 3, 4, 5, 6])
        rows.append((a, None if a is None else a % 2, rnd.choice(["x", "y", None]), "k", None, float(rnd.randrange(30))))
    names = ["a", "parity", "noise", "const", "void", "id"]
    df = spark.createDataFrame(rows, "a int, parity int, noise string, const string, void string, id double")
    p = Profile(df)
    assert functional_dependencies(p.df, p.rows, p.distinct, max_pairs) == brute(rows, names, max_pairs)


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_duplicates_both_ways(spark, monkeypatch, limit):
    monkeypatch.setattr(duplicates, "BROADCAST_HASHES", limit)
    rnd = random.Random(1)
    rows = [(rnd.randrange(20), rnd.choice([None, "a", "b"])) for _ in range(300)] + [(99, "hot")] * 100
    df = spark.createDataFrame(rows, "a int, b string")
    assert duplicate_rows(df) == len(rows) - len(set(rows))
    kept = [tuple(r) for r in drop_duplicate_rows(df).collect()]
    assert len(kept) == len(set(rows)) and set(kept) == set(rows)


def test_no_duplicates_leaves_the_table_alone(spark):
    df = spark.range(50).selectExpr("id", "CAST(id AS STRING) AS s")
    assert drop_duplicate_rows(df) is df


def test_narrow_rows_are_grouped_directly(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (None, 2.0)], "a int, b double")
    assert duplicate_rows(df) == 1 and drop_duplicate_rows(df).count() == 2


def test_maps_can_be_deduplicated(spark):
    df = spark.sql("SELECT * FROM VALUES (map('a', 1)), (map('a', 1)), (map('b', 1)) v(m)")
    assert drop_duplicate_rows(df).count() == 2


def test_sampled_check(spark):
    df = spark.range(1000).selectExpr("id % 5 AS a", "id % 5 * 2 AS b")
    assert ("a", "b", 5) in [tuple(r) for r in Profile(df, fd_sample=0.5).functional_deps().collect()]


def test_survivors_are_confirmed_in_one_scan(spark):
    """Many determinants survive; confirming them takes one job's worth of groups, with the groups of each counted."""
    rows = [(i, i % 4, (i % 4) * 2, f"k{i % 4}", None if i % 4 == 1 else i % 2, i % 3) for i in range(48)]
    df = spark.createDataFrame(rows, "u int, a int, b int, c string, d int, e int")
    keys = {c: as_key(df, c) for c in df.columns}
    pairs = [(x, y) for x in "abcde" for y in "abcde" if x != y]
    got = _confirmed(df, pairs, keys)
    groups = {"a": 4, "b": 4, "c": 4, "d": 2, "e": 3}

    def holds(x, y):
        met = {}
        for r in rows:
            cell = dict(zip("uabcde", r))
            if cell[x] is not None and cell[y] is not None:
                met.setdefault(cell[x], set()).add(cell[y])
        return all(len(v) == 1 for v in met.values())
    assert got == {(x, y): groups[x] for x, y in pairs if holds(x, y)}
