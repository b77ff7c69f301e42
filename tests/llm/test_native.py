"""URL rules, mixing and sharding: fixed cases, limits and distributions."""

import math
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablecheck.llm.common import running_total, spread_key
from tablecheck.llm.curriculum import SCHEDULES, Schedule, curriculum, source_targets, training_order
from tablecheck.llm.queries import RULES
from tablecheck.llm.shuffle_shards import communication_matrix, hypergeometric, uniform_shards
from tablecheck.llm.url_filter import build_cascade, judge_urls, rule_table
from tests.llm.helpers import docs, empty

URLS = [
    (1, "http://a.example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
    (2, "https://EXAMPLE.net/de/?q", "example.net", "/de/", "net/", "block"),
    (3, "http://notexample.com/de/x", "notexample.com", "/de/x", None, "allow"),
    (4, "http://example.com/de/x#y", "example.com", "/de/x", "example.com/de/", "block"),
    (5, "http://example.com/DE/x", "example.com", "/DE/x", None, "allow"),
    (6, "http://net", "net", "", None, "allow"),
    (7, "http://net/", "net", "/", "net/", "block"),
    (8, "x://org/fr/?a://b", "org", "/fr/", "org/fr/", "allow"),
    (9, None, "", "", None, "allow"),
    (10, "no scheme.net/", "", "", None, "allow"),
    (11, "", "", "", None, "allow"),
    (12, "http:///net/", "", "/net/", None, "allow"),
    (13, "http://a.net?x/en/", "a.net", "", None, "allow"),
    (14, "http://É.net/" + "p" * 3000, "É.net", "/" + "p" * 3000, "net/", "block"),
    (None, "http://a.net/\nb", "a.net", "/\nb", "net/", "block"),
]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", "r", "k") for i, u in urls], "page_id bigint, url string, html string, rule string, key string")


def test_rules(spark):
    got = judge_urls(pages(spark, [(i, u) for i, u, *_ in URLS] + [(1, URLS[0][1])]), rule_table(spark, RULES))
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, [(i, *rest) for i, _, *rest in URLS + [URLS[0]]]))


def test_no_pages_no_rules(spark):
    assert judge_urls(pages(spark, []), rule_table(spark, RULES)).count() == 0
    got = judge_urls(pages(spark, [(1, "http://a.net/")]), rule_table(spark, []))
    assert [tuple(r) for r in got.collect()] == [(1, "a.net", "/", None, "allow")]


@pytest.mark.parametrize("listed", [0, 1, 40, 1990, 2000])
def test_cascade_is_exact(spark, listed):
    universe = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") < listed).alias("listed"))
    cascade = build_cascade(universe)
    assert universe.filter(cascade.contains(F.col("key")) != F.col("listed")).count() == 0
    assert listed in (0, 2000) or len(cascade.levels) >= 1


def test_running_total(spark):
    rows = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("g"), "id", (F.col("id") % 7).alias("v"), spread_key("s", F.col("id")).alias("k"))
    got = running_total(rows, ["g"], "k", ["id"], F.col("v"), "before", 5000).toPandas().sort_values(["g", "k", "id"])
    want = got.groupby("g").v.cumsum() - got.v
    assert (got.before == want).all()


def fill(sizes, weights, most=3):
    """Reshare what lies above the limit, round after round."""
    target, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        level = rest / sum(weights[i] for i in open_)
        above = {i for i in open_ if level * weights[i] > most * sizes[i]}
        if not above:
            for i in open_:
                target[i] = level * weights[i]
            break
        for i in above:
            target[i] = most * sizes[i]
            rest -= target[i]
        open_ -= above
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 5, 7, 0, 300], [0, 0], [5], [10, 0, 0, 1], [1] * 9 + [1000]])
def test_targets(spark, sizes):
    frame = spark.createDataFrame([(f"s{i:02}", s) for i, s in enumerate(sizes)], "src string, source_size bigint")
    got = source_targets(frame, ["src"]).orderBy("src").toPandas()
    want = fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert got.target.tolist() == pytest.approx(want)


def test_mix(spark):
    rows = [(i, "w " * (i % 40), "en", f"s{i % 5}" if i % 11 else None) for i in range(600)] + [(7, None, "en", "s0"), (8, "w " * 3000, "en", "tiny"), (9, "a b", "en", "s1"), (9, "a b", "en", "s1"), (None, "q", None, "s1")]
    got = curriculum(docs(spark, rows), payload=["doc_id", "source", "key"]).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all() and (got.copies <= 3).all()
    by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.most / 2 + 1e-9).all()
    assert all(0 <= p <= 1 for ps in got.positions for p in ps) and all(list(p) == sorted(p) for p in got.positions)
    again = curriculum(docs(spark, rows[::-1]).repartition(7), payload=["doc_id", "source", "key"]).toPandas()
    key = lambda f: sorted(zip(f.doc_id.fillna(-1), f.taken, f["size"]))
    assert key(got) == key(again)


def test_mix_follows_the_schedule(spark):
    rows = [(i, "a b c d e", "en", f"s{i % 3}") for i in range(6000)]
    order = training_order(curriculum(docs(spark, rows), payload=["doc_id", "source"]), ["doc_id"]).toPandas()
    assert order.position.is_monotonic_increasing
    first, last = order[order.position < 0.1], order[order.position > 0.9]
    shares = lambda f: f.source.value_counts(normalize=True)
    # weights 5, 2, 1 times the factors of the schedules around 0.05 and 0.95
    want = lambda a, b, c: pd.Series({"s0": 5 * a, "s1": 2 * b, "s2": 1 * c}) / (5 * a + 2 * b + c)
    target = order.groupby("source").size() / len(order)
    assert shares(first)["s0"] > target["s0"] * 1.05 and shares(last)["s2"] > target["s2"] * 1.3
    assert shares(first)["s0"] - want(1.45, 0.6, 0.55)["s0"] < 0.1


@pytest.mark.parametrize("schedule", [*SCHEDULES, Schedule(((0.0, 1.0), (0.25, 1.0), (1.0, 3.0)))])
def test_time_inverts_the_integral(spark, schedule):
    at = spark.range(101).select((F.col("id") / 100).alias("u")).withColumn("t", schedule.time_at(F.col("u"))).toPandas()

    def integral(t):
        return sum(f0 * x + slope * x * x / 2 for t0, length, f0, slope, _ in schedule.pieces() for x in [min(max(t - t0, 0), length)])

    assert [integral(t) / schedule.area() for t in at.t] == pytest.approx(at.u.tolist(), abs=1e-12)


def test_mix_empty(spark):
    assert curriculum(empty(spark)).count() == 0 and training_order(curriculum(empty(spark)), ["doc_id"]).count() == 0


def exact(good, total, drawn):
    return [math.comb(good, k) * math.comb(total - good, drawn - k) / math.comb(total, drawn) if drawn - k <= total - good else 0.0 for k in range(min(good, drawn) + 1)]


@pytest.mark.parametrize("good,total,drawn", [(5, 20, 7), (0, 9, 3), (9, 9, 4), (1, 1000, 3), (30, 60, 45), (250, 10_000, 1024), (3, 5, 5)])
def test_hypergeometric(spark, good, total, drawn):
    n = 4000
    u = spark.range(n).select(((F.col("id") + 0.5) / n).alias("u"))
    got = Counter(r["x"] for r in u.select(hypergeometric(F.lit(good), F.lit(total), F.lit(drawn), F.col("u")).alias("x")).collect())
    for k, p in enumerate(exact(good, total, drawn)):
        assert abs(got[k] / n - p) <= 1.5 / n


def test_matrix_margins(spark):
    counts = [3, 0, 50, 20, 1, 7, 1000, 40] + [5] * 30
    sizes = [sum(counts) // 7 + (s < sum(counts) % 7) for s in range(7)]
    parts = spark.createDataFrame([(i, c) for i, c in enumerate(counts) if c], "part bigint, n bigint")
    got = communication_matrix(spark, parts, len(counts), sizes, "seed").toPandas().set_index("part").quota
    for p, n in enumerate(counts):
        assert sum(got[p]) == n
    assert [sum(q[s] for q in got) for s in range(7)] == sizes


def test_shards(spark):
    rows = docs(spark, [(i, "t") for i in range(3001)] + [(None, None), (5, "t"), (5, "t")])
    got = uniform_shards(rows, 7, payload=["doc_id", "text", "key"]).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == 3004 and sizes.max() - sizes.min() <= 1 and len(sizes) == 7
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    again = uniform_shards(rows.repartition(9), 7, payload=["doc_id"]).toPandas()
    assert dict(zip(got.doc_id.fillna(-1), got.shard)) | {5: 0} == dict(zip(again.doc_id.fillna(-1), again.shard)) | {5: 0}
    # neighbours in id are spread like any others, and slots do not follow ids
    near = got.dropna().sort_values("doc_id")
    assert 0.10 < (near.shard.values[1:] == near.shard.values[:-1]).mean() < 0.19
    assert abs(near.doc_id.astype(float).corr(near.slot.astype(float))) < 0.06


def test_shards_few_rows(spark):
    assert uniform_shards(empty(spark), 5).count() == 0
    got = uniform_shards(docs(spark, [(1, "a"), (2, "b")]), 5).toPandas()
    assert len(got) == 2 and got.slot.tolist() == [0, 0] and set(got.shard) == {0, 1}
