"""Nearest neighbours beside brute force; the registry; the pipeline stage by stage."""

import math

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tablecheck.llm.nearest import CentroidGraph, balanced_centroids, nearest_neighbours
from tablecheck.llm.queries import ORACLES, QUERIES
from tests import check_oracles
from tests.llm.helpers import docs, empty, given
from tests.llm.test_dedup import brute_exact, brute_near

SF = "/root/testdata/sf0.001"
VEC = "vec_id bigint, embedding array<float>, label int, score string, block string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "s", "b") for i, v in rows], VEC)


def brute(rows, queries, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if q in queries:
            best = {}
            for i, x in ok:
                if i != q:
                    best[i] = min(best.get(i, math.inf), float(np.sqrt(((x - v) ** 2).sum())))
            out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def test_recall_on_given_vectors(spark):
    table = given("embeddings")
    rows = list(zip(table.vec_id.tolist(), [v.tolist() for v in table.embedding]))
    t = vectors(spark, rows)
    got = nearest_neighbours(t, t.filter("vec_id % 10 = 0"), list_size=16, probes=16).toPandas()
    want = brute(rows, set(range(0, 10**6, 10)), 10)
    recall = [len({i for _, i in want[q]} & set(g.vec_id)) / 10 for q, g in got.groupby("query_id")]
    assert len(recall) == len(want) and np.mean(recall) >= 0.9
    dist = {(q, i): d for q, best in want.items() for d, i in best}
    assert all(s == pytest.approx(dist[q, i], rel=1e-12) for q, i, s in zip(got.query_id, got.vec_id, got.score) if (q, i) in dist)
    for _, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and list(zip(g.score, g.vec_id)) == sorted(zip(g.score, g.vec_id))


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]),
            (10, [0.0, -1.0]), (11, [1.0, 0.0]), (11, [1.0, 0.0])]
    t = vectors(spark, rows)
    got = nearest_neighbours(t, t).toPandas()
    want = brute([r for r in rows if r[0] != 9], {0, 1, 2, 10, 11}, 10)
    assert {q: list(zip(g.sort_values("rank").score, g.sort_values("rank").vec_id)) for q, g in got.drop_duplicates().groupby("query_id")} == {q: w for q, w in want.items()}


@pytest.mark.parametrize("list_size", [16, 1000])
def test_repeated_ids_take_one_place(spark, list_size):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, (x[0] + 0.001 * j).tolist()) for j in range(12)] + [(0, (x[0] + 0.0001 * j).tolist()) for j in range(1, 12)]
    rows += [(i, v.tolist()) for i, v in enumerate(x[100:110], 100)] * 12
    t = vectors(spark, rows)
    q = vectors(spark, [(0, x[0].tolist()), (100, x[100].tolist()), (999, x[3].tolist())])
    got = nearest_neighbours(t, q, list_size=list_size, probes=300, probe_ratio=100.0).toPandas()
    single = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    for query, v in ((0, x[0]), (100, x[100]), (999, x[3])):
        best = {}
        for i, y in single:
            if i != query:
                best[i] = min(best.get(i, math.inf), float(np.sqrt(((y - v.astype(np.float32).astype(float)) ** 2).sum())))
        g = got[got.query_id == query].sort_values("rank")
        assert list(zip(g.score, g.vec_id)) == sorted((d, i) for i, d in best.items())[:10]


def test_one_id_in_all_rows(spark):
    t = vectors(spark, [(5, [1.0, float(i % 3)]) for i in range(500)])
    got = nearest_neighbours(t, vectors(spark, [(5, [1.0, 0.0]), (6, [1.0, 0.0])]), train=20).toPandas()
    assert got[["query_id", "rank", "vec_id", "score"]].values.tolist() == [[6, 1, 5, 0]]


def test_one_or_no_vector(spark):
    one = vectors(spark, [(1, [1.0])])
    assert nearest_neighbours(one, one).count() == 0
    none = vectors(spark, [])
    assert nearest_neighbours(none, none).count() == 0


def test_graph_finds_near_centroids():
    rng = np.random.default_rng(2)
    centroids = balanced_centroids(rng.normal(size=(4000, 16)).astype(np.float32), 256, rng)
    assert len(centroids) == 256
    graph = CentroidGraph.build(centroids)
    x = rng.normal(size=(200, 16)).astype(np.float32)
    ids, dist = graph.search(x, 32)
    true = np.argsort(((x[:, None] - centroids[None]) ** 2).sum(axis=2), axis=1)
    assert (ids[:, 0] == true[:, 0]).mean() > 0.95 and (np.diff(dist, axis=1) >= -1e-4).all()


def test_registry():
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) == {n for n in entry.oracle_sql() if n in QUERIES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), check_oracles.duck(SF).execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    # whole numbers with nulls come as floats from one side: both are given the narrowest type that holds them
    key = lambda f: sorted(map(str, f[columns].convert_dtypes().astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(want)


def test_stages(spark):
    table = given("documents")
    rows = list(zip(table.doc_id.tolist(), table.text.tolist(), table.lang.tolist(), table.source.tolist()))
    rows += [(10_000, None), (10_001, " 12 "), (10_002, rows[0][1] + " \n", "en", None), (10_003, rows[1][1], None, "s")]
    kept = docs(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "exact_duplicates", "near_duplicates", "mixture", "tokens"]
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())

    after = stages["language"](spark, kept, SF)
    assert after.columns == kept.columns and set(ids(kept)) - set(ids(after)) >= {10_000, 10_001} and len(ids(after)) >= len(rows) - 4
    left = [(r["doc_id"], r["text"]) for r in after.collect()]
    after = stages["exact_duplicates"](spark, after, SF)
    assert ids(after) == sorted({k for k, _ in brute_exact(left).values()})
    left = [(r["doc_id"], r["text"]) for r in after.collect()]
    after = stages["near_duplicates"](spark, after, SF)
    assert ids(after) == sorted(i for i, _, c in brute_near(left) if i == c)
    mixed = stages["mixture"](spark, after, SF)
    assert mixed.columns == kept.columns and set(ids(mixed)) <= set(ids(after)) and max(pd.Series(ids(mixed)).value_counts()) <= 3
    tokens = stages["tokens"](spark, mixed, SF).toPandas()
    assert sorted(tokens.doc_id) == ids(mixed) and tokens.parity.all() and tokens.round_trip.all()


def test_empty_stages(spark):
    df = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
    assert df.count() == 0


def test_language_stage_without_labels(spark):
    rows = [(1, "der die das"), (2, "12 %"), (3, None), (None, "the of")]
    assert sorted(r["text"] for r in corpus_pipeline.keep_languages(spark, docs(spark, rows), SF).collect()) == ["der die das", "the of"]


def test_near_copies_with_repeated_and_null_ids(spark):
    text = lambda n: " ".join(f"w{n}x{j}" for j in range(60))
    near = lambda n, j: text(n) + f" end{j}"
    rows = [(1, text(1)), (5, near(1, 1)), (5, text(2)), (6, text(3)), (6, near(3, 1)), (None, text(4)), (None, near(4, 1)), (None, near(4, 2)), (None, text(5)), (None, near(1, 2)),
            (7, text(6)), (7, text(6)), (7, near(6, 1)), (None, text(7)), (None, text(7)), (0, text(8)), (None, near(8, 1)), (9, None), (9, None), (None, " ")]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs(spark, rows), SF).collect()]
    classes = {}
    for i, t in rows:
        classes.setdefault((t or "").split("x")[0].strip() or len(classes) + 1000, []).append((i, t))
    classes = {k: c for k, c in classes.items() if isinstance(k, str)}
    for name, members in classes.items():
        stay = [g for g in got if g in members]
        assert len(stay) == 1 and stay[0][0] == min((i for i, _ in members if i is not None), default=None), name
    assert sorted(map(str, (g for g in got if not (g[1] or "").strip()))) == sorted(map(str, [(9, None), (9, None), (None, " ")]))
    assert len(got) == len(classes) + 3


def test_stages_hand_on_columns_of_any_name(spark):
    names = ["spans", "positions", "score", "lang_pred", "kept", "keep_id", "group_size", "text_sha256", "size", "source_size", "target", "copies", "taken", "epoch", "position", "near_key", "a.b"]
    rows = [(i, f"der die das und {i} " + " ".join(f"w{i}x{j}" for j in range(9)), "de", "s", *[f"{n}{i}" for n in names]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    want = {tuple(r) for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        got = [tuple(r) for r in out.collect()]
        assert out.columns == df.columns and set(got) <= want and len(got) >= 10, name
