"""Exact and near duplicates, and components, beside brute force."""

import random
import time
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablecheck.llm import components as linked
from tablecheck.llm import minhash
from tablecheck.llm.components import components
from tablecheck.llm.exact_dedup import exact_duplicates
from tablecheck.llm.minhash import near_duplicates
from tablecheck.sources.storage import materialise
from tests.llm.helpers import docs, empty, frame, given


def brute_exact(rows):
    groups = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        groups["".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")].append((-len(t or ""), i is None, i or 0, n))
    return {n: (rows[min(g)[3]][0], len(g)) for g in groups.values() for *_, n in g}


def test_exact_beside_brute_force(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "a  b "), (4, None), (5, ""), (6, " \n"), (7, "x" * 5000), (8, "x" * 5000), (9, "x" * 5001), (9, "x" * 5000), (None, "ab"), (10, "AB"),
            (11, "é"), (12, "\xa0"), (13, "y" * 70 + "1"), (14, "y" * 70 + "2"), (15, "q"), (15, "q")]
    want = brute_exact(rows)
    got = exact_duplicates(docs(spark, rows), payload=["doc_id", "text", "kept", "group"], digest=True).toPandas()
    assert len(got) == len(rows)
    key = lambda i, t: (-1 if pd.isna(i) else int(i), t or "")
    expected = sorted((*key(*r), -1 if want[n][0] is None else want[n][0], want[n][1]) for n, r in enumerate(rows))
    assert sorted((*key(i, t), int(k), int(g)) for i, t, k, g in zip(got.doc_id, got.text, got.keep_id.fillna(-1), got.group_size)) == expected
    assert got.kept.sum() == len({tuple(sorted(x)) for x in [("".join((t or "").split()),) for _, t in rows if t != "\xa0"]}) + 1
    assert got.text_sha256.str.len().eq(64).all()


def test_exact_empty(spark):
    assert exact_duplicates(empty(spark)).count() == 0


def test_only_survivors_are_hashed(spark):
    got = exact_duplicates(docs(spark, [(1, "one"), (2, "three"), (3, "three")])).toPandas().set_index("doc_id")
    assert got.text_sha256.isna().to_dict() == {1: True, 2: False, 3: False}


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def brute_near(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(set)
    for n, s in enumerate(sets):
        for x in s:
            where[x].add(n)
    for a, b in {(a, b) for g in where.values() for a in g for b in g if a < b}:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    smallest = defaultdict(lambda: None)
    for n, (i, _) in enumerate(rows):
        if i is not None and (smallest[find(n)] is None or i < smallest[find(n)]):
            smallest[find(n)] = i
    return [(i, len(sets[n]), smallest[find(n)]) for n, (i, _) in enumerate(rows)]


def as_rows(got):
    return sorted((-1 if pd.isna(i) else int(i), int(n), -1 if pd.isna(c) else int(c)) for i, n, c in zip(got.doc_id, got.n_shingles, got.component_id))


def expected(rows):
    return sorted((-1 if i is None else i, n, -1 if c is None else c) for i, n, c in brute_near(rows))


def test_near_awkward_rows(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base + " more"), (3, base.upper()), (4, None), (5, ""), (6, " \t"), (7, "few words"), (8, "Few  Words"), (9, "few words x"), (None, base + " less"), (10, base), (10, base),
            (11, "Ab\xa0cd"), (12, "ab\xa0CD"), (13, "a b c d e"), (14, "a b c d e")]
    got = near_duplicates(docs(spark, rows)).toPandas()
    assert as_rows(got) == expected(rows)
    assert got[got.doc_id == 4].kept.all() and not got[got.doc_id == 2].kept.any()


def test_near_chains_and_hubs(spark):
    """A hub whose neighbours are like it and not like each other, a chain, and a crowd of near copies."""
    rng = random.Random(5)
    word = lambda: f"x{rng.randrange(10**9)}"
    rows = []
    for _ in range(6):
        hub = [word() for _ in range(80)]
        rows.append(" ".join(hub))
        for k in range(5):
            some = list(hub)
            some[3 + 14 * k : 5 + 14 * k] = [word(), word()]
            rows.append(" ".join(some))
    link = [word() for _ in range(120)]
    for k in range(12):
        link = link[6:] + [word() for _ in range(6)]
        rows.append(" ".join(link))
    crowd = [word() for _ in range(60)]
    rows += [" ".join([*crowd, word()]) for _ in range(80)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert as_rows(near_duplicates(docs(spark, rows)).toPandas()) == expected(rows)


@pytest.mark.parametrize("pairs", [0, 20_000_000])
def test_near_loose_family_takes_few_rounds(spark, monkeypatch, pairs):
    """Variants about as like their original as the limit asks, most of them less like each other."""
    rng = random.Random(8)
    base = [f"y{rng.randrange(10**9)}" for _ in range(120)]
    rows = []
    for k in range(240):
        some = list(base)
        for at in rng.sample(range(120), 2 + k % 4):
            some[at] = f"y{rng.randrange(10**9)}"
        rows.append((k, " ".join(some)))
    written = []
    for module in (minhash, linked):
        keep = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, label, keep=keep: written.append(label) or keep(df, label))
    monkeypatch.setattr(minhash, "PAIRS", pairs, raising=False)
    got = near_duplicates(docs(spark, rows)).toPandas()
    assert as_rows(got) == expected(rows)
    assert pairs == 0 or (written.count("compared") <= 3 and len(written) <= 40)


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = files()
    table = materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "cleaned")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert table.count() == 7


def test_near_given_documents(spark):
    table = given("documents")
    rows = list(zip(table.doc_id.tolist(), table.text.tolist()))
    assert as_rows(near_duplicates(docs(spark, rows)).toPandas()) == expected(rows)


def test_near_empty(spark):
    got = near_duplicates(empty(spark))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and got.count() == 0


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(20)], [(0, i) for i in range(1, 30)] + [(40, 41), (41, 42)], [(5, 5)]])
def test_components(spark, links):
    got = frame(components(spark.createDataFrame(links, "a bigint, b bigint")), "node")
    root = {}
    for a, b in links:
        for x in (a, b):
            root.setdefault(x, x)
    for _ in links:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert dict(zip(got.node, got.root)) == {n: r for n, r in root.items() if n != r}
