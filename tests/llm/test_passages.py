"""Contamination, fill-in-the-middle and collocations beside brute force on awkward rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablecheck.llm import collocations as col
from tablecheck.llm import decontaminate as dec
from tablecheck.llm import fill_middle as fim
from tests.llm.helpers import docs, empty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM = "item_id string, text string, spans string, doc_id string"


def items(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], ITEM)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_hits(text, rows, size=10):
    own, hit, found = words(text), set(), set()
    for name, item in rows:
        w = words(item)
        k = min(size, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            for b in range(len(own) - k + 1):
                if own[b : b + k] == w[a : a + k]:
                    hit.update(range(b, b + k))
                    found.update([name] if name is not None else [])
    return len(own), len(hit), sorted(found)


def passage(rng, n):
    return " ".join(rng.choice(["the", "th", "of", "ofthe", "é", "x1", "ab", "Zebra", "ñandú"]) for _ in range(n))


ITEMS = [
    ("b", "One two three four five six seven eight nine ten eleven twelve"),
    ("a", "one-two THREE four five six seven eight nine ten"),  # shares a window with b
    ("9", "a"),
    ("10", "Ünïcode wörds"),
    ("c", "the the the the the the the the the the the the"),
    (None, "quick brown fox jumps"),
    ("d", None),
    ("e", " ... "),
    ("c", "again item c under the same name"),
]
TEXTS = [
    (1, "start one two three, four five six seven eight nine ten eleven stop"),
    (1, "one two three four five six seven eight nine"),
    (2, "the " * 40),
    (3, "A"),
    (None, "xa a. ax ünïcode WÖRDS and Ünïcode wörds"),
    (None, None),
    (4, ""),
    (5, " \n. "),
    (6, "the quick brown fox jumps; quick brown fox jump"),
    (6, "the quick brown fox jumps; quick brown fox jump"),
    (7, "again item c\nunder the same name " * 3),
    (8, "filler word " * 4000 + ITEMS[0][1] + " end" * 3000),
]


def contaminated(spark, texts, rows, **how):
    got = dec.contamination(docs(spark, texts), items(spark, rows), **how).collect()
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["item_ids"]) for r in got), got


@pytest.mark.parametrize("pass_bytes", [dec.PASS_BYTES, 60])
def test_contamination_equals_brute_force(spark, pass_bytes):
    rng = random.Random(5)
    rows = ITEMS + [(f"r{i}", passage(rng, rng.randint(1, 40))) for i in range(30)]
    texts = TEXTS + [(100 + i, passage(rng, 30) + " " + (rng.choice(rows)[1] or "") if i % 3 else passage(rng, 60)) for i in range(40)]
    got, raw = contaminated(spark, texts, rows, pass_bytes=pass_bytes)
    want = sorted((str(i), *brute_hits(t, rows)) for i, t in texts)
    assert got == want
    for r in raw:
        assert sum(s["words"] for s in r["spans"]) == r["n_hit"]
        assert all(a["first"] + a["words"] < b["first"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_contamination_in_long_items_cut_into_pieces(spark):
    long = " ".join(f"w{i}" for i in range(2 * dec.PIECE_WINDOWS + 500))
    parts = long.split()
    cut = dec.PIECE_WINDOWS
    texts = [(1, " ".join(parts[cut - 5 : cut + 5])), (2, " ".join(parts[-10:])), (3, " ".join(parts[cut - 5 : cut + 4]))]
    assert contaminated(spark, texts, [("long", long)])[0] == [("1", 10, 10, ["long"]), ("2", 10, 10, ["long"]), ("3", 9, 0, [])]


def test_contamination_of_empty_tables(spark):
    assert contaminated(spark, TEXTS[:2], [])[0] == [("1", 9, 0, []), ("1", 13, 0, [])]
    assert dec.contamination(empty(spark), items(spark, ITEMS)).count() == 0


def test_word_ids_keep_their_type(spark):
    rows = spark.createDataFrame([("a1", "the quick brown fox jumps")], "doc_id string, text string")
    assert [tuple(r)[:3] for r in dec.contamination(rows, items(spark, ITEMS)).collect()] == [("a1", 5, 4)]


@pytest.mark.parametrize("seed", range(4))
def test_wu_manber_finds_what_a_plain_search_finds(seed):
    rng = random.Random(seed)
    alphabet = "ab " if seed % 2 else "abcdefgh "
    text = "".join(rng.choice(alphabet) for _ in range(6000))
    least = [1, 3, 12, 40][seed]
    spots = [(rng.randrange(5800), rng.randint(least, least + 30)) for _ in range(60)]
    patterns = sorted({text[a : a + n] for a, n in spots if len(text[a : a + n]) >= least} | {"x" * (least + 5)})
    length = np.array([len(p) for p in patterns])
    search = dec.WuManber(np.frombuffer("".join(patterns).encode(), np.uint8), np.cumsum(length) - length, length)
    at, which = search.search(np.frombuffer(text.encode(), np.uint8))
    want = sorted((m.start(), k) for k, p in enumerate(patterns) for m in re.finditer(f"(?={re.escape(p)})", text))
    assert sorted(zip(at.tolist(), which.tolist())) == want


def test_shift_table_skips(spark):
    text = "".join(random.Random(1).choice("abcdefghijklmnop") for _ in range(20000))
    pattern = "q" * 40
    search = dec.WuManber(np.frombuffer(pattern.encode(), np.uint8), np.zeros(1, np.int64), np.array([40]))
    looks = []
    slot = search._slot
    search._slot = lambda body, at: looks.append(len(at)) or slot(body, at)
    assert not len(search.search(np.frombuffer(text.encode(), np.uint8))[0])
    assert sum(looks) <= len(text) / 30 + 40


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_brute_force(spark):
    rng = random.Random(3)
    pieces = ["a", "é", "日本語", "𝒳y", " ", "\n", "\t\t", " ", "\x1c", "word", "<P", "S>", "\x85", "."]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(None, "null id here"), (None, None), (7, "same id, other text"), (7, "same id, other text"), (900, "<M> inside"), (901, " "), (902, "\n \n"), (903, ""), (904, "x")]
    rows += [(1000 + i, "é日 " * 20000 + "end" * (i % 2)) for i in range(8)] + [(1100 + i, "ü" * 5000) for i in range(8)]
    made = fim.fill_in_middle(docs(spark, rows))
    got = made.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(repr(tuple(r)[:6]) for r in got) == sorted(repr((i, *brute_fim(i, t))) for i, t in rows)
    texts = Counter(t or "" for _, t in rows)
    assert Counter(r["again"] for r in got) == texts
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_fill_in_middle_of_text_ids_and_empty_tables(spark):
    assert fim.fill_in_middle(empty(spark)).count() == 0
    rows = spark.createDataFrame([(f"id{i}", "some words here") for i in range(20)], "doc_id string, text string")
    got = fim.fill_in_middle(rows).collect()
    assert sorted(tuple(r)[:6] for r in got if r["form"] != "plain") == sorted((f"id{i}", *brute_fim(f"id{i}", "some words here")) for i in range(20) if brute_fim(f"id{i}", "some words here")[1] != "plain")


@pytest.mark.parametrize("blocks", [1, 2, 5, 8, 37])
def test_fenwick_tree(blocks):
    rng = np.random.default_rng(blocks)
    units, points = rng.integers(0, 4, blocks), rng.integers(0, 9, blocks)
    tree = fim.Fenwick(units, points)
    before = np.concatenate([[0], np.cumsum(units)])
    assert (tree.before(np.arange(blocks + 1)) == np.stack([before, np.concatenate([[0], np.cumsum(points)])])).all()
    ranks = np.arange(1, units.sum() + 1)
    block, passed, chars = tree.descend(ranks)
    assert (block == np.searchsorted(before[1:], ranks, side="left")).all()
    assert (passed == before[block]).all() and (chars == np.concatenate([[0], np.cumsum(points)])[block]).all()


def brute_collocations(rows, least, percent, top):
    counts, total = {}, Counter()
    for text, lang in rows:
        c = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in (1, 2, 3):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        candidates = {g: n for g, n in c.items() if len(g) > 1 and n >= least}
        ranked = []
        for g, a in candidates.items():
            if any(len(x) > len(g) and 100 * n >= percent * a and g in (x[:2], x[1:]) for x, n in candidates.items()):
                continue
            score, k = min((1000000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            ranked.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        for r, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, r, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def phrase_rows(rng, n):
    pool = ["New", "york", "city", "the", "of", "é", "is", "a", "b"]
    for i in range(n):
        text = "".join(rng.choice(pool) + rng.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]) for _ in range(rng.randint(0, 50)))
        yield i, text + "new york city", rng.choice(["en", "en", "fr", None])


@pytest.mark.parametrize("held", [1 << 21, 64])
def test_collocations_equal_brute_force(spark, monkeypatch, held):
    rows = [*phrase_rows(random.Random(8), 150), (None, None, "en"), (1, "", "de"), (1, "only once", "de"), (2, ". , ;", None), (3, "ab " * 30000, "xx"), *[(9, "repeated row here", "de")] * 12]
    monkeypatch.setattr(col, "HELD_WORDS", held)
    got = col.collocations(docs(spark, rows), least=5, top=40).collect()
    want = brute_collocations([(t, x) for _, t, x in rows], 5, 50, 40)
    assert sorted(tuple(r) for r in got) == want
    assert {r["lang"] for r in got} >= {"en", "fr", "und", "de", "xx"}
    # packets of tasks with the limit in force, merged as partitions merge them
    for level in (1, 2, 3):
        packets = [p for k in range(0, len(rows), 40) for p in counted([(t, x) for _, t, x in rows[k : k + 40]], 3, level)]
        assert sum(p.num_rows for p in packets) > 3
        mine = [[b for b in packets if b.column("part")[0].as_py() == p] for p in range(3)]
        entries = [e for some in mine for e in col._merge(level, 1)(pa.Table.from_batches(some)).to_pylist() if e["level"] == level]
        assert len({(e["a"], e["b"], e["c"]) for e in entries}) == len(entries)
        assert sum(e["n"] for e in entries) == sum(grams(t, level) for _, t, _x in rows)


def grams(text, k):
    pieces = [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]
    return sum(max(0, len(w) - k + 1) for w in pieces)


def counted(rows, parts, level):
    batch = pa.record_batch([pa.array([t for t, _ in rows], pa.string()), pa.array([x or "und" for _, x in rows], pa.string())], names=["text", "lang"])
    everything = col.Likely(15, {0: b"\xff" * 4096})
    return list(col._count(parts, level, everything)(iter([batch])))


def test_filter_lets_all_frequent_keys_through(spark):
    rng = np.random.default_rng(4)
    keys = rng.integers(-(2**63), 2**63 - 1, 3000)
    passes = col.likely(spark.createDataFrame([(int(k),) for k in keys], "key bigint"), len(keys))
    assert passes(keys.view(np.uint64)).all()
    assert passes(rng.integers(0, 2**64, 20000, dtype=np.uint64)).mean() < 0.08


def test_collocations_of_empty_tables(spark):
    assert col.collocations(empty(spark)).count() == 0
    assert col.collocations(docs(spark, [(1, None), (2, "")])).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 999_999_999_999_937, 999_999_999_999_989, 999_999_999_999_947
    row = spark.createDataFrame([(a, left, right)], "f bigint, l bigint, r bigint").select(col._score("f", "l", "r")).first()
    assert row[0] == 1_000_000 * a * a // (left * right)
