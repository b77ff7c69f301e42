import random

import pytest

from tablecheck.functions.similarity import best_pairs, lcs_length
from tablecheck.operators import neardup


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute(values, top=3, floor=80.0):
    vs = sorted(set(values))
    pairs = []
    for i, a in enumerate(vs):
        for b in vs[i + 1 :]:
            s = 200.0 * brute_lcs(a, b) / (len(a) + len(b)) if a or b else 0.0
            if floor <= s < 100:
                pairs.append((a, b, round(s, 6)))
    return sorted(pairs, key=lambda p: (-p[2], p[0], p[1]))[:top]


def test_lcs():
    rnd = random.Random(0)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcé ") for _ in range(rnd.randrange(0, 90))) for _ in range(2))
        assert lcs_length(a, b) == brute_lcs(a, b)


@pytest.mark.parametrize("t", [0.8, 0.83, 0.9, 0.944, 0.95, 0.98, 0.99])
def test_every_side_keeps_a_gram(t):
    """The bound behind the prefix filter, checked for every pair of lengths it is used for."""
    for low, high, q in neardup._bands(t, 300):
        for longer in range(low, high + 1):
            for shorter in range(1, longer + 1):
                shared = -int(-(t * (longer + shorter) / 2 - 1e-9) // 1)  # least LCS at t
                dropped, added = longer - shared, shorter - shared
                if added < 0 or dropped + added < 1:
                    continue
                if longer <= neardup.VARIANT_LENGTH and dropped <= 1 and added <= 1:
                    continue  # covered by the deletion variants
                for side, gone, new in ((longer, dropped, added), (shorter, added, dropped)):
                    assert q * gone + (q - 1) * new <= neardup._lost(q, side, t) < side - q + 1


def words(rnd, n, lengths, alphabet):
    base = ["".join(rnd.choice(alphabet) for _ in range(rnd.choice(lengths))) for _ in range(n)]
    out = list(base)
    for w in base[: n // 2]:  # edited copies
        t = list(w)
        for _ in range(rnd.randrange(1, 2 + len(t) // 5)):
            k = rnd.randrange(3)
            at = rnd.randrange(len(t) + 1)
            if k == 0:
                t.insert(at, rnd.choice(alphabet))
            elif t and k == 1:
                t.pop(min(at, len(t) - 1))
            elif t:
                t[min(at, len(t) - 1)] = rnd.choice(alphabet)
        out.append("".join(t))
    return out


@pytest.mark.parametrize(
    "seed, n, lengths, alphabet",
    [
        (1, 40, range(1, 8), "ab"),
        (2, 40, range(3, 12), "abc"),
        (3, 30, range(8, 40), "abcdefgh"),
        (4, 20, range(50, 140), "abcdefghij "),
        (5, 30, [18], "0123456789"),
        (6, 25, range(4, 7), "aé"),
    ],
)
@pytest.mark.parametrize("small_text, all_pairs, gram_cost", [(0, 0, 0), (200_000, 0, 0), (0, 0, 1e9), (0, 10_000, 20)])
def test_equals_brute_force(spark, monkeypatch, seed, n, lengths, alphabet, small_text, all_pairs, gram_cost):
    """Grams tier by tier, grams at once, grams given up for blocks, and blocks from the start."""
    monkeypatch.setattr(neardup, "SMALL_TEXT", small_text)
    monkeypatch.setattr(neardup, "ALL_PAIRS", all_pairs)
    monkeypatch.setattr(neardup, "GRAM_COST", gram_cost)
    monkeypatch.setattr(neardup, "BLOCK", 5)
    values = words(random.Random(seed), n, lengths, alphabet)
    df = spark.createDataFrame([(v,) for v in values], "c string")
    got = [tuple(r)[1:] for r in neardup.near_duplicate_values(df, ["c"]).collect()]
    assert got == brute([v.strip() for v in values])


def test_best_pairs_of_blocks():
    rnd = random.Random(4)
    left, right = words(rnd, 30, range(2, 20), "abcde"), words(rnd, 30, range(2, 20), "abcde")
    both = brute(left + right, top=10**6)
    cross = [p for p in both if (p[0] in left and p[1] in right) or (p[1] in left and p[0] in right)]
    got = [(a, b, round(100 * s, 6)) for a, b, s in best_pairs(left, right, 0.8, 5)]
    assert got == cross[:5]
    assert [(a, b, round(100 * s, 6)) for a, b, s in best_pairs(left, None, 0.8, 5)] == brute(left, top=5)


def test_low_pairs_are_found_when_nothing_is_closer(spark):
    # Best pairs at exactly 80, 83.3 and 85.7: each tier of the search has to be reached.
    values = ["abcdefghij", "abcdefghXY", "klmnopqrstuv", "klmnopqrsXYZ"[:11] + "w", "zz", "zzyy"]
    df = spark.createDataFrame([(v,) for v in values], "c string")
    got = [tuple(r)[1:] for r in neardup.near_duplicate_values(df, ["c"]).collect()]
    assert got == brute(values)


def test_several_columns_and_accents(spark):
    df = spark.createDataFrame(
        [("João Silva", "aaaaa", None), ("Joao Silva", "aaaab", None), (" João Silva ", "zzz", None)], "nome string, c string, d string"
    )
    got = {(r.column, r.value_1, r.value_2): r.similarity_pct for r in neardup.near_duplicate_values(df, ["nome", "c", "d"]).collect()}
    assert got == {("nome", "Joao Silva", "João Silva"): 90.0, ("c", "aaaaa", "aaaab"): 80.0}


def test_first_values_option(spark):
    df = spark.createDataFrame([(1, "abcdef"), (2, "zzzzzz"), (3, "abcdeg")], "at int, c string")
    assert neardup.near_duplicate_values(df, ["c"], max_values=2, order_by="at").count() == 0
    assert neardup.near_duplicate_values(df, ["c"], max_values=3, order_by="at").count() == 1


def test_threshold(spark):
    df = spark.createDataFrame([("abcdefghij",), ("abcdefghix",), ("abcdefghyy",)], "c string")
    assert neardup.near_duplicate_values(df, ["c"], threshold=85).count() == 1
    assert neardup.near_duplicate_values(df, ["c"]).count() == 3
    assert neardup.near_duplicate_values(df, ["c"], threshold=95).count() == 0
    with pytest.raises(ValueError):
        neardup.near_duplicate_values(df, ["c"], threshold=50)


def test_long_texts(spark):
    rnd = random.Random(9)
    base = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(3000))
    near = base[:1000] + "###" + base[1003:2500] + base[2503:]
    other = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(3000))
    df = spark.createDataFrame([(base,), (near,), (other,)], "c string")
    got = neardup.near_duplicate_values(df, ["c"]).collect()
    assert [(r.value_1, r.value_2) for r in got] == [(min(base, near), max(base, near))]
