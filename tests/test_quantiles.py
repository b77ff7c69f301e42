import math
import random

import numpy as np
import pytest

from tablecheck.operators import quantiles as Q

random.seed(7)
CASES = {
    "uniform": [random.random() * 100 for _ in range(3000)],
    "heavy tail": [random.paretovariate(0.3) for _ in range(3000)],
    "many magnitudes": [random.choice([-1, 1]) * 10 ** random.uniform(-250, 250) for _ in range(2000)],
    "a third equal": [5.0] * 1000 + [random.gauss(5, 2) for _ in range(2000)],
    "two values": [0.0] * 1500 + [1.0] * 1500,
    "one far point": [random.random() for _ in range(2000)] + [1e300],
    "infinite ends": [float("inf")] * 900 + [float("-inf")] * 900 + [random.random() for _ in range(1000)],
    "wide range": [-1.7e308, 1.7e308, *[float(i) for i in range(2000)]],
}
PROBS = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.mark.parametrize("case", CASES)
def test_narrowing_equals_sorting(spark, case):
    values = CASES[case]
    df = spark.createDataFrame([(v, None if i % 5 else float(i)) for i, v in enumerate(values)], "v double, w double")
    got = Q.exact_quantiles(df, {"v": PROBS, "w": [0.5]}, small=50)
    with np.errstate(over="ignore"):
        want = [_quantile(values, p) for p in PROBS]
    assert got["v"] == pytest.approx(want, rel=1e-12)
    assert got["w"] == pytest.approx([_quantile([float(i) for i in range(0, len(values), 5)], 0.5)])
    # The direct path gives the same figures.
    assert Q.exact_quantiles(df, {"v": PROBS})["v"] == pytest.approx(want, rel=1e-9)


def _quantile(values, p):
    s = sorted(values)
    h = p * (len(s) - 1)
    a, b = s[math.floor(h)], s[math.ceil(h)]
    return a if a == b else a + (h - math.floor(h)) * (b - a)


def test_empty_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert Q.exact_quantiles(df, {"v": [0.5]}) == {"v": [None]}


@pytest.mark.parametrize("per_bucket, group_rows", [(10, 0), (1_000_000, 0), (10, 100), (10, 100_000)])
def test_group_quantile(spark, monkeypatch, per_bucket, group_rows):
    """All groups spread over buckets, only the hot one, and none."""
    monkeypatch.setattr(Q, "GROUP_ROWS", group_rows)
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.4 else f"g{rnd.randrange(20)}", round(rnd.gauss(0, 10), 1)) for _ in range(900)]
    rows += [(None, 1.0), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for prob in (0.5, 0.25):
        got = {r.g: r.q for r in Q.group_quantile(df, "g", "v", prob, "q", per_bucket).collect()}
        want = {}
        for g, v in rows:
            if g is not None:
                want.setdefault(g, []).extend([] if v is None else [v])
        assert set(got) == set(want)
        for g, vs in want.items():
            assert got[g] == (pytest.approx(_quantile(vs, prob)) if vs else None)
