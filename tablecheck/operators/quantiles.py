"""Exact quantiles without sorting the table or holding a column in one task.

``percentile`` keeps every distinct value of a group in one hash map, so it is used only behind a
counted bound. Larger columns are narrowed down by histograms: each pass is one scan with map-side
partial aggregation, shuffling at most ``BINS`` rows per task and quantile, until the bracket around
each wanted rank is small enough to be ordered. The bin that holds a rank is picked in Spark: one row per rank comes back.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.functions.columns import as_number, by_column, col, long_form, measure
from tablecheck.sources.storage import materialise

SMALL = 100_000  # rows of a column that one `percentile` hash map may hold
GROUP_ROWS = 100_000  # rows of a group that one `percentile` hash map may hold
BINS = 4096  # histogram bins per bracket and pass
PASSES = 12
_LARGEST = 1.7976931348623157e308


@dataclass
class _Bracket:
    """Values in ``[low, high]``; ``below`` rows lie under ``low`` and ``inside`` rows within."""

    column: str
    low: float
    high: float
    below: int
    inside: int


def _bin(scale: str) -> Column:
    """Monotone bin number in 0..BINS-1 of ``value`` between ``start`` and ``stop``; ``log`` resolves brackets that span many magnitudes."""
    value = F.col("value")
    if scale == "log":
        value = F.signum(value) * F.log1p(F.abs(value) / F.col("unit"))
        share = F.try_divide(value - F.col("start"), F.col("stop") - F.col("start"))
    else:
        # Halving first keeps the width finite for brackets as wide as the double range.
        share = F.try_divide(value / 2 - F.col("start") / 2, F.col("stop") / 2 - F.col("start") / 2)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return F.least(F.lit(BINS - 1), F.floor(share * BINS)).cast("int")


def _ends(b: _Bracket, scale: str) -> tuple[float, float, float]:
    """(start, stop, unit) of the scale of a bracket; infinite values fall into the end bins."""
    low, high = max(b.low, -_LARGEST), min(b.high, _LARGEST)
    if scale != "log":
        return low, high, 1.0
    unit = max(abs(low), abs(high)) * 1e-12 or 1e-300
    curve = lambda x: math.copysign(math.log1p(abs(x) / unit), x)
    return curve(low), curve(high), unit


def _rows_of(df: DataFrame, brackets: list[_Bracket], bins: str | None) -> DataFrame:
    """``(bracket, bin, value)`` for every cell that falls into a bracket: cells in long form meet the few brackets of
    their column, so the plan does not grow with columns or brackets."""
    columns = list(dict.fromkeys(b.column for b in brackets))
    cells = long_form(df, {c: as_number(df, c) for c in columns})
    rows = [(i, columns.index(b.column), b.low, b.high, *_ends(b, bins or "linear")) for i, b in enumerate(brackets)]
    table = df.sparkSession.createDataFrame(rows, "bracket int, place int, low double, high double, start double, stop double, unit double")
    place = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (c, i)])[F.col("column")]
    cells = cells.select(place.alias("place"), "value").where("value is not null")
    met = cells.join(F.broadcast(table), "place").where(F.col("value").between(F.col("low"), F.col("high")))
    return met.select("bracket", *([_bin(bins).alias("bin")] if bins else []), "value")


def exact_quantiles(
    df: DataFrame,
    probs_of: dict[str, list[float]],
    bounds: dict[str, tuple[int, float, float]] | None = None,
    small: int = SMALL,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of numeric columns: ``{column: [value per probability]}``.

    ``bounds`` are known ``(non-null count, min, max)`` per column; they are measured when missing.
    """
    columns = list(probs_of)
    if not columns:
        return {}
    if bounds is None:
        bounds = numeric_bounds(df, columns)
    out: dict[str, list[float | None]] = {c: [None] * len(probs_of[c]) for c in columns}

    few = [c for c in columns if 0 < bounds[c][0] <= small]
    if few:
        exact = {c: F.percentile(as_number(df, c), F.array(*[F.lit(float(p)) for p in probs_of[c]])) for c in few}
        out |= {c: list(q) for c, q in measure(df, exact).items()}

    # Every wanted quantile is a blend of at most two ranks.
    wanted: dict[tuple[str, int], _Bracket] = {}
    for c in columns:
        n, low, high = bounds[c]
        if n > small:
            for p in probs_of[c]:
                for rank in {math.floor(p * (n - 1)), math.ceil(p * (n - 1))}:
                    wanted[c, rank] = _Bracket(c, low, high, 0, n)
    ranks = _values_at(df, wanted, small)
    for c in columns:
        n = bounds[c][0]
        if n > small:
            for k, p in enumerate(probs_of[c]):
                h = p * (n - 1)
                a, b = ranks[c, math.floor(h)], ranks[c, math.ceil(h)]
                out[c][k] = a if a == b else a + (h - math.floor(h)) * (b - a)
    return out


def numeric_bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, float, float]]:
    m = by_column(df, {c: as_number(df, c) for c in columns}, {f.__name__: f("value") for f in (F.count, F.min, F.max)})
    return {c: tuple(m[c].values()) for c in columns}


def _at_ranks(counts: DataFrame, by: str, ranks: list[tuple[int, int]]) -> list:
    """Rows of ``counts`` (bracket, ``by``, n) in which the wanted (bracket, rank inside it) lie, with ``rank`` and ``before``."""
    order = Window.partitionBy("bracket").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("before", F.sum("n").over(order) - F.col("n"))
    wanted = counts.sparkSession.createDataFrame(ranks, "bracket int, rank long")
    hit = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
    return run.join(F.broadcast(wanted), "bracket").where(hit).collect()  # one row per wanted rank


def _values_at(df: DataFrame, wanted: dict[tuple[str, int], _Bracket], small: int) -> dict:
    def inside(keys: list[tuple[str, int]]) -> tuple[list[_Bracket], dict[tuple[int, int], list[tuple[str, int]]]]:
        """Brackets of these keys, and which keys want which rank of which bracket."""
        brackets = {(b.column, b.low, b.high): b for b in (wanted[k] for k in keys)}
        at = {k: i for i, k in enumerate(brackets)}
        ranks: dict[tuple[int, int], list[tuple[str, int]]] = {}
        for k in keys:
            b = wanted[k]
            ranks.setdefault((at[b.column, b.low, b.high], k[1] - b.below), []).append(k)
        return list(brackets.values()), ranks

    for step in range(PASSES):
        wide = [k for k, b in wanted.items() if b.inside > small and b.low < b.high]
        if not wide:
            break
        brackets, ranks = inside(wide)
        hist = _rows_of(df, brackets, "linear" if step % 2 == 0 else "log").groupBy("bracket", "bin")
        hist = hist.agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        for r in _at_ranks(hist, "bin", list(ranks)):
            for k in ranks[r["bracket"], r["rank"]]:
                wanted[k] = _Bracket(k[0], r["low"], r["high"], wanted[k].below + r["before"], r["n"])

    out = {k: b.low for k, b in wanted.items() if b.low == b.high}
    left = [k for k in wanted if k not in out]
    if left:
        brackets, ranks = inside(left)
        # Equal values are merged before the shuffle, so ties never crowd a bracket.
        counts = _rows_of(df, brackets, None).groupBy("bracket", "value").agg(F.count("*").alias("n"))
        for r in _at_ranks(counts, "value", list(ranks)):
            out |= dict.fromkeys(ranks[r["bracket"], r["rank"]], r["value"])
    return out


def bucket_bounds(df: DataFrame, value: Column, rows: int, per_bucket: int = 1_000_000) -> list[float]:
    """Inner bucket edges that cut a column into parts of roughly ``per_bucket`` rows.

    Approximate edges are enough: they only decide how work is spread, never a result.
    """
    parts = math.ceil(rows / per_bucket)
    if parts <= 1:
        return []
    probs = [i / parts for i in range(1, parts)]
    edges = df.agg(F.percentile_approx(value, probs, max(10_000, 4 * parts)).alias("e")).first()[0]
    return sorted({e for e in (edges or []) if e is not None and math.isfinite(e)})


def with_bucket(df: DataFrame, value: str, edges: list[float], name: str) -> DataFrame:
    """Add the bucket number of a double column (binary search in the JVM)."""
    if not edges:
        return df.withColumn(name, F.lit(0.0))
    from pyspark.ml.feature import Bucketizer

    splits = [float("-inf"), *edges, float("inf")]
    return Bucketizer(splits=splits, inputCol=value, outputCol=name, handleInvalid="keep").transform(df)


def group_quantile(
    df: DataFrame, key: str, value: str, prob: float, name: str, per_bucket: int = 1_000_000
) -> DataFrame:
    """Exact interpolated quantile of ``value`` per ``key``: ``(key, name)``.

    Keys of a counted ``GROUP_ROWS`` rows at most take one grouping with ``percentile``; only larger ones are
    spread over value buckets.
    """
    d = df.select(col(key).alias("__k"), as_number(df, value).alias("__v")).where("__k is not null")
    sizes = d.groupBy("__k").agg(F.count("__v").alias("n")).where(F.col("n") > GROUP_ROWS)
    small = lambda rows: rows.groupBy("__k").agg(F.percentile("__v", float(prob)).alias("__q"))
    named = lambda q: q.select(F.col("__k").alias(key), F.col("__q").alias(name))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return named(small(d))
    large = materialise(sizes.select("__k"), "large-groups")  # at most one key for each GROUP_ROWS rows
    light = small(d.join(large, "__k", "left_anti"))
    return named(light.unionByName(_spread_quantile(d.join(large, "__k", "left_semi"), total, prob, per_bucket)))


def _spread_quantile(d: DataFrame, n: int, prob: float, per_bucket: int) -> DataFrame:
    """``(__k, __q)`` of groups of any size. Equal values merge map-side; a histogram finds the bucket of each wanted
    rank, and only that bucket's rows are ordered."""
    edges = bucket_bounds(d, F.col("__v"), n, per_bucket)
    d = with_bucket(d.where("__v is not null"), "__v", edges, "__b")

    hist = d.groupBy("__k", "__b").agg(F.count("*").alias("__in"))
    by_key = Window.partitionBy("__k")
    up = by_key.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    target = (
        hist.withColumn("__n", F.sum("__in").over(by_key))
        .withColumn("__below", F.sum("__in").over(up) - F.col("__in"))
        .withColumn("__h", (F.col("__n") - 1) * F.lit(float(prob)))
        .where("floor(__h) < __below + __in and ceil(__h) >= __below")
    )
    counts = (
        d.join(target.select("__k", "__b"), ["__k", "__b"], "left_semi") if edges else d
    ).groupBy("__k", "__b", "__v").agg(F.count("*").alias("__c"))
    in_bucket = Window.partitionBy("__k", "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counts.join(target, ["__k", "__b"])
        .withColumn("__upto", F.sum("__c").over(in_bucket) + F.col("__below"))
        .withColumn("__from", F.col("__upto") - F.col("__c"))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("__from")) & (rank < F.col("__upto")), F.col("__v")))

    low, high, h = F.floor("__h"), F.ceil("__h"), F.max("__h")
    a, b = at(low), at(high)
    found = ranked.groupBy("__k").agg(
        F.when(a == b, a).otherwise(a + (h - F.floor(h)) * (b - a)).alias("__q")
    )
    return found
