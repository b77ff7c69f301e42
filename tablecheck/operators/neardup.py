"""The most similar pairs of different values in each text column.

Similarity is ``100 * 2 * LCS / (len a + len b)``; a pair is reported from 80 up, three per column,
ordered by similarity and then by value. All distinct values take part, none is sampled.

Comparing all pairs is out of the question, and so is enumerating every pair above 80 (numbered names
all resemble each other). Only the best three matter, so the search goes from the most similar down:

1. Values that become equal when each side drops at most one character share a *deletion variant*.
   All pairs inside a variant have one similarity, so its four smallest members are enough. This is
   linear in the number of values and has no hot groups.
2. Whatever is left is searched with falling thresholds. At a threshold two values must share one of
   their rarest q-grams (prefix filter), so only those are joined; q is as large as the threshold and
   the lengths allow, which keeps the joined groups small. The search stops for a column as soon as
   its third best pair reaches the threshold.
3. Where grams tell values too little apart (random keys of few letters: the joined groups, counted first,
   hold a good part of all pairs) and for short columns anyway, blocks of values meet instead, each pair of blocks
   in a task of its own; comparing character counts rules nearly all pairs out before they are scored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.functions.columns import col
from tablecheck.functions.similarity import best_pairs, lcs
from tablecheck.functions.text import strip
from tablecheck.operators.frequency import value_counts
from tablecheck.sources.storage import materialise

TOP = 3
VARIANT_LENGTH = 64  # longer values skip step 1; step 2 then covers all their pairs
TIERS = [0.98, 0.95, 0.90, 0.80]
LONGEST_GRAM = 24
SMALL_TEXT = 500_000  # characters of a column's distinct values
BLOCK = 2_000  # members of one gram, or values of a column, that meet as many others in one task
ALL_PAIRS = 10_000  # columns of at most so many values are compared block by block at once
BLOCK_LENGTH = 256  # if no value is longer
GRAM_COST = 20  # a pair that grams bring together costs as much as so many in a block
_SCHEMA = "column string, value_1 string, value_2 string, similarity_pct double"
_EPS = 1e-9


def near_duplicate_values(
    df: DataFrame,
    columns: list[str],
    threshold: float = 80.0,
    top: int = TOP,
    max_values: int | None = None,
    order_by: str | None = None,
) -> DataFrame:
    """``(column, value_1, value_2, similarity_pct)`` with ``value_1 < value_2``.

    ``max_values`` keeps only the first distinct values by ``order_by``, as an option for callers who
    want that bound; by default every value is compared.
    """
    if not 80.0 <= threshold < 100.0:
        raise ValueError("threshold must lie in [80, 100)")
    if not columns:
        return df.sparkSession.createDataFrame([], _SCHEMA)
    values = _distinct_values(df, columns, max_values, order_by).persist()
    try:
        return _search(values, threshold / 100.0, top)
    finally:
        values.unpersist()


def _distinct_values(df, columns, max_values, order_by) -> DataFrame:
    cells = df.select(*[strip(col(c)).alias(c) for c in columns], *([col(order_by).alias("__at")] if order_by else []))
    if max_values is None:
        out = value_counts(cells, columns).select("column", "value")
    else:
        if order_by is None:
            raise ValueError("max_values needs order_by")
        long = cells.unpivot([F.col("__at")], [col(c) for c in columns], "column", "value").where("value is not null")
        first = long.groupBy("column", "value").agg(F.min("__at").alias("at"))
        w = Window.partitionBy("column").orderBy("at", "value")
        out = first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_values).select("column", "value")
    return out.withColumn("len", F.char_length("value"))


def _best(pairs: DataFrame, top: int) -> list[tuple]:
    """The best ``top`` pairs per column; Spark prunes to them in every task before shuffling."""
    w = Window.partitionBy("column").orderBy(F.desc("sim"), "a", "b")
    ranked = pairs.withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= top)  # a pair may come twice
    return [(r["column"], r["a"], r["b"], r["sim"]) for r in ranked.collect()]


def _search(values: DataFrame, floor: float, top: int) -> DataFrame:
    spark = values.sparkSession
    stats = {
        r["column"]: r
        for r in values.groupBy("column")
        .agg(
            F.count("*").alias("n"), F.min("len").alias("min"), F.max("len").alias("max"), F.sum("len").alias("chars")
        )
        .where("n > 1")
        .collect()
    }
    best: dict[str, list[tuple]] = {c: [] for c in stats}
    _merge(best, _best(_one_deletion_pairs(values, floor, top), top), top)

    blockwise = {}
    for c, rows in best.items():
        if stats[c]["n"] <= ALL_PAIRS and stats[c]["max"] <= BLOCK_LENGTH:
            t = max(floor, rows[-1][3]) if len(rows) == top else floor
            if _reach(t, stats[c]):
                blockwise[c] = t
    if blockwise:
        _merge(best, _best(_block_pairs(values, blockwise, stats, top), top), top)

    above = 1.0
    for tier in TIERS:
        tier = max(tier, floor)
        bar = {}  # what a further pair must reach to change a column's answer
        for c, rows in best.items():
            if c in blockwise:
                continue
            full = len(rows) == top
            if full and rows[-1][3] >= above:
                continue  # everything this similar was found at the threshold before
            if tier > max(floor, TIERS[-1]) and stats[c]["chars"] <= SMALL_TEXT:
                continue  # one pass at the last threshold costs less than several
            t = max(tier, rows[-1][3]) if full else tier
            if _reach(t, stats[c]):
                bar[c] = t
        if bar:
            lowest = {c: max(floor, best[c][-1][3]) if len(best[c]) == top else floor for c in bar}
            pairs, settled = _gram_pairs(values, bar, stats, top, lowest)
            _merge(best, _best(pairs, top), top)
            blockwise |= settled
        above = tier
        if tier <= floor:
            break
    rows = [(c, a, b, round(100.0 * s, 6)) for c in best for (_, a, b, s) in best[c]]
    return spark.createDataFrame(rows, _SCHEMA)


def _merge(best: dict[str, list[tuple]], found: list[tuple], top: int) -> None:
    for row in found:
        if row not in best[row[0]]:
            best[row[0]].append(row)
    for rows in best.values():
        rows.sort(key=lambda r: (-r[3], r[1], r[2]))
        del rows[top:]


def _one_deletion_pairs(values: DataFrame, floor: float, top: int) -> DataFrame:
    short = values.where(F.col("len").between(2, VARIANT_LENGTH))
    at = F.col("at")
    places = short.select("column", "value", "len", F.explode(F.sequence(F.lit(0), F.col("len"))).alias("at"))
    # Dropping any character of a run gives the same variant; only the last one of a run is dropped.
    places = places.where((at == 0) | (F.substring("value", at, F.lit(1)) != F.substring("value", at + 1, F.lit(1))))
    members = places.select(
        "column",
        "value",
        "len",
        (at == 0).alias("whole"),
        F.when(at == 0, F.col("value"))
        .otherwise(F.concat(F.substring("value", F.lit(1), at - 1), F.substring("value", at + 1, F.col("len"))))
        .alias("variant"),
    )
    # The value that is the variant itself, if there is one, and the smallest of the others.
    w = Window.partitionBy("column", "variant").orderBy(F.desc("whole"), "value")
    few = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top + 2)
    group = few.groupBy("column", "variant").agg(F.collect_list(F.struct("value", "len")).alias("m"))
    both = F.flatten(
        F.transform("m", lambda x: F.transform("m", lambda y: F.struct(x.alias("x"), y.alias("y"))))
    )  # at most (top + 2)^2
    x, y = F.col("p.x"), F.col("p.y")
    pairs = group.where(F.size("m") > 1).select("column", F.explode(both).alias("p")).where(x["value"] < y["value"])
    total = x["len"] + y["len"]
    distance = F.when(x["len"] == y["len"], 2).otherwise(1)
    return pairs.select(
        "column", x["value"].alias("a"), y["value"].alias("b"), ((total - distance) / total).alias("sim")
    ).where(F.col("sim") >= floor - _EPS)


def _reach(t: float, stats) -> bool:
    """Can any two values of a column reach ``t`` in a way step 1 did not cover?"""
    edits = int((1 - t) * 2 * stats["max"] + _EPS)
    return stats["max"] > VARIANT_LENGTH or edits > 2 or (edits == 2 and stats["max"] - stats["min"] >= 2)


def _gram_length(t: float, low: int, high: int) -> int | None:
    """Largest q for pairs whose longer side has ``low`` to ``high`` characters, or None if no such
    pair is left for step 2.

    A side of length ``s`` loses at most ``2 q s (1 - t) / (2 - t)`` of its ``s - q + 1`` grams to a
    partner at ``t`` (worst when the partner is a shortest possible subsequence). One must remain.
    """
    shortest = max(1, int(low * t / (2 - t) - _EPS) + 1)
    sizes = [s for s in range(shortest, min(high, shortest + 200) + 1) if _edits(t, s) >= (1 if high > VARIANT_LENGTH else 2)]
    if not sizes:
        return None
    for q in range(LONGEST_GRAM, 1, -1):
        enough = all(_lost(q, s, t) + 1 <= s - q + 1 for s in sizes)
        # Beyond the sizes tried one by one the margin only grows.
        if enough and (high <= sizes[-1] or q * (1 + 2 * sizes[-1] * (1 - t) / (2 - t)) <= sizes[-1]):
            return q
    return 1


def _edits(t: float, length: int) -> int:
    """Most insertions and deletions between a value of this length and a partner at ``t``."""
    return int((1 - t) * (length + int(length * (2 - t) / t + _EPS)) + _EPS)


def _lost(q: int, length: int, t: float) -> int:
    return int(2.0 * q * length * (1 - t) / (2 - t) + _EPS)


def _bands(t: float, longest: int) -> list[tuple[int, int, int]]:
    """``(low, high, q)`` by length of the longer side, each band a quarter wider than the last."""
    out, low = [], 1
    while low <= longest:
        high = low * 5 // 4
        q = _gram_length(t, low, high)
        if q:
            out.append((low, high, q))
        low = high + 1
    return out


def _block_pairs(values: DataFrame, bar: dict[str, float], stats: dict, top: int) -> DataFrame:
    """The best pairs of each pair of blocks of a column, from the column's bar up."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        column, low, high = pdf["column"].iloc[0], pdf["low"].iloc[0], pdf["high"].iloc[0]
        left, right = (pdf.loc[pdf["block"] == b, "value"].tolist() for b in (low, high))
        found = best_pairs(left, None if low == high else right, bar[column], top)
        return pd.DataFrame([(column, *f) for f in found], columns=["column", "a", "b", "sim"])

    blocks = F.create_map(*[F.lit(x) for c in bar for x in (c, -(-stats[c]["n"] // BLOCK))])[F.col("column")]
    rows = values.where(F.col("column").isin(list(bar))).select("column", "value", F.pmod(F.xxhash64("value"), blocks).cast("int").alias("block"), blocks.alias("blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("column", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "value")
    return rows.groupBy("column", "low", "high").applyInPandas(meet, "column string, a string, b string, sim double")


def _gram_pairs(values: DataFrame, bar: dict[str, float], stats: dict, top: int, lowest: dict[str, float]) -> tuple[DataFrame, dict[str, float]]:
    """Pairs from each column's bar up, and the columns that were compared block by block instead, from ``lowest`` up."""

    def per_column(figures: dict[str, float]) -> Column:
        return F.create_map(*[F.lit(x) for kv in figures.items() for x in kv])[F.col("column")]

    t, n = F.col("t"), F.col("len")
    bands = {c: _bands(x, stats[c]["max"]) for c, x in bar.items()}
    bands = {c: b for c, b in bands.items() if b}
    if not bands:
        return values.sparkSession.createDataFrame([], "column string, a string, b string, sim double"), {}
    v = values.where(F.col("column").isin(list(bands))).select(
        "column",
        "value",
        "len",
        per_column({c: bar[c] for c in bands}).alias("t"),
        per_column({c: float(stats[c]["min"]) for c in bands}).alias("shortest"),
        per_column({c: float(stats[c]["max"]) for c in bands}).alias("longest"),
    )
    # Longest and shortest partner that can reach t, and the edits such a pair may need.
    longest = F.least(F.col("longest"), F.floor(n * (2 - t) / t + _EPS))
    shortest = F.greatest(F.col("shortest"), F.ceil(n * t / (2 - t) - _EPS))
    edits = F.floor((1 - t) * (n + longest) + _EPS)
    unequal = (longest >= n + 2) | (shortest <= n - 2)
    covered = (longest <= VARIANT_LENGTH) & ((edits < 2) | ((edits == 2) & ~unequal))
    key = F.when(F.octet_length("value") <= 96, F.col("value")).otherwise(
        F.concat(F.lit("\u0001"), F.sha2("value", 256))
    )
    v = v.where(~covered & (longest >= shortest) & (edits >= 1)).select(
        "column", "value", "len", "t", longest.alias("longest"), key.alias("id")
    )

    band_list = F.create_map(
        *[
            x
            for c, bs in bands.items()
            for x in (
                F.lit(c),
                F.array(*[F.struct(F.lit(lo).alias("low"), F.lit(hi).alias("high"), F.lit(q).alias("q")) for lo, hi, q in bs]),
            )
        ]
    )[F.col("column")]
    sides = v.select(
        "*",
        F.explode(F.filter(band_list, lambda b: (b["low"] <= F.col("longest")) & (b["high"] >= F.col("len")))).alias("band"),
    ).select("column", "value", "id", "len", "t", "band.low", "band.high", "band.q")
    # A partner may cost this many of the value's own grams, so among one more of them one is shared.
    lost = F.floor(2.0 * F.col("q") * n * (1 - t) / (2 - t) + _EPS)
    grams = F.transform(F.sequence(F.lit(1), n - F.col("q") + 1), lambda i: F.substring(F.col("value"), i, F.col("q")))
    cut = sides.where(n >= F.col("q")).select("column", "low", "high", "id", "len", "t", (lost + 1).alias("prefix"), F.explode(grams).alias("gram"))
    # Repeats are numbered, so that a value's grams are a set.
    cut = cut.groupBy(*cut.columns).agg(F.count("*").alias("times")).withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    tokens = cut.select("column", "low", "high", "id", "len", "t", "prefix", F.concat("gram", "time").alias("gram"))
    common = tokens.groupBy("column", "low", "gram").agg(F.count("*").alias("n")).where("n > 1")
    # A gram that only one value has cannot be shared, but it does use up a place in the prefix.
    ranked = tokens.join(common, ["column", "low", "gram"], "left")
    w = Window.partitionBy("column", "low", "id").orderBy(F.coalesce("n", F.lit(1)), "gram")
    rare = (
        ranked.withColumn("r", F.row_number().over(w))
        .where((F.col("r") <= F.col("prefix")) & F.col("n").isNotNull())
        .select("column", "low", "high", "gram", "id", "len", "t", "n")
    )
    rare = materialise(rare, "rare-grams")
    shares = rare.groupBy("column", "low", "gram").agg(F.count("*").alias("m"))
    work = {r["column"]: r["pairs"] for r in shares.groupBy("column").agg(F.sum(F.col("m") * F.col("m").cast("double")).alias("pairs")).collect()}
    crowded = {c for c, w in work.items() if stats[c]["max"] <= BLOCK_LENGTH and w * GRAM_COST > float(stats[c]["n"]) ** 2}
    rare = rare.where(~F.col("column").isin(list(crowded))) if crowded else rare
    # A gram of many members is cut into blocks on both sides; each pair of blocks is a key of its own.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    left = rare.withColumn("y", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("x", mine)
    right = rare.withColumn("x", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "column", "low", "gram", F.col("id").alias("id2"), F.col("len").alias("len2"), "x", mine.alias("y")
    )
    shorter, longer = F.least("len", "len2"), F.greatest("len", "len2")
    met = (
        left.join(right, ["column", "low", "gram", "x", "y"])
        .where((F.col("id") < F.col("id2")) & longer.between(F.col("low"), F.col("high")))
        .where(2 * shorter >= t * (shorter + longer) - _EPS)
        .select("column", "id", "id2", "t")
        .distinct()
    )
    text = v.select("column", F.col("id").alias("k"), "value", "len")
    one = text.select("column", F.col("k").alias("id"), F.col("value").alias("x"), F.col("len").alias("lx"))
    two = text.select("column", F.col("k").alias("id2"), F.col("value").alias("y"), F.col("len").alias("ly"))
    # What is left is pruned without Python: no two texts are fewer insertions and deletions apart than edits.
    allowed = F.floor((1 - t) * (F.col("lx") + F.col("ly")) + _EPS).cast("int")
    near = F.levenshtein("x", "y") <= allowed
    scored = (
        met.join(one, ["column", "id"])
        .join(two, ["column", "id2"])
        .where(near)
        .withColumn("sim", 2.0 * lcs("x", "y") / (F.col("lx") + F.col("ly")))
        .where((F.col("sim") >= t - _EPS) & (F.col("sim") < 1.0))
    )
    found = scored.select("column", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "sim")
    floors = {c: lowest[c] for c in crowded}
    if floors:
        found = found.unionByName(_block_pairs(values, floors, stats, top))
    return found, floors
