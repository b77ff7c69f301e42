"""Functional dependencies between columns: which column's value fixes another's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.functions.columns import as_key

DETERMINANTS_PER_JOB = 16
# Above this many rows a share of the determinant values is looked at first. A contradiction there is
# a contradiction, so most pairs are settled before the full pass; none is accepted by it.
SCREEN_ROWS = 5_000_000
SCREEN_SHARE = 64


def functional_dependencies(
    df: DataFrame, rows: int, distinct: dict[str, int], max_pairs: int | None = None
) -> list[tuple[str, str, int]]:
    """``(determinant, dependent, groups checked)`` for every ordered pair that holds, on all rows.

    ``max_pairs`` is an optional budget of ordered column pairs in table order; by default all are checked.
    """
    pairs: list[tuple[str, str]] = []
    for a in df.columns:
        if 2 <= distinct[a] <= max(rows * 0.5, 2):
            pairs += [(a, b) for b in df.columns if a != b]
    if max_pairs is not None:
        pairs = pairs[:max_pairs]
    keys = {c: as_key(df, c) for c in df.columns}
    out: dict[tuple[str, str], int] = {}
    determinants = list(dict.fromkeys(a for a, _ in pairs))
    for start in range(0, len(determinants), DETERMINANTS_PER_JOB):
        part = set(determinants[start : start + DETERMINANTS_PER_JOB])
        alive = [p for p in pairs if p[0] in part]
        if rows > SCREEN_ROWS:
            alive = _not_refuted(df, alive, keys, SCREEN_SHARE)
        alive = _not_refuted(df, alive, keys)
        out |= _confirmed(df, alive, keys)
    return [(a, b, out[a, b]) for a, b in pairs if (a, b) in out]


def _not_refuted(
    df: DataFrame, pairs: list[tuple[str, str]], keys: dict, share: int | None = None
) -> list[tuple[str, str]]:
    """Pairs no group contradicts, judged by hashes.

    Minimum and maximum of a fixed-width hash keep the grouping a hash aggregate that merges
    map-side; extremes that differ refute a pair for certain, whatever the hash.
    """
    if not pairs:
        return []
    a_of = list(dict.fromkeys(a for a, _ in pairs))
    b_of = list(dict.fromkeys(b for _, b in pairs))
    cells = df.select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), keys[a].alias("a")) for i, a in enumerate(a_of)])).alias("d"),
        *[F.when(keys[b].isNotNull(), F.xxhash64(keys[b])).alias(f"b{j}") for j, b in enumerate(b_of)],
    ).where(F.col("d.a").isNotNull())
    if share:
        cells = cells.where(F.pmod(F.xxhash64("d.a"), F.lit(share)) == 0)  # whole groups
    slots = range(len(b_of))
    groups = cells.groupBy(F.col("d.i").alias("i"), F.col("d.a").alias("a")).agg(
        *[f(f"b{j}").alias(f"{f.__name__}{j}") for j in slots for f in (F.min, F.max)]
    )
    verdict = groups.groupBy("i").agg(
        F.count("*").alias("groups"), *[F.max(F.col(f"min{j}") != F.col(f"max{j}")).alias(f"x{j}") for j in slots]
    )
    rows = {a_of[r["i"]]: r for r in verdict.collect()}  # one row per determinant
    if share:
        return [(a, b) for a, b in pairs if a not in rows or rows[a][f"x{b_of.index(b)}"] is not True]
    # An all-null dependent leaves NULL: neither broken nor a dependency.
    return [
        (a, b) for a, b in pairs if a in rows and rows[a]["groups"] >= 2 and rows[a][f"x{b_of.index(b)}"] is False
    ]


def _confirmed(df: DataFrame, pairs: list[tuple[str, str]], keys: dict) -> dict[tuple[str, str], int]:
    """Pairs that hold on the values themselves, with the number of determinant groups."""
    if not pairs:
        return {}
    a_of = list(dict.fromkeys(a for a, _ in pairs))
    b_of = list(dict.fromkeys(b for _, b in pairs))
    asked = {b: [i for i, a in enumerate(a_of) if (a, b) in set(pairs)] for b in b_of}
    # One grouping for all determinants: least and greatest value merge map-side. A cell nobody asks for is null.
    cells = df.select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), keys[a].alias("a")) for i, a in enumerate(a_of)])).alias("d"),
        *[keys[b].alias(f"b{j}") for j, b in enumerate(b_of)],
    ).where(F.col("d.a").isNotNull())
    cells = cells.select("d.i", "d.a", *[F.when(F.col("d.i").isin(asked[b]), F.col(f"b{j}")).alias(f"b{j}") for j, b in enumerate(b_of)])
    slots = range(len(b_of))
    groups = cells.groupBy("i", "a").agg(*[f(f"b{j}").alias(f"{f.__name__}{j}") for j in slots for f in (F.min, F.max)])
    broken = F.array(*[F.max(F.col(f"min{j}") != F.col(f"max{j}")) for j in slots])
    verdict = {a_of[r["i"]]: r for r in groups.groupBy("i").agg(F.count("*").alias("groups"), broken.alias("broken")).collect()}  # one row per determinant
    return {(a, b): verdict[a]["groups"] for a, b in pairs if a in verdict and verdict[a]["broken"][b_of.index(b)] is False}


def sampled_rows(df: DataFrame, size: int | float, by: list[str] | None = None) -> DataFrame:
    """A share of the rows, drawn row by row, or exactly ``size`` rows: those with the least MD5 of their cells.

    The latter are the same whatever the partitioning or order of the table; each task keeps its own ``size`` least ones. ``by``
    names the columns that are hashed (all by default). Rows that agree in them have one hash and come together, so tables
    with many equal rows are better sampled by share.
    """
    if isinstance(size, float):
        return df.sample(size, seed=42)
    cells = [F.coalesce(F.col("`" + c.replace("`", "``") + "`").cast("string"), F.lit("\u0000")) for c in (by or df.columns)]
    return df.withColumn("__key", F.md5(F.concat_ws("|", *cells))).orderBy("__key").limit(size).drop("__key")
