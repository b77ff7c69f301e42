"""Mix sources to target weights along a curriculum whose weights change over the training run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.llm.common import materialise, running_total, sized_join, spread_key, words_in


@dataclass(frozen=True)
class Schedule:
    """A weight as straight lines between ``(time, factor)`` knots, time running from 0 to 1, factors above 0."""

    knots: tuple[tuple[float, float], ...]

    def pieces(self) -> list[tuple[float, float, float, float, float]]:
        """(start, length, factor at the start, slope, integral before) of each line."""
        out, before = [], 0.0
        for (t0, f0), (t1, f1) in zip(self.knots, self.knots[1:], strict=False):
            out.append((t0, t1 - t0, f0, (f1 - f0) / (t1 - t0), before))
            before += (t1 - t0) * (f0 + f1) / 2
        return out

    def area(self) -> float:
        return sum((t1 - t0) * (f0 + f1) / 2 for (t0, f0), (t1, f1) in zip(self.knots, self.knots[1:], strict=False))

    def time_at(self, share: Column) -> Column:
        """When this share of the integral is reached: the quadratic of the line that holds it, solved."""
        need, answer = share * F.lit(self.area()), None
        for t0, length, f0, slope, before in reversed(self.pieces()):
            rest = need - F.lit(before)
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(f0 * f0) + F.lit(2 * slope) * rest))
            at = F.lit(t0) + F.least(F.lit(length), F.lit(2.0) * rest / (F.lit(f0) + root))
            answer = at if answer is None else F.when(need >= F.lit(before + length * (f0 + f0 + slope * length) / 2), answer).otherwise(at)
        return answer


#: Weights of the sources in order, repeating, and how each weight changes over the run (mean factor 1).
WEIGHTS = (5, 2, 1)
SCHEDULES = (Schedule(((0.0, 1.5), (1.0, 0.5))), Schedule(((0.0, 0.5), (0.5, 1.5), (1.0, 0.5))), Schedule(((0.0, 0.5), (1.0, 1.5))))


def source_targets(sizes: DataFrame, source_cols: list[str], weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = 3) -> DataFrame:
    """Words to take from each source.

    ``sizes``: one row per source with ``source_size``; ``source_cols`` give the order in which ``weights``
    repeat. The budget is ``share`` of all sizes; a source stops at ``most`` times its size and what it leaves
    is shared by weight among the others. Sorting sources by (limit / weight) makes the stopped ones a prefix,
    so one running sum finds the level at which nobody is above the limit.
    """
    place = F.row_number().over(Window.orderBy(*source_cols)) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("place", place).withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    order = Window.orderBy((F.col("limit") / F.col("weight")).asc(), "place")
    everything = Window.partitionBy()
    rest = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = rest / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("limit") / F.col("weight"))
    first = F.min(F.when(F.col("fits"), F.struct((F.col("limit") / F.col("weight")).alias("r"), "place", "level"))).over(everything)
    rows = rows.withColumn("first", first)
    below = F.col("first").isNull() | (F.struct((F.col("limit") / F.col("weight")).alias("r"), "place") < F.struct("first.r", "first.place"))
    target = F.when(below, F.col("limit").cast("double")).otherwise(F.col("first.level") * F.col("weight"))
    return rows.select(*source_cols, "source_size", "place", target.alias("target"))


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None, payload: list[str] | None = None,
               weights: tuple[int, ...] = WEIGHTS, schedules: tuple[Schedule, ...] = SCHEDULES, share: float = 1.0, most: int = 3, seed: str = "mix") -> DataFrame:
    """Give every document its places in a training run.

    The stream of a source is its documents in a hashed order, repeated up to ``most`` times. The copies whose
    middle lies within the source's target are taken; the share of the target before that middle, put through
    the inverse of the integral of the source's weight schedule, is the copy's time in the run. Sources are
    ordered by code point, null last; weights and schedules repeat in that order.

    Result: ``payload`` columns (default: the id), ``size`` (words), ``source_size``, ``target``, ``copies``,
    ``taken`` (size times copies), ``positions`` (times between 0 and 1, one per copy). One row per input row.
    A null text has size 0; null is a source of its own. Documents of size 0 add nothing to a target; they
    are placed like others. Repeated rows are documents of their own. Empty tables give an empty result.
    Other columns are ignored; payload columns named like a result column are replaced.

    No source is gathered anywhere: positions come from :func:`running_total`.
    """
    own = {"size", "source_size", "target", "copies", "taken", "positions"}
    payload = [c for c in (payload if payload is not None else [id_col]) if c not in own]
    size = F.col(size_col).cast("long") if size_col else words_in(F.col(text_col))
    rows = docs.select(
        *[F.col(c).alias(f"p_{c}") for c in payload], F.col(id_col).alias("__id"),
        F.col(source_col).isNull().cast("int").alias("__none"), F.coalesce(F.col(source_col), F.lit("")).alias("__source"),
        size.alias("size"), spread_key(seed, F.col(id_col)).alias("__key"),
    )
    by = ["__none", "__source"]
    sizes = rows.groupBy(*by).agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sizes = materialise(sizes, "sources")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    targets = materialise(source_targets(sizes.drop("n"), by, weights, share, most), "targets")
    rows = running_total(rows, by, "__key", ["__id", "size"], F.col("size"), "__offset", total)
    rows = sized_join(rows, targets, by)

    middles = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.col("__offset") + e * F.col("source_size") + F.col("size") / 2)
    rows = rows.withColumn("__middles", F.filter(middles, lambda m: m <= F.col("target")))
    which = F.col("place") % len(schedules)

    def time(middle: Column) -> Column:
        share_before = F.when(F.col("target") > 0, middle / F.col("target")).otherwise(F.lit(0.0))
        at = F.when(which == 0, schedules[0].time_at(share_before))
        for i, schedule in enumerate(schedules[1:], 1):
            at = at.when(which == i, schedule.time_at(share_before))
        return at

    copies = F.size("__middles").cast("long")
    return rows.select(
        *[F.col(f"p_{c}").alias(c) for c in payload], "size", "source_size", "target", copies.alias("copies"),
        (F.col("size") * copies).alias("taken"), F.transform("__middles", time).alias("positions"),
    )


def training_order(mixed: DataFrame, ties: list[str]) -> DataFrame:
    """One row per copy, sorted by ``position`` over the whole run (a range sort); ``epoch`` counts a document's copies."""
    copies = mixed.select(*[c for c in mixed.columns if c not in ("positions", "position", "epoch")], F.posexplode("positions").alias("epoch", "position"))
    return copies.orderBy("position", *ties, "epoch")
