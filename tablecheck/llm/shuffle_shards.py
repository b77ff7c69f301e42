"""A uniform shuffle into shards of exact sizes: hypergeometric counts, local permutation, exchange, permutation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablecheck.llm.common import materialise, running_total, spread_key, unit

#: Rows of a local partition, and children of a node of the tree of draws.
PART_ROWS, FAN_OUT = 1024, 16


def hypergeometric(good: Column, total: Column, drawn: Column, u: Column) -> Column:
    """Inverse distribution function at ``u`` of the number of good ones among ``drawn`` out of ``total``.

    Probabilities follow from their neighbours' ratio, starting 12 standard deviations below the mode, where they
    are below what a double resolves against their sum.
    """
    good, total, drawn = good.cast("double"), total.cast("double"), drawn.cast("double")
    spread = F.sqrt(drawn * (good / total) * (1 - good / total) * (total - drawn) / F.greatest(total - 1, F.lit(1.0)))
    mode = F.floor((drawn + 1) * (good + 1) / (total + 2)).cast("long")
    wide = F.ceil(12 * spread).cast("long") + 10
    least, most = F.greatest(F.lit(0.0), drawn - (total - good)).cast("long"), F.least(good, drawn).cast("long")
    start, stop = F.greatest(least, mode - wide), F.least(most, mode + wide)

    def ratio(k: Column) -> Column:  # of the probability of k to that of k - 1
        k = k.cast("double")
        return (good - k + 1) * (drawn - k + 1) / (k * (total - good - drawn + k))

    steps = F.when(stop > start, F.sequence(start + 1, stop)).otherwise(F.array().cast("array<bigint>"))
    zero = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"))

    def add(s: Column, k: Column) -> Column:
        return F.struct((s["p"] * ratio(k)).alias("p"), (s["sum"] + s["p"] * ratio(k)).alias("sum"))

    whole = F.aggregate(steps, zero, add, lambda s: s["sum"])
    # one step further for as long as the sum so far is below the share asked for
    begin = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"), start.alias("k"), (u * whole).alias("need"))

    def seek(s: Column, k: Column) -> Column:
        p = s["p"] * ratio(k)
        return F.struct(p.alias("p"), (s["sum"] + p).alias("sum"), F.when(s["sum"] < s["need"], k).otherwise(s["k"]).alias("k"), s["need"].alias("need"))

    return F.when((total <= 0) | (drawn <= 0) | (good <= 0), F.lit(0).cast("long")).otherwise(F.aggregate(steps, begin, seek, lambda s: s["k"]))


def deal(capacities: Column, counts: Column, seed: Column) -> Column:
    """Split ``capacities`` (free places of each shard) over children with ``counts`` rows each: an array of arrays.

    The children draw one after the other, and within a child shard after shard, each from what is left: together a
    draw of the multivariate hypergeometric distribution with exact margins.
    """
    longs = F.array().cast("array<bigint>")

    def child(state: Column, count: Column) -> Column:
        begin = F.struct(longs.alias("got"), count.alias("need"), F.aggregate(state["free"], F.lit(0).cast("long"), lambda a, x: a + x).alias("left"))

        def draw(s: Column, free: Column) -> Column:
            u = unit(spread_key("draw", seed, F.size(state["parts"]), F.size(s["got"])))
            x = hypergeometric(free, s["left"], s["need"], u)
            # x occurs three times; a list of one binds it
            return F.element_at(F.transform(F.array(x), lambda y: F.struct(F.concat(s["got"], F.array(y)).alias("got"), (s["need"] - y).alias("need"), (s["left"] - free).alias("left"))), 1)

        got = F.aggregate(state["free"], begin, draw, lambda s: s["got"])
        return F.element_at(F.transform(F.array(got), lambda g: F.struct(F.zip_with(state["free"], g, lambda a, b: a - b).alias("free"), F.concat(state["parts"], F.array(g)).alias("parts"))), 1)

    zero = F.struct(capacities.alias("free"), F.array().cast("array<array<bigint>>").alias("parts"))
    return F.aggregate(counts, zero, child, lambda s: s["parts"])


def communication_matrix(spark: SparkSession, part_counts: DataFrame, parts: int, capacities: list[int], seed: str) -> DataFrame:
    """How many rows of each local partition go to each shard: ``part``, ``quota`` (array).

    ``part_counts``: part, n (parts without rows may be missing). The counts are drawn down a tree of ``FAN_OUT``
    children, so no node holds more than that many arrays and the nodes of a level are drawn side by side.
    """
    depth = max(1, math.ceil(math.log(max(parts, 2), FAN_OUT) - 1e-9))
    level = spark.range(parts).select(F.col("id").alias("node"))
    level = level.join(part_counts.select(F.col("part").alias("node"), "n"), "node", "left").select("node", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    levels = []
    for _ in range(depth):
        kids = F.array_sort(F.collect_list(F.struct("node", "n")))
        level = level.groupBy((F.expr(f"node div {FAN_OUT}")).alias("up")).agg(kids.alias("kids"), F.sum("n").alias("n"))
        level = materialise(level.select(F.col("up").alias("node"), F.col("kids.node").alias("names"), F.col("kids.n").alias("counts"), "n"), "tree")
        levels.append(level)
    caps = F.array(*[F.lit(c).cast("long") for c in capacities])
    drawn = spark.range(1).select(F.col("id").alias("node"), caps.alias("quota"))
    for depth_here, level in enumerate(reversed(levels)):
        shares = deal(F.col("quota"), F.col("counts"), F.concat_ws("/", F.lit(seed), F.lit(depth_here), "node"))
        drawn = drawn.join(level, "node").select(F.explode(F.arrays_zip("names", shares.alias("share"))).alias("k"))
        drawn = drawn.select(F.col("k.names").alias("node"), F.col("k.share").alias("quota"))
        drawn = materialise(drawn, "matrix")
    return drawn.withColumnRenamed("node", "part")


def uniform_shards(rows: DataFrame, shards: int, id_col: str = "doc_id", payload: list[str] | None = None, seed: str = "shards") -> DataFrame:
    """Put every row into one of ``shards`` shards, as a uniform shuffle would, with sizes at most one row apart.

    Rows fall into local partitions by a hash of all their columns. Exact partition-to-shard counts are drawn first; a local
    permutation of each partition says which rows make up each count; after the exchange each shard is permuted
    again. The law is ``rows``: sizes are exact in rows. Result: ``payload`` columns (default: the id), ``law``,
    ``shard`` (from 0), ``slot`` (gapless from 0 within a shard). One row per input row; null ids and repeated rows
    are rows like others (only rows that are alike in all columns always share a local partition). Empty tables give an empty result,
    shards without rows none. Payload columns named like a result column are replaced. The same rows and seed
    give the same shards whatever their order, partitioning or payload, up to the order among identical rows.

    A local partition holds about ``PART_ROWS`` rows; a shard is never gathered: slots come from
    :func:`running_total`.
    """
    payload = [c for c in (payload if payload is not None else [id_col]) if c not in ("law", "shard", "slot")]
    # rows of one id, and rows without any, are spread by what else they hold, whatever of it is asked for; maps have no hash
    row = F.xxhash64(*[F.col(f"`{name}`") for name, kind in rows.dtypes if "map<" not in kind])
    base = rows.select(*[F.col(c).alias(f"p_{c}") for c in payload], F.col(id_col).alias("__id"), row.alias("__row"))
    base = base.withColumn("__key", spread_key(seed, F.col("__id"), F.col("__row")))
    total = base.count()
    parts = max(1, math.ceil(total / PART_ROWS))
    base = base.withColumn("part", F.floor(F.shiftrightunsigned("__key", 29).cast("double") * F.lit(parts / 2.0**31)).cast("long"))
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix(rows.sparkSession, base.groupBy("part").agg(F.count("*").alias("n")), parts, sizes, seed)

    ties = [f"p_{c}" for c in payload]
    local = Window.partitionBy("part").orderBy("__local", "__id", *ties)
    placed = base.join(matrix, "part").withColumn("__local", spread_key(seed + "-local", F.col("__id"), F.col("__row"))).withColumn("__rank", F.row_number().over(local))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("shard"))
    shard = F.aggregate("quota", zero, lambda s, q: F.struct((s["sum"] + q).alias("sum"), (s["shard"] + (s["sum"] + q < F.col("__rank")).cast("int")).alias("shard")), lambda s: s["shard"])
    placed = materialise(placed.select("__id", *ties, shard.alias("shard"), spread_key(seed + "-slot", F.col("__id"), F.col("__row")).alias("__slot")), "sharded")
    placed = running_total(placed, ["shard"], "__slot", ["__id", *ties], F.lit(1), "slot", total)
    return placed.select(*[F.col(f"p_{c}").alias(c) for c in payload], F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"))
