"""Exact duplicates by progressive refinement: length, then a hash of the first characters, then the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.common import BLANKS, materialise, sized_join


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", payload: list[str] | None = None, prefix: int = 64, digest: bool = False) -> DataFrame:
    """Mark every row of ``docs`` with the row of its group that stays.

    Texts are equal when they are identical after deleting ASCII white space. Of equal texts the one with the
    most code points in its original form stays, then the smallest id (null ids last), then one of the
    repeated rows. Each level looks only at what the level before has left:

    1. one pass over the texts keeps, for each row, the length without blanks and a hash of the first
       ``prefix`` characters; lengths that occur once drop out;
    2. among those, (length, prefix hash) pairs that occur once drop out;
    3. only rows of surviving pairs are read in full and hashed (SHA-256), and grouped by that hash.

    ``digest`` also hashes the other rows, for callers that want the digest of every text.

    Result: ``payload`` columns (default: the id), ``keep_id``, ``group_size``, ``kept``, ``text_sha256``
    (null for rows never read in full). One row per input row. Null text counts as empty, so null, empty and
    blank texts are equal; long texts are hashed whole; an empty table gives an empty result. Columns that are
    neither id, text nor payload are ignored, whatever their names; a payload column with the name of a result
    column is replaced by the result.

    Groups are merged map-side (count and least row), so copies that make up a third of the table cost one
    record per task; the join back can be split by adaptive execution, or is a counted broadcast.
    """
    own = {"keep_id", "group_size", "kept", "text_sha256"}
    payload = [c for c in (payload if payload is not None else [id_col]) if c not in own]
    bare = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{BLANKS}+", "")
    rows = docs.select(
        *[F.col(c).alias(f"p_{c}") for c in payload], F.col(id_col).alias("__id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("__points"), bare.alias("__bare"),
    )
    rows = rows.withColumn("__len", F.char_length("__bare")).withColumn("__head", F.xxhash64(F.substring("__bare", 1, prefix)))

    first = materialise(rows.groupBy("__len", "__head").agg(F.count("*").alias("__rows")), "lengths")
    repeated_len = materialise(first.groupBy("__len").agg(F.sum("__rows").alias("n")).filter("n > 1").select("__len"), "repeated-lengths")
    open_pairs = sized_join(first.filter("__rows > 1"), repeated_len, ["__len"], "left_semi")
    open_pairs = materialise(open_pairs.select("__len", "__head", F.lit(True).alias("__open")), "repeated-heads")

    read = sized_join(rows, open_pairs, ["__len", "__head"], "left")
    whole = F.lit(True) if digest else F.col("__open")
    read = read.select(
        *[f"p_{c}" for c in payload], "__id", "__points", F.coalesce("__open", F.lit(False)).alias("__open"),
        F.when(whole, F.sha2(F.col("__bare"), 256)).alias("text_sha256"),
        F.monotonically_increasing_id().alias("__row"),
    )
    read = materialise(read, "hashed")  # also fixes the row numbers

    order = F.struct((-F.col("__points")).alias("p"), F.col("__id").isNull().alias("n"), F.col("__id").alias("i"), F.col("__row").alias("r"))
    groups = read.filter("__open").groupBy("text_sha256").agg(F.min(order).alias("__stays"), F.count("*").alias("group_size"))
    groups = materialise(groups.filter("group_size > 1"), "copies")
    marked = sized_join(read.filter("__open"), groups, ["text_sha256"], "left")
    single = read.filter("not __open").withColumns({"__stays": F.lit(None).cast(groups.schema["__stays"].dataType), "group_size": F.lit(None).cast("long")})
    both = marked.select(*single.columns).unionByName(single)
    alone = F.col("group_size").isNull()
    return both.select(
        *[F.col(f"p_{c}").alias(c) for c in payload],
        F.when(alone, F.col("__id")).otherwise(F.col("__stays.i")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, F.lit(True)).otherwise(F.col("__row") == F.col("__stays.r")).alias("kept"),
        "text_sha256",
    )
