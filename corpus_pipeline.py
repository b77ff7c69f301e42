"""The corpus pipeline: language, exact copies, near copies, mixture, tokens. Each stage works on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.llm.common import materialise, sized_join
from tablecheck.llm.curriculum import curriculum, training_order
from tablecheck.llm.exact_dedup import exact_duplicates
from tablecheck.llm.language_crf import UNKNOWN, learn_languages, predict_languages
from tablecheck.llm.minhash import near_duplicates
from tablecheck.llm.sentencepiece_backend import encode_documents

#: A document stays when its language has at least this share of it: half, so that one language prevails.
LEAST_SCORE = 0.5


def set_aside(docs: DataFrame, needed: list) -> DataFrame:
    """The ``needed`` columns for an operator, and all columns under names that no operator uses."""
    return docs.select(*needed, *[F.col(f"`{c}`").alias(f"carried_{i}") for i, c in enumerate(docs.columns)])


def carried(docs: DataFrame) -> list[str]:
    return [f"carried_{i}" for i in range(len(docs.columns))]


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` that :func:`set_aside` carried, under their names."""
    return rows.select(*[F.col(f"carried_{i}").alias(c) for i, c in enumerate(docs.columns)])


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one prevailing language. Null or letterless texts, and texts in which no language has half, go.
    Where no language can be learned, all texts with a letter stay."""
    learned = learn_languages(docs)
    if learned is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    name = lambda c: f"carried_{docs.columns.index(c)}"
    judged = predict_languages(set_aside(docs, []), learned, id_col=name("doc_id"), text_col=name("text"), carry=carried(docs))
    return restored(judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (white space aside)."""
    return restored(exact_duplicates(set_aside(docs, ["doc_id", "text"]), payload=carried(docs)).filter("kept"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: of those with the smallest id (null last) the one with the smallest hash of
    its text, then any. Rows are told apart by id and text, not by id alone. Texts without a word all stay.

    Only the (id, hash) pairs of rows that go, or stay but are repeated, are joined.
    """
    key = F.xxhash64("text")
    classes = near_duplicates(docs, row_key=key)
    same_row = ["near_none", "near_id", "near_key"]
    parts = [F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0))]
    marks = classes.filter("n_shingles > 0").select(parts[0].alias("near_none"), parts[1].alias("near_id"), F.col("row_key").alias("near_key"), "kept")
    marks = marks.groupBy(*same_row).agg(F.max("kept").alias("near_kept"), F.count("*").alias("near_rows"))
    marks = materialise(marks.filter("not near_kept or near_rows > 1"), "near-copies")
    keyed = set_aside(docs, [p.alias(c) for p, c in zip([*parts, key], same_row, strict=True)])
    unmarked = sized_join(keyed, marks.select(*same_row), same_row, "left_anti")
    repeated = sized_join(keyed, materialise(marks.filter("near_kept").select(*same_row), "repeated-rows"), same_row, "left_semi")
    return restored(unmarked.unionByName(repeated.dropDuplicates(same_row)), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents as the curriculum takes them, in training order: repeated documents are repeated rows."""
    mixed = curriculum(set_aside(docs, ["doc_id", "text", "source"]), payload=carried(docs))
    return restored(training_order(mixed, [f"carried_{docs.columns.index('doc_id')}"]), docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_crc32``, ``parity``, ``round_trip`` and the ``ids``, one row per row."""
    return encode_documents(docs, with_ids=True)


STAGES = [
    ("language", keep_languages),
    ("exact_duplicates", drop_copies),
    ("near_duplicates", drop_near_copies),
    ("mixture", mix_sources),
    ("tokens", to_tokens),
]

#: Learned models and tokenizers are beyond SQL; the tests run the stages beside brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
