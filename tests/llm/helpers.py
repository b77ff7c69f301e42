"""Small tables with every awkward row: null ids, null, empty and blank texts, repeated rows, clashing columns."""

import pandas as pd

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, size string, score string, key string, `group` string"


def docs(spark, rows):
    """rows: (doc_id, text[, lang[, source]]); the other columns clash with names that operators use."""
    full = [(*r, *[None] * (4 - len(r)), 0, "x", "y", "z", "k", "g") for r in rows]
    return spark.createDataFrame(full, DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


def frame(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def given(name):
    return pd.read_parquet(f"/root/testdata/sf0.001/{name}.parquet")
