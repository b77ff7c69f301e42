"""Run every registered query next to its SQL text on DuckDB and report differences.

    python tests/check_oracles.py [sf dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

from tablecheck.plans.queries import ORACLES, QUERIES
from tablecheck.plans.views import TABLES


def cell(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def compare(spark, con, sf: str, name: str) -> str | None:
    df = QUERIES[name](spark, sf)
    got = df.collect()
    if name not in ORACLES:
        return None
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want.fetchall())
    if a != b:
        only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{len(a)} vs {len(b)} rows; only Spark {only_a}; only SQL {only_b}"
    return None


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for name in sys.argv[2:] or QUERIES:
        t = time.time()
        try:
            problem = compare(spark, con, sf, name)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {time.time() - t:6.2f}s {'' if name in ORACLES else '(rows only)'} {problem or ''}", flush=True)
    print(f"{bad} problems")
