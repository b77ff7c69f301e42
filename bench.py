"""Time the headline queries in a warm session; prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)

Each query runs once untimed (class loading, code generation) and once timed; the first run's time is
reported beside it under "first_run".
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "summary", "column_profile", "placeholder_table", "type_suggestions", "outlier_table", "outlier_table_lineitem",
    "patterns_contacts", "cardinality_lineitem", "duplicate_rows_lineitem", "functional_deps", "near_dup_values",
    "score_presets", "issues", "clean_dedup", "cap_iqr", "remove_iqr_lineitem", "change_log", "describe", "histogram",
    "boxplot", "group_mean", "group_median", "group_median_customer", "resample_day", "resample_month", "correlation",
    "scatter_bins", "top_n", "numeric_drift", "psi", "drift_histogram", "csv_round_trip", "export_tables",
    "profile_documents", "functional_deps_wide", "date_shapes",
]


def session(cpus: str) -> SparkSession:
    scratch = tempfile.mkdtemp(prefix="tablecheck-bench-")
    atexit.register(shutil.rmtree, scratch, ignore_errors=True)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablecheck-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", scratch)
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    from tablecheck.plans.queries import QUERIES

    names = sys.argv[1:] or HEADLINE
    first, times = {}, {}
    for name in names:
        for runs in (first, times):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).collect()
            runs[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {first[name]} {times[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "first_run": first,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
