"""Profile of one table: every diagnostic figure, each measured once and only when asked for.

What returns to the driver is bounded by the number of columns, never by rows: one row per column
from a grouped aggregate, or a one-row aggregate. The result tables are built from those figures.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.functions import columns as C
from tablecheck.functions import text as X
from tablecheck.functions.columns import col, local_frame, measure
from tablecheck.functions.figures import percent_of, round_half_up
from tablecheck.operators import dependencies, duplicates, neardup
from tablecheck.operators.frequency import distinct_counts
from tablecheck.operators.quantiles import exact_quantiles
from tablecheck.sources.storage import materialise

_WIDTHS = {
    T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4,
    T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16,
}


class Profile:
    """Lazy collection of per-column figures of ``df``.

    ``approx_distinct`` counts distinct values by sketch; ``fd_max_pairs`` is an optional budget of column
    pairs for dependencies (by default all are checked) and ``fd_sample`` an optional share (float) or number (int) of rows to check
    them on, a number by a hash of the columns ``fd_sample_by`` (all), whatever the partitioning (candidates are chosen on
    the full table, and by default so is the check); ``near_dup_columns`` limits the near-duplicate search,
    by default every text column takes part.
    """

    def __init__(
        self,
        df: DataFrame,
        *,
        approx_distinct: bool = False,
        fd_max_pairs: int | None = None,
        fd_sample: float | int | None = None,
        fd_sample_by: list[str] | None = None,
        near_dup_threshold: float = 80.0,
        near_dup_columns: list[str] | None = None,
    ):
        self.spark = df.sparkSession
        self.df = C.normalise_missing(df)
        self.columns = list(df.columns)
        self.types = C.type_names(df)
        self.classes = {f.name: C.class_of(f.dataType) for f in df.schema.fields}
        self.text = [c for c in self.columns if self.classes[c] == C.TEXT]
        self.numeric = [c for c in self.columns if self.classes[c] == C.NUMERIC]
        self.approx_distinct = approx_distinct
        self.fd_max_pairs, self.fd_sample, self.fd_sample_by = fd_max_pairs, fd_sample, fd_sample_by
        self.near_dup_threshold = near_dup_threshold
        self.near_dup_columns = self.text if near_dup_columns is None else near_dup_columns

    def gather(self, *figures: str) -> Profile:
        """Measure several independent figures at once, so that their jobs share the cluster."""
        todo = [f for f in figures if f not in self.__dict__]
        if not self.empty and len(todo) > 1:
            with ThreadPoolExecutor(len(todo)) as pool:
                list(pool.map(lambda f: getattr(self, f), todo))
        return self

    # ── figures ────────────────────────────────────────────────────────────────────────────

    @cached_property
    def empty(self) -> bool:
        return not self.columns or self.rows == 0

    @property
    def error(self) -> str | None:
        return "The table has no rows or no columns." if self.empty else None

    @property
    def rows(self) -> int:
        return self._basics[0]

    @cached_property
    def _basics(self) -> tuple[int, dict[str, tuple[int, bool, int]]]:
        """Row count and, per column, (non-null, constant, bytes): one scan, nothing shuffled."""
        if not self.columns:
            return 0, {}
        cells = {}
        for c in self.columns:
            nested = self.classes[c] == C.NESTED
            v = F.to_json(F.struct(col(c))) if nested else col(c)
            size = F.octet_length(v) if nested or self.classes[c] == C.TEXT else F.lit(0)
            cells[c] = F.struct(F.when(col(c).isNotNull(), F.xxhash64(v)).alias("h"), size.cast("long").alias("bytes"))
        m = C.by_column(self.df, cells, {"rows": F.count("*"), "n": F.count("value.h"), "low": F.min("value.h"), "high": F.max("value.h"), "bytes": F.sum("value.bytes")})
        rows, out = next(iter(m.values()))["rows"], {}
        # One hash in all rows all but proves one value; the few columns with it are looked at again.
        alike = [c for c in self.columns if 0 < m[c]["n"] == rows and m[c]["low"] == m[c]["high"]]
        same = measure(self.df, {c: F.min(v) == F.max(v) for c in alike for v in [F.to_json(F.struct(col(c))) if self.classes[c] == C.NESTED else col(c)]}) if alike else {}
        for c in self.columns:
            n = m[c]["n"]
            # Null counts as a value here: all-null is constant, one value plus nulls is not.
            constant = n == 0 or bool(same.get(c))
            width = _WIDTHS.get(type(self.df.schema[c].dataType), 0)
            out[c] = (n, constant, (m[c]["bytes"] or 0) + width * rows)
        return rows, out

    def non_null(self, c: str) -> int:
        return self._basics[1][c][0]

    def missing(self, c: str) -> int:
        return self.rows - self.non_null(c)

    @property
    def missing_cells(self) -> int:
        return sum(self.missing(c) for c in self.columns)

    @property
    def constant_columns(self) -> list[str]:
        return [] if self.empty else [c for c in self.columns if self._basics[1][c][1]]

    @property
    def footprint_bytes(self) -> int:
        return sum(b for _, _, b in self._basics[1].values())

    @cached_property
    def duplicate_rows(self) -> int:
        return 0 if self.empty else duplicates.duplicate_rows(self.df)

    @cached_property
    def distinct(self) -> dict[str, int]:
        """Distinct non-null values per column."""
        out = dict.fromkeys(self.columns, 0)
        if self.columns:
            for r in distinct_counts(self.df, self.columns, self.approx_distinct).collect():
                out[r["column"]] = r["distinct"]
        return out

    @cached_property
    def text_figures(self) -> dict[str, dict[str, int]]:
        """Per text column: cells that are null tokens, numbers, dates, or match a pattern.

        One scan; every task sends one row of counters per column.
        """
        if not self.text:
            return {}
        cells = C.long_form(self.df, {c: col(c) for c in self.text}).where("value is not null")
        s = F.col("s")
        aggs = {
            "tokens": F.lower(s).isin(X.NULL_TOKENS),
            "numbers": X.is_number(s),
            "dates": X.parse_datetime(s).isNotNull(),
            **{f"is_{name}": s.rlike(regex) for name, regex in X.PATTERNS.items()},
        }
        rows = (
            cells.select("column", X.strip(F.col("value")).alias("s"))
            .groupBy("column")
            .agg(*[F.count_if(test).alias(name) for name, test in aggs.items()])
            .collect()
        )
        found = {r["column"]: r.asDict() for r in rows}
        return {c: found.get(c, dict.fromkeys(aggs, 0)) for c in self.text}

    @cached_property
    def numeric_figures(self) -> dict[str, dict[str, float]]:
        """Per numeric column: count, min, max, mean, std, quartiles and outlier counts."""
        if not self.numeric:
            return {}
        v = {c: C.as_number(self.df, c) for c in self.numeric}
        moments = {"n": F.count, "min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp}
        out = C.by_column(self.df, v, {k: f("value") for k, f in moments.items()})
        quartiles = exact_quantiles(
            self.df, {c: [0.25, 0.5, 0.75] for c in v}, {c: (d["n"], d["min"], d["max"]) for c, d in out.items()}
        )
        tests: dict = {}
        for c, d in out.items():
            d["q1"], d["median"], d["q3"] = quartiles[c]
            d["low"], d["high"] = iqr_bounds(d)
            tests[c] = F.struct(outside(v[c], d["low"], d["high"]).alias("iqr"), outside(v[c], *zscore_bounds(d)).alias("zscore"))
        for c, counts in C.by_column(self.df, tests, {f"{k}_outliers": F.count_if(f"value.{k}") for k in ("iqr", "zscore")}).items():
            out[c] |= counts
        return out

    # ── result tables ──────────────────────────────────────────────────────────────────────

    def _table(self, rows: list[tuple], schema: str) -> DataFrame:
        return local_frame(self.spark, [] if self.empty else rows, schema)

    def summary_values(self) -> dict:
        if self.empty:
            return {
                "rows": 0, "columns": 0, "missing_cells": 0, "missing_cells_pct": 0.0, "duplicate_rows": 0,
                "duplicate_rows_pct": 0.0, "footprint_mb": 0.0, "constant_columns": 0,
            }
        cells = self.rows * len(self.columns)
        return {
            "rows": self.rows,
            "columns": len(self.columns),
            "missing_cells": self.missing_cells,
            "missing_cells_pct": percent_of(self.missing_cells, cells),
            "duplicate_rows": self.duplicate_rows,
            "duplicate_rows_pct": percent_of(self.duplicate_rows, self.rows),
            "footprint_mb": round_half_up(self.footprint_bytes / 1024**2, 3),
            "constant_columns": len(self.constant_columns),
        }

    def summary(self) -> DataFrame:
        return local_frame(
            self.spark,
            [tuple(self.summary_values().values())],
            "rows long, columns long, missing_cells long, missing_cells_pct double, duplicate_rows long, "
            "duplicate_rows_pct double, footprint_mb double, constant_columns long",
        )

    def missing_rows(self) -> list[tuple]:
        if self.empty:
            return []
        rows = [(c, self.missing(c), percent_of(self.missing(c), self.rows)) for c in self.columns]
        return sorted((r for r in rows if r[1] > 0), key=lambda r: -r[1])

    def missing_table(self) -> DataFrame:
        return self._table(self.missing_rows(), "column string, missing_count long, missing_pct double")

    def column_profile(self) -> DataFrame:
        rows = [] if self.empty else [
            (
                c, self.types[c], self.non_null(c), self.missing(c), percent_of(self.missing(c), self.rows),
                self.distinct[c], self._basics[1][c][1],
            )
            for c in self.columns
        ]
        return self._table(
            rows,
            "column string, dtype string, non_null long, missing_count long, missing_pct double, "
            "unique long, constant boolean",
        )

    def constant_table(self) -> DataFrame:
        return self._table([(c,) for c in self.constant_columns], "column string")

    def placeholder_rows(self) -> list[tuple]:
        if self.empty:
            return []
        counts = [(c, self.text_figures[c]["tokens"]) for c in self.text]
        return [(c, n, percent_of(n, self.rows)) for c, n in counts if n > 0]

    def placeholder_table(self) -> DataFrame:
        return self._table(
            self.placeholder_rows(),
            "column string, placeholder_missing_count long, placeholder_missing_pct double",
        )

    def suggestion_rows(self) -> list[tuple]:
        rows = []
        for c in [] if self.empty else self.text:
            n = self.non_null(c)
            if n == 0:
                continue
            number, date = (self.text_figures[c][k] / n for k in ("numbers", "dates"))
            if number >= 0.8 and number >= date:
                rows.append((c, self.types[c], "numeric", round_half_up(100.0 * number, 2)))
            elif date >= 0.8:
                rows.append((c, self.types[c], "datetime", round_half_up(100.0 * date, 2)))
        return rows

    def type_suggestions(self) -> DataFrame:
        return self._table(
            self.suggestion_rows(),
            "column string, current_dtype string, suggested_type string, confidence_pct double",
        )

    def outlier_rows(self) -> list[tuple]:
        rows = []
        for c in [] if self.empty else self.numeric:
            iqr, z = (self.numeric_figures[c][k] for k in ("iqr_outliers", "zscore_outliers"))
            if iqr > 0 or z > 0:
                rows.append((c, iqr, percent_of(iqr, self.rows), z, percent_of(z, self.rows)))
        return rows

    def outlier_table(self) -> DataFrame:
        return self._table(
            self.outlier_rows(),
            "column string, outlier_count_iqr long, outlier_pct_iqr double, "
            "outlier_count_zscore long, outlier_pct_zscore double",
        )

    @cached_property
    def _patterns(self) -> list[tuple]:
        found = []
        for c in [] if self.empty else self.text:
            n = self.non_null(c)
            for name in X.PATTERNS if n else ():
                share = 100.0 * self.text_figures[c][f"is_{name}"] / n
                if share >= 60.0:
                    found.append((c, name, round_half_up(share, 1)))
                    break
        if not found:
            return []
        # Ungrouped minima stream through each task; no sort and one row per task.
        samples = measure(self.df, {c: F.min(X.strip(col(c))) for c, _, _ in found})
        return [(*f, samples[f[0]]) for f in found]

    def pattern_rows(self) -> list[tuple]:
        return self._patterns

    def pattern_table(self) -> DataFrame:
        return self._table(self._patterns, "column string, pattern string, match_pct double, sample string")

    def cardinality_rows(self) -> list[tuple]:
        rows = []
        for c in [] if self.empty else self.columns:
            n = self.non_null(c)
            if n <= 10:
                continue
            d = self.distinct[c]
            share = round_half_up(100.0 * d / n, 1)
            if self.classes[c] == C.TEXT:
                if share > 90.0:
                    rows.append((c, d, share, "high cardinality (possible id/key)"))
            elif d <= 5:
                rows.append((c, d, share, "low cardinality (possible coded category)"))
        return rows

    def cardinality_table(self) -> DataFrame:
        return self._table(
            self.cardinality_rows(), "column string, unique_values long, unique_pct double, flag string"
        )

    @cached_property
    def _near_dups(self) -> list[tuple]:
        if self.empty:
            return []
        table = neardup.near_duplicate_values(self.df, self.near_dup_columns, threshold=self.near_dup_threshold)
        rank = {c: i for i, c in enumerate(self.columns)}
        rows = [tuple(r) for r in table.collect()]  # at most three pairs per column
        return sorted(rows, key=lambda r: (rank[r[0]], -r[3], r[1], r[2]))

    def near_dup_rows(self) -> list[tuple]:
        return self._near_dups

    def near_dup_table(self) -> DataFrame:
        return self._table(self._near_dups, "column string, value_1 string, value_2 string, similarity_pct double")

    @cached_property
    def _dependencies(self) -> list[tuple]:
        if self.empty:
            return []
        df = self.df
        if self.fd_sample is not None:
            df = materialise(dependencies.sampled_rows(df, self.fd_sample, self.fd_sample_by), "sample")
        return dependencies.functional_dependencies(df, self.rows, self.distinct, self.fd_max_pairs)

    def functional_deps(self) -> DataFrame:
        return self._table(self._dependencies, "determinant string, dependent string, groups_checked long")


def iqr_bounds(d: dict) -> tuple[float | None, float | None]:
    """Tukey fences, or nothing when the quartiles coincide."""
    if d["q1"] is None or not d["q3"] - d["q1"] > 0:
        return None, None
    iqr = d["q3"] - d["q1"]
    return d["q1"] - 1.5 * iqr, d["q3"] + 1.5 * iqr


def zscore_bounds(d: dict) -> tuple[float | None, float | None]:
    """Three sample standard deviations around the mean."""
    if not d["std"] or math.isnan(d["std"]):  # no spread, one row, or infinite values
        return None, None
    return d["mean"] - 3.0 * d["std"], d["mean"] + 3.0 * d["std"]


def outside(v: Column, low: float | None, high: float | None) -> Column:
    if low is None:
        return F.lit(False)
    return F.coalesce((v < low) | (v > high), F.lit(False))
