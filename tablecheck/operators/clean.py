"""Cleaning in a fixed order: names, trimming, null tokens, duplicates, sparse columns, imputation,
outliers.

Every step except dropping duplicates works row by row. What those steps need to know about the whole
table (which columns are sparse, fill values, outlier bounds) is learned in three aggregates that
return one row each; the learned plan is then applied as plain column expressions.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.functions import columns as C
from tablecheck.functions import text as X
from tablecheck.functions.columns import col, local_frame, measure
from tablecheck.functions.figures import clip
from tablecheck.operators import duplicates
from tablecheck.operators.duplicates import drop_duplicate_rows
from tablecheck.operators.frequency import modes
from tablecheck.operators.profile import Profile, iqr_bounds, outside, zscore_bounds
from tablecheck.operators.quantiles import exact_quantiles
from tablecheck.sources.storage import materialise

UNKNOWN = "unknown"


@dataclass(frozen=True)
class CleanOptions:
    trim_strings: bool = True
    replace_null_tokens: bool = True
    normalise_names: bool = True
    drop_duplicates: bool = True
    max_missing_pct: float = 100.0
    fill_numeric: str = "median"  # median, mean, zero; anything else leaves nulls
    fill_text: str = "mode"  # mode, unknown; anything else leaves nulls
    outliers: str = "none"  # none, cap, remove
    outlier_method: str = "iqr"  # iqr, zscore
    token_match: str = "exact"  # exact: all lower or all upper case; insensitive: any case


@dataclass
class CleanPlan:
    """What was learned from a table; applies row by row to any table of that shape."""

    options: CleanOptions
    dropped: list[str] = field(default_factory=list)
    fills: dict[str, float | str] = field(default_factory=dict)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        """All row-wise steps; rows beyond the bounds go if outliers are to be removed."""
        out = fill(prepare(df, self.options).drop(*self.dropped), self.fills)
        if self.options.outliers == "remove":
            return out.where(~self.is_outlier(out))
        return cap(out, self.bounds)

    def is_outlier(self, df: DataFrame) -> Column:
        test = F.lit(False)
        for c, (low, high) in self.bounds.items():
            test = test | outside(C.as_number(df, c), low, high)
        return test


@dataclass
class CleanResult:
    df: DataFrame
    report: dict
    plan: CleanPlan

    def report_frame(self) -> DataFrame:
        r = self.report
        kind = {int: "long", str: "string", list: "array<string>"}
        return local_frame(
            self.df.sparkSession, [tuple(r.values())], ", ".join(f"{k} {kind[type(v)]}" for k, v in r.items())
        )


# ── row-wise steps ─────────────────────────────────────────────────────────────────────────────


def normalised_names(names: list[str]) -> list[str]:
    """Lower-case snake case, unique and non-empty.

    A repeated name gets ``_1``, ``_2`` and so on until it is unused; a name without any letter or
    digit becomes ``col_<position>``.
    """
    out: list[str] = []
    for position, name in enumerate(names):
        base = re.sub(r"[^a-z0-9]+", "_", str(name).strip().lower()).strip("_") or f"col_{position}"
        candidate, n = base, 0
        while candidate in out:
            n += 1
            candidate = f"{base}_{n}"
        out.append(candidate)
    return out


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*normalised_names(df.columns))


def trim_text(df: DataFrame) -> DataFrame:
    text = C.names_of(df, C.TEXT)
    return df.withColumns({c: X.strip(col(c)) for c in text}) if text else df


def tokens_to_null(df: DataFrame, match: str = "exact") -> DataFrame:
    text = C.names_of(df, C.TEXT)
    if not text:
        return df
    return df.withColumns({c: F.when(~X.is_exact_null_token(col(c), match), col(c)) for c in text})


def prepare(df: DataFrame, options: CleanOptions) -> DataFrame:
    if options.normalise_names:  # first, by position: names may clash until then
        df = normalise_names(df)
    df = C.normalise_missing(df)
    if options.trim_strings:
        df = trim_text(df)
    if options.replace_null_tokens:
        df = tokens_to_null(df, options.token_match)
    return df


def fill(df: DataFrame, fills: dict[str, float | str]) -> DataFrame:
    """Numbers are widened to double where they are filled, so a fractional median fits."""
    if not fills:
        return df
    return df.withColumns(
        {c: F.coalesce(C.as_number(df, c) if not isinstance(v, str) else col(c), F.lit(v)) for c, v in fills.items()}
    )


def cap(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    if not bounds:
        return df
    return df.withColumns({c: clip(C.as_number(df, c), F.lit(lo), F.lit(hi)) for c, (lo, hi) in bounds.items()})


# ── steps that look at the whole table ─────────────────────────────────────────────────────────


@dataclass
class _Facts:
    """Row count, nulls per column and ``(non-null, min, max)`` per numeric column."""

    rows: int
    nulls: dict[str, int]
    bounds: dict[str, tuple[int, float, float]]

    @classmethod
    def of(cls, df: DataFrame) -> _Facts:
        numeric = C.names_of(df, C.NUMERIC)
        m = measure(
            df,
            {
                "rows": F.count("*"),
                **{(c, "n"): F.count(col(c)) for c in df.columns},
                **{(c, f.__name__): f(C.as_number(df, c)) for c in numeric for f in (F.min, F.max)},
            },
        )
        return cls(
            m["rows"],
            {c: m["rows"] - m[c, "n"] for c in df.columns},
            {c: (m[c, "n"], m[c, "min"], m[c, "max"]) for c in numeric},
        )

    def after(self, dropped: list[str], fills: dict[str, float | str]) -> _Facts:
        """The same facts once columns are dropped and nulls are filled, without looking again."""
        bounds = {}
        for c, (n, low, high) in self.bounds.items():
            if c in fills:
                seen = [x for x in (low, high, fills[c]) if x is not None]
                n, low, high = self.rows, min(seen), max(seen)
            bounds[c] = (n, low, high)
        return _Facts(
            self.rows,
            {c: 0 if c in fills else n for c, n in self.nulls.items() if c not in dropped},
            {c: b for c, b in bounds.items() if c not in dropped},
        )


def sparse_columns(rows: int, nulls: dict[str, int], max_missing_pct: float) -> list[str]:
    """Columns missing in more than the limit; none if that would be all of them."""
    if max_missing_pct >= 100.0 or rows == 0:
        return []
    found = [c for c, n in nulls.items() if 100.0 * n / rows > max_missing_pct]
    return found if len(found) < len(nulls) else []


def fill_values(df: DataFrame, facts: _Facts, numeric: str, text: str) -> dict[str, float | str]:
    """One value per column that has nulls; an all-null numeric column keeps them (except for zero)."""
    out: dict[str, float | str] = {}
    nulls = facts.nulls
    gaps = [c for c in C.names_of(df, C.NUMERIC) if nulls[c]]
    if gaps and numeric == "median":
        out |= {c: q[0] for c, q in exact_quantiles(df, {c: [0.5] for c in gaps}, facts.bounds).items() if q[0] is not None}
    elif gaps and numeric == "mean":
        means = {c: m["mean"] for c, m in C.by_column(df, {c: C.as_number(df, c) for c in gaps}, {"mean": F.avg("value")}).items()}
        out |= {c: m for c, m in means.items() if m is not None}
    elif numeric == "zero":
        out |= dict.fromkeys(gaps, 0.0)
    holes = [c for c in C.names_of(df, C.TEXT) if nulls[c]]
    if holes and text == "mode":
        found = {r["column"]: r["value"] for r in modes(df, holes).collect()}  # one row per column
        out |= {c: found.get(c, UNKNOWN) for c in holes}
    elif text == "unknown":
        out |= dict.fromkeys(holes, UNKNOWN)
    return out


def outlier_bounds(df: DataFrame, method: str, facts: _Facts) -> dict[str, tuple[float, float]]:
    """Bounds of every numeric column that has any spread, all from the same table."""
    numeric = C.names_of(df, C.NUMERIC)
    if not numeric:
        return {}
    if method == "zscore":
        m = C.by_column(df, {c: C.as_number(df, c) for c in numeric}, {"mean": F.avg("value"), "std": F.stddev_samp("value")})
        found = {c: zscore_bounds(m[c]) for c in numeric}
    else:
        q = exact_quantiles(df, {c: [0.25, 0.75] for c in numeric}, facts.bounds)
        found = {c: iqr_bounds({"q1": q[c][0], "q3": q[c][1]}) for c in numeric}
    return {c: b for c, b in found.items() if b[0] is not None}


def clean(df: DataFrame, options: CleanOptions | None = None, **changes) -> CleanResult:
    """Run the whole pipeline; ``changes`` override single options."""
    options = replace(options or CleanOptions(), **changes)
    before = list(df.columns)
    renamed = sum(a != b for a, b in zip(before, normalised_names(before))) if options.normalise_names else 0
    text = C.names_of(df, C.TEXT)
    plan = CleanPlan(options)

    ready = prepare(df, options)
    trimmed = prepare(df, replace(options, replace_null_tokens=False))
    converted = [
        X.is_exact_null_token(col(c), options.token_match)
        for c in (C.names_of(trimmed, C.TEXT) if options.replace_null_tokens else [])
    ]
    first = measure(trimmed, {"rows": F.count("*"), **{i: F.count_if(t) for i, t in enumerate(converted)}})
    rows_before = first.pop("rows")

    later = options.max_missing_pct < 100 or options.outliers != "none"
    later = later or options.fill_numeric in ("median", "mean", "zero") or options.fill_text in ("mode", "unknown")
    body = ready
    if options.drop_duplicates:
        body = drop_duplicate_rows(ready)
        if later and body is not ready:
            body = materialise(body, "deduplicated")
    facts = _Facts.of(body)

    plan.dropped = sparse_columns(facts.rows, facts.nulls, options.max_missing_pct)
    body, facts = body.drop(*plan.dropped), facts.after(plan.dropped, {})
    plan.fills = fill_values(body, facts, options.fill_numeric, options.fill_text)
    body, facts = fill(body, plan.fills), facts.after([], plan.fills)
    rows, nulls = facts.rows, facts.nulls

    removed = 0
    if options.outliers in ("cap", "remove"):
        bounds = outlier_bounds(body, options.outlier_method, facts)
        plan.bounds = bounds
        hit = plan.is_outlier(body)
        m = measure(
            body,
            {
                "removed": F.count_if(hit),
                **{("out", c): F.count_if(outside(C.as_number(body, c), *b)) for c, b in bounds.items()},
                **{("kept", c): F.count_if(~hit & col(c).isNull()) for c, n in nulls.items() if n},
            },
        )
        plan.bounds = {c: b for c, b in bounds.items() if m["out", c]}
        if options.outliers == "remove":
            removed = m["removed"]
            nulls = {c: m["kept", c] if n else 0 for c, n in nulls.items()}
            body = body.where(~plan.is_outlier(body)) if removed else body
        else:
            body = cap(body, plan.bounds)

    report = {
        "rows_before": rows_before,
        "columns_before": len(before),
        "columns_renamed": renamed,
        "trimmed_text_columns": len(text) if options.trim_strings else 0,
        "null_tokens_converted": sum(first.values()),
        "dropped_duplicate_rows": rows_before - rows,
        "dropped_sparse_columns": plan.dropped,
        "numeric_fill": options.fill_numeric,
        "text_fill": options.fill_text,
        "outlier_treatment": options.outliers,
        "outlier_method": options.outlier_method,
        "capped_columns": list(plan.bounds) if options.outliers == "cap" else [],
        "outlier_rows_removed": removed,
        "rows_after": rows - removed,
        "columns_after": len(body.columns),
        "missing_cells_after": sum(nulls.values()),
    }
    return CleanResult(body, report, plan)


# ── around the pipeline ────────────────────────────────────────────────────────────────────────


def recommended_options(p: Profile) -> CleanOptions:
    """Options that treat exactly what a profile found."""
    p.gather("duplicate_rows", "text_figures", "numeric_figures")
    missing = p.missing_cells > 0
    return CleanOptions(
        trim_strings=True,
        replace_null_tokens=bool(p.placeholder_rows()),
        normalise_names=True,
        drop_duplicates=p.duplicate_rows > 0,
        max_missing_pct=70.0 if missing else 100.0,
        fill_numeric="median" if missing else "none",
        fill_text="mode" if missing else "none",
        outliers="cap" if p.outlier_rows() else "none",
        outlier_method="iqr",
    )


def options_frame(p: Profile) -> DataFrame:
    rows = [(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in asdict(recommended_options(p)).items()]
    return local_frame(p.spark, rows, "option string, value string")


def change_log(before: DataFrame, plan: CleanPlan, keys: list[str]) -> DataFrame:
    """Every cell cleaning changes: ``(keys, column, before, after)``.

    The plan is applied next to the original cells in the same row, so nothing is joined or shuffled
    and a removed row cannot shift the comparison.
    """
    named, new_keys = before, keys
    if plan.options.normalise_names:
        to = dict(zip(before.columns, normalised_names(before.columns)))
        named, new_keys = normalise_names(before), [to[k] for k in keys]
    named = C.normalise_missing(named)
    old = F.struct(*[col(c).cast("string").alias(c) for c in named.columns]).alias("__old")
    row_wise = replace(
        plan,
        options=replace(
            plan.options, normalise_names=False, outliers="cap" if plan.options.outliers == "cap" else "none"
        ),
        bounds=plan.bounds if plan.options.outliers == "cap" else {},
    )
    after = row_wise.apply(named.select("*", old))
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("__old").getField(c).alias("before"),
            col(c).cast("string").alias("after"),
            _same(named, after, c).alias("same"),
        )
        for c in after.columns
        if c != "__old"
    ]
    ids = [F.col("__old").getField(k).cast(named.schema[k].dataType).alias(k) for k in new_keys]
    rows = after.select(*ids, F.explode(F.array(*cells)).alias("x")).where("not x.same")
    return rows.select(*[col(k) for k in new_keys], "x.column", "x.before", "x.after")


def removed_rows(before: DataFrame, plan: CleanPlan) -> DataFrame:
    """Rows that have no row of their own behind cleaning: the columns, ``copies`` and ``reason``.

    Tables without a key are aligned as multisets of rows, as they are compared (names, trimming and null tokens done, before
    anything is filled): ``duplicate`` rows are further copies of a row that stays, ``outlier`` rows went beyond the bounds.
    Only rows whose hash repeats are shuffled for the first, and only outliers for the second kind.
    """
    ready = prepare(before, plan.options)
    columns = ready.columns
    out = duplicates.repeated_rows(ready, "__copies") if plan.options.drop_duplicates else ready.limit(0).withColumn("__copies", F.lit(0).cast("long"))
    out = out.withColumn("__reason", F.lit("duplicate"))
    if plan.options.outliers == "remove":
        rows = duplicates.drop_duplicate_rows(ready) if plan.options.drop_duplicates else ready
        whole = rows.select(*[col(c) for c in columns if c not in plan.dropped], F.struct(*[col(c) for c in columns]).alias("__row"))
        filled = fill(whole, plan.fills)
        gone = filled.where(plan.is_outlier(filled)).groupBy("__row").agg(F.count("*").alias("__copies"))
        out = out.unionByName(gone.select("__row.*", "__copies").withColumn("__reason", F.lit("outlier")))
    return out.select(*[col(c) for c in columns], F.col("__copies").alias("copies"), F.col("__reason").alias("reason"))


def _same(before: DataFrame, after: DataFrame, c: str) -> Column:
    """Equal cells; widening an integer to double is no change."""
    old = F.col("__old").getField(c)
    if C.class_of(before.schema[c].dataType) == C.NUMERIC:
        return C.as_number(after, c).eqNullSafe(old.cast("double"))
    return col(c).cast("string").eqNullSafe(old)
