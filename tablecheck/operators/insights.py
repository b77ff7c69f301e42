"""Descriptive and BI aggregations over one table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.functions import columns as C
from tablecheck.functions import text as X
from tablecheck.functions.columns import col, local_frame, measure
from tablecheck.functions.figures import sample_kurtosis, sample_skewness
from tablecheck.operators.comoments import co_moments
from tablecheck.operators.profile import Profile, iqr_bounds
from tablecheck.operators.quantiles import exact_quantiles, group_quantile, numeric_bounds

# A column whose name contains one of these may hold dates.
DATE_NAME_PARTS = ["data", "date", "dt", "mes", "ano", "year", "month", "dia", "day", "periodo", "cadastro"]
HISTOGRAM_BINS = 30  # fixed value

AGGREGATES = ("mean", "sum", "count", "median", "max", "min")

# ── choice of columns ──────────────────────────────────────────────────────────────────────────


def analysable_columns(p: Profile) -> list[str]:
    """Numeric, not constant, and not unique in more than 95 % of the rows."""
    found = []
    for c in p.numeric if not p.empty else []:
        f = p.numeric_figures[c]
        if f["n"] and f["std"] != 0 and p.distinct[c] / p.rows <= 0.95:
            found.append(c)
    return found


def grouping_columns(p: Profile) -> list[str]:
    """Text with 2 to 25 distinct values."""
    return [c for c in p.text if 2 <= p.distinct[c] <= 25]


def date_columns(p: Profile) -> list[str]:
    """Columns suggested as dates, then columns named like dates all of whose cells parse.

    Text cells are in the profile's counters; other columns are counted together in one scan.
    """
    found = [c for c, _, kind, _ in p.suggestion_rows() if kind == "datetime"]
    named = [c for c in p.columns if c not in found and p.classes[c] != C.NESTED and any(part in c.lower() for part in DATE_NAME_PARTS)]
    others = [c for c in named if p.classes[c] not in (C.DATETIME, C.TEXT)]
    parse = {c: X.parse_datetime(X.strip(col(c).cast("string"))) for c in others}
    bad = measure(p.df, {c: F.count_if(col(c).isNotNull() & date.isNull()) for c, date in parse.items()}) if others else {}
    bad |= {c: p.non_null(c) - p.text_figures[c]["dates"] for c in named if p.classes[c] == C.TEXT and not p.empty}
    return found + [c for c in named if not bad.get(c)]


def column_choice(p: Profile) -> DataFrame:
    rows = [(c, "metric") for c in analysable_columns(p)]
    rows += [(c, "group") for c in grouping_columns(p)]
    rows += [(c, "date") for c in date_columns(p)]
    return local_frame(p.spark, rows, "column string, role string")


def kpi_columns(p: Profile, most: int | None = None) -> list[str]:
    """The analysable columns, or all numeric ones if there is none; at most ``most`` if that is given."""
    return (analysable_columns(p) or p.numeric)[:most]


def display_columns(p: Profile, rank_by: str, groups: int | None = None, metrics: int | None = None) -> list[str]:
    """The ranked column, the grouping columns and the analysable ones other than it; at most ``groups`` and
    ``metrics`` of them (the first) if these are given."""
    others = [c for c in analysable_columns(p)[:metrics] if c != rank_by]
    return list(dict.fromkeys([rank_by, *grouping_columns(p)[:groups], *others]))


# ── statistics ─────────────────────────────────────────────────────────────────────────────────


def kpis(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, mean, median, min, max, std)``."""
    return describe(df, columns).select("column", "mean", "median", "min", "max", "std")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, quartiles, mean, std and bias-corrected skewness and excess kurtosis per column."""
    df = C.normalise_missing(df)
    fs = (F.count, F.min, F.max, F.avg, F.stddev_samp, F.skewness, F.kurtosis)
    m = C.by_column(df, {c: C.as_number(df, c) for c in columns}, {f.__name__: f("value") for f in fs})
    figures = {c: list(m[c].values()) for c in columns}
    q = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns}, {c: tuple(f[:3]) for c, f in figures.items()})
    rows = [(c, *figures[c], *q[c]) for c in columns]
    t = local_frame(
        df.sparkSession, rows,
        "column string, count long, min double, max double, mean double, std double, g1 double, g2 double, "
        "q1 double, median double, q3 double",
    )
    # A constant column has no shape of its own; report 0 as for any symmetric one.
    g1, g2 = (F.when(F.col("std") == 0, F.lit(0.0)).otherwise(F.col(g)) for g in ("g1", "g2"))
    skew, kurt = sample_skewness(g1, F.col("count")), sample_kurtosis(g2, F.col("count"))
    return t.select(
        "column", "count", "min", "q1", "median", "mean", "q3", "max", "std",
        F.when((F.col("std") == 0) & (F.col("count") >= 3), 0.0).otherwise(skew).alias("skewness"),
        F.when((F.col("std") == 0) & (F.col("count") >= 4), 0.0).otherwise(kurt).alias("kurtosis"),
    )


def bin_number(v: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin 1..bins; the largest value belongs to the last bin."""
    if not low < high:
        return F.lit(1)
    return F.least(F.floor((v - F.lit(low)) / F.lit((high - low) / bins)) + 1, F.lit(bins)).cast("int")


def bin_edges(number: Column, low: float, high: float, bins: int) -> tuple[Column, Column]:
    width = (high - low) / bins
    return (
        F.round(F.lit(low) + (number - 1) * width, 6).alias("low"),
        F.round(F.lit(low) + number * width, 6).alias("high"),
    )


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``(bin, low, high, n)`` for bins that hold values."""
    df = df.select(C.finite(C.as_number(C.normalise_missing(df), column)).alias(column))
    n, low, high = numeric_bounds(df, [column])[column]
    if not n:
        return local_frame(df.sparkSession, [], "bin int, low double, high double, n long")
    v = C.as_number(df, column)
    counts = df.where(v.isNotNull()).groupBy(bin_number(v, low, high, bins).alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("bin", *bin_edges(F.col("bin"), low, high, bins), "n")


def boxplot(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles, whiskers (last values inside the fences) and the number of points beyond."""
    df = C.normalise_missing(df)
    bounds = numeric_bounds(df, columns)
    q = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns}, bounds)
    figures = {}
    for c in columns:
        v = C.as_number(df, c)
        low, high = iqr_bounds({"q1": q[c][0], "q3": q[c][2]})
        inside = F.lit(True) if low is None else v.between(low, high)
        figures[c] = F.struct(v.alias("v"), inside.alias("inside"))
    v, inside = F.col("value.v"), F.col("value.inside")
    m = C.by_column(df, figures, {"low": F.min(F.when(inside, v)), "high": F.max(F.when(inside, v)), "beyond": F.count_if(v.isNotNull() & ~inside)})
    rows = [(c, m[c]["low"], *q[c], m[c]["high"], m[c]["beyond"]) for c in columns]
    return local_frame(
        df.sparkSession, rows,
        "column string, whisker_low double, q1 double, median double, q3 double, whisker_high double, beyond long",
    )


def group_aggregate(df: DataFrame, by: str, metric: str, how: str) -> DataFrame:
    """``(by, value)`` sorted by value; rows without a group are left out."""
    df = C.normalise_missing(df)
    if how == "median":
        out = group_quantile(df, by, metric, 0.5, "value")
    else:
        m = C.as_number(df, metric)
        agg = {
            "mean": lambda: F.avg(m),
            "sum": lambda: F.coalesce(F.sum(m), F.lit(0.0)),
            "count": lambda: F.count(m),
            "max": lambda: F.max(m),
            "min": lambda: F.min(m),
        }[how]()
        out = df.where(col(by).isNotNull()).groupBy(col(by).alias(by)).agg(agg.alias("value"))
    return out.orderBy(F.asc_nulls_last("value"), col(by))


def resample(df: DataFrame, date: str, metric: str, how: str = "mean", every: str | None = None) -> DataFrame:
    """``(bucket, value)`` per day, week (labelled by its Sunday) or month (by its last day).

    Without ``every`` the range decides: over 60 days months, over 14 weeks, else days. Buckets
    without rows are kept: null for a mean, 0 for a sum or a count.
    """
    df = C.normalise_missing(df)
    is_text = C.class_of(df.schema[date].dataType) == C.TEXT
    at = X.parse_datetime(X.strip(col(date))) if is_text else col(date).cast("timestamp")
    rows = df.select(at.alias("at"), C.as_number(df, metric).alias("v")).where("at is not null")
    first, last = rows.agg(F.min("at"), F.max("at")).first()
    if first is None:
        return local_frame(df.sparkSession, [], f"bucket date, value {'long' if how == 'count' else 'double'}")
    every = every or resample_step((last - first).days)
    label = {
        "day": lambda d: F.to_date(d),
        "week": lambda d: F.date_add(F.to_date(F.date_trunc("week", d)), 6),
        "month": lambda d: F.last_day(F.to_date(d)),
    }[every]
    agg = {"mean": F.avg("v"), "sum": F.sum("v"), "count": F.count("v")}[how]
    filled = rows.groupBy(label(F.col("at")).alias("bucket")).agg(agg.alias("value"))
    # Between the years 1678 and 2262 there are at most 214 000 days, so the calendar is small.
    step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[every]
    start, end = (x.replace(day=1) if every == "month" else x for x in (first.date(), last.date()))
    ends = [label(F.lit(x)) if every == "week" else F.lit(x) for x in (start, end)]
    days = df.sparkSession.range(1).select(F.explode(F.sequence(*ends, F.expr(step))).alias("d"))
    calendar = days.select((F.last_day("d") if every == "month" else F.col("d")).alias("bucket"))
    value = F.col("value") if how == "mean" else F.coalesce("value", F.lit(0))
    return calendar.join(filled, "bucket", "left").select("bucket", value.alias("value")).orderBy("bucket")


def resample_step(days: int) -> str:
    return "month" if days > 60 else "week" if days > 14 else "day"


def scatter(df: DataFrame, x: str, y: str, colour: str | None = None) -> DataFrame:
    """The points of a scatter plot: two or three columns of every row."""
    return df.select(col(x).alias("x"), col(y).alias("y"), *([col(colour).alias("colour")] if colour else []))


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = HISTOGRAM_BINS, colour: str | None = None) -> DataFrame:
    """Point counts on a grid: what a scatter plot shows, of bounded size for any table."""
    df = C.normalise_missing(df)
    df = df.withColumns({c: C.finite(C.as_number(df, c)) for c in (x, y)})
    b = numeric_bounds(df, [x, y])
    if not b[x][0] or not b[y][0]:
        df, b = df.limit(0), {x: (0, 0.0, 0.0), y: (0, 0.0, 0.0)}
    keys = ["x_bin", "y_bin"] + (["colour"] if colour else [])
    vx, vy = C.as_number(df, x), C.as_number(df, y)
    points = df.where(vx.isNotNull() & vy.isNotNull()).select(
        bin_number(vx, b[x][1], b[x][2], bins).alias("x_bin"),
        bin_number(vy, b[y][1], b[y][2], bins).alias("y_bin"),
        *([col(colour).alias("colour")] if colour else []),
    )
    return points.groupBy(*keys).agg(F.count("*").alias("n"))


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation over pairwise complete rows, long form ``(x, y, r)`` with both orders.

    All pairs come from one scan (:mod:`comoments`). A column without variance gives NULL.
    """
    if not columns:
        return local_frame(df.sparkSession, [], "x string, y string, r double")
    r = co_moments(df, columns).correlation()
    rows = [(a, b, None if math.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return local_frame(df.sparkSession, rows, "x string, y string, r double")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same as a square table."""
    return correlation(df, columns).groupBy("x").pivot("y", columns).agg(F.first("r"))


def top_n(df: DataFrame, by: str, n: int = 5, columns: list[str] | None = None, tiebreak: list[str] = ()) -> DataFrame:
    """Rows with the largest values, nulls last; each task keeps only ``n`` rows."""
    return _ranked(df, F.desc_nulls_last, by, n, columns, tiebreak)


def bottom_n(df: DataFrame, by: str, n: int = 5, columns: list[str] | None = None, tiebreak: list[str] = ()) -> DataFrame:
    """Rows with the smallest values, nulls last."""
    return _ranked(df, F.asc_nulls_last, by, n, columns, tiebreak)


def _ranked(df, order, by, n, columns, tiebreak) -> DataFrame:
    df = C.normalise_missing(df)
    out = df.orderBy(order(by), *[col(c) for c in tiebreak]).limit(n)
    return out.select(*[col(c) for c in columns]) if columns else out


# ── views of rows ──────────────────────────────────────────────────────────────────────────────


def preview(df: DataFrame, rows: int = 60, order_by: list[str] = ()) -> DataFrame:
    return (df.orderBy(*[col(c) for c in order_by]) if order_by else df).limit(rows)


def missing_map(df: DataFrame, order_by: list[str], rows: int = 200, columns: int | None = None) -> DataFrame:
    """0/1 null flags of the first rows, as drawn in a heat map; ``columns`` draws only the first of them.
    :func:`missing_patterns` covers all rows."""
    shown = df.columns[:columns]
    first = C.normalise_missing(df).orderBy(*[col(c) for c in order_by]).limit(rows)
    w = Window.orderBy(*[col(c) for c in order_by])  # over at most `rows` rows
    return first.select(
        F.row_number().over(w).alias("line"), *[col(c).isNull().cast("int").alias(c) for c in shown]
    )


def missing_patterns(df: DataFrame) -> DataFrame:
    """How often each combination of null columns occurs, over all rows: ``(missing, columns, n)``."""
    df = C.normalise_missing(df)
    flags = F.concat(*[F.when(col(c).isNull(), "1").otherwise("0") for c in df.columns])
    counts = df.groupBy(flags.alias("pattern")).agg(F.count("*").alias("n"))
    names = F.array_compact(
        F.array(*[F.when(F.substring("pattern", i + 1, 1) == "1", F.lit(c)) for i, c in enumerate(df.columns)])
    )
    return counts.select("pattern", F.size(names).alias("missing"), F.array_join(names, ",").alias("columns"), "n")
