"""All registered queries: Spark code and, where SQL can say the same, its SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.functions import text as X
from tablecheck.functions.columns import col, long_form, type_names
from tablecheck.operators import clean as K
from tablecheck.operators import dependencies, duplicates, frequency, neardup
from tablecheck.operators import insights as I
from tablecheck.operators import score as S
from tablecheck.operators.drift import Drift
from tablecheck.operators.profile import Profile
from tablecheck.operators.profile_state import add_parts, stored_profile
from tablecheck.plans import sql as Q
from tablecheck.plans.views import table
from tablecheck.sources import export, storage, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def on(source: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: f(table(spark, sf, source))


def profiled(f: Callable[[Profile], DataFrame], source: str = "dirty_customer", **options) -> Query:
    return lambda spark, sf: f(Profile(table(spark, sf, source), **options))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(col(c), digits) for c in columns})


# ── profile ────────────────────────────────────────────────────────────────────────────────────

register("summary", profiled(Profile.summary), f"{Q.ALL} SELECT * FROM summary")
register(
    "missing_table",
    profiled(Profile.missing_table),
    f"{Q.ALL} SELECT col AS \"column\", rows - non_null AS missing_count, {Q.pct('rows - non_null', 'rows')} AS missing_pct "
    "FROM basics WHERE rows > non_null",
)
register(
    "column_profile",
    profiled(Profile.column_profile),
    f"{Q.ALL} SELECT col AS \"column\", dtype, non_null, rows - non_null AS missing_count, "
    f"{Q.pct('rows - non_null', 'rows')} AS missing_pct, uniq AS \"unique\", constant FROM basics",
)
register("constant_columns", profiled(Profile.constant_table), f'{Q.ALL} SELECT col AS "column" FROM basics WHERE constant')
register(
    "placeholder_table",
    profiled(Profile.placeholder_table),
    f"{Q.ALL} SELECT t.col AS \"column\", tokens AS placeholder_missing_count, {Q.pct('tokens', 'rows')} AS placeholder_missing_pct "
    "FROM texts t JOIN basics b ON t.col = b.col WHERE tokens > 0",
)


def _duplicates(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(duplicates.duplicate_rows(df),)], "duplicate_rows long")


register(
    "duplicate_rows",
    on("dirty_customer", _duplicates),
    f"{Q.view('dirty_customer')} SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_customer)) AS duplicate_rows FROM dirty_customer",
)
register(
    "duplicate_rows_lineitem",
    on("lineitem", lambda df: _duplicates(df.unionByName(df.where("l_orderkey % 10 = 0")))),  # all columns, a tenth of the orders twice
    "WITH l AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 10 = 0) SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM l)) AS duplicate_rows FROM l",
)
register(
    "footprint",
    profiled(lambda p: p.spark.createDataFrame([(p.footprint_bytes,)], "bytes long")),
    f"{Q.ALL} SELECT sum(bytes)::BIGINT AS bytes FROM basics",
)
_FLAGS = ", ".join(f"({c} IS NULL)::INT AS {c}" for c in Q.DIRTY)
_MAP_ORDER = ["id", "name"]
register(
    "missing_map",
    on("dirty_customer", lambda df: I.missing_map(df, _MAP_ORDER)),
    f"{Q.view('dirty_customer')} SELECT row_number() OVER (ORDER BY id, name)::INT AS line, {_FLAGS} "
    "FROM (SELECT * FROM dirty_customer ORDER BY id, name LIMIT 200)",
)
_PATTERN = " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in Q.DIRTY)
_NAMES = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in Q.DIRTY) + ")"
register(
    "missing_patterns",
    on("dirty_customer", I.missing_patterns),
    f"{Q.view('dirty_customer')} SELECT {_PATTERN} AS pattern, length(replace({_PATTERN}, '0', ''))::INT AS missing, "
    f'{_NAMES} AS "columns", count(*) AS n FROM dirty_customer GROUP BY ALL',
)
register(
    "preview",
    on("orders", lambda df: I.preview(df, 60, ["o_orderkey"])),
    "SELECT * FROM orders ORDER BY o_orderkey LIMIT 60",
)
register(
    "value_frequencies",
    on("dirty_customer", lambda df: frequency.value_counts(df, Q.TEXT)),
    f"{Q.view('dirty_customer')} "
    + Q.union(
        f"SELECT '{c}' AS \"column\", {c} AS \"value\", count(*) AS n FROM dirty_customer WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in Q.TEXT
    ),
)

# ── detection ──────────────────────────────────────────────────────────────────────────────────

register(
    "type_suggestions",
    profiled(Profile.type_suggestions),
    f"{Q.ALL} SELECT col AS \"column\", 'string' AS current_dtype, kind AS suggested_type, confidence AS confidence_pct FROM suggestions",
)
_OUTLIER_COLUMNS = (
    f'SELECT col AS "column", iqr AS outlier_count_iqr, {Q.pct("iqr", "rows")} AS outlier_pct_iqr, '
    f'z AS outlier_count_zscore, {Q.pct("z", "rows")} AS outlier_pct_zscore FROM outliers'
)
register("outlier_table", profiled(Profile.outlier_table), f"{Q.ALL} {_OUTLIER_COLUMNS}")
register(
    "outlier_table_lineitem",
    lambda spark, sf: Profile(
        table(spark, sf, "lineitem").select(
            (F.col("l_extendedprice") * F.col("l_extendedprice")).alias("price2"),
            (F.col("l_quantity") * F.when(F.col("l_linenumber") == 7, 9.0).otherwise(1.0)).alias("quantity"),
            "l_tax",
        )
    ).outlier_table(),
    "WITH li AS (SELECT l_extendedprice * l_extendedprice AS price2, l_quantity * CASE WHEN l_linenumber = 7 THEN 9.0::DOUBLE ELSE 1.0 END AS quantity, l_tax FROM lineitem), "
    + Q.outliers_cte("li", ["price2", "quantity", "l_tax"])
    + " "
    + _OUTLIER_COLUMNS,
)
for _name, _count in (("outliers_iqr", "iqr"), ("outliers_zscore", "z")):
    _key = "iqr_outliers" if _count == "iqr" else "zscore_outliers"
    register(
        _name,
        profiled(
            lambda p, k=_key: p.spark.createDataFrame(
                [(c, p.numeric_figures[c][k]) for c in p.numeric if p.numeric_figures[c][k]], "column string, n long"
            )
        ),
        f'{Q.ALL} SELECT col AS "column", {_count} AS n FROM outliers WHERE {_count} > 0',
    )


def _pattern_sql(source: str, columns: list[str]) -> str:
    counts = Q.union(
        f"SELECT '{c}' AS col, {i} AS rank, '{name}' AS pattern, count({c}) AS n, min({Q.strip(c)}) AS sample, "
        f"count(*) FILTER (regexp_full_match({Q.strip(c)}, '{regex}', 'i')) AS hits FROM {source}"
        for c in columns
        for i, (name, regex) in enumerate(Q.PATTERNS.items())
    )
    return (
        f"{Q.view(source)}, hit AS (SELECT * FROM ({counts}) WHERE n > 0 AND 100.0::DOUBLE * hits / n >= 60) "
        f"SELECT col AS \"column\", pattern, {Q.pct('hits', 'n', 1)} AS match_pct, sample FROM hit "
        "QUALIFY row_number() OVER (PARTITION BY col ORDER BY rank) = 1"
    )


register("patterns", profiled(Profile.pattern_table), _pattern_sql("dirty_customer", Q.TEXT))
register(
    "patterns_contacts",
    profiled(Profile.pattern_table, "contacts"),
    _pattern_sql("contacts", ["email", "cpf", "cnpj", "cep", "phone", "plate", "visit", "site", "mixed"]),
)


def _cardinality_sql(types: dict[str, str], source: str, prefix: str) -> str:
    rows = Q.union(
        f"SELECT '{c}' AS col, {str(t == 'string').lower()} AS is_text, count(DISTINCT {c}) AS u, count({c}) AS n FROM {source}"
        for c, t in types.items()
    )
    return (
        f"{prefix} SELECT col AS \"column\", u AS unique_values, {Q.pct('u', 'n', 1)} AS unique_pct, "
        "CASE WHEN is_text THEN 'high cardinality (possible id/key)' ELSE 'low cardinality (possible coded category)' END AS flag "
        f"FROM ({rows}) WHERE n > 10 AND CASE WHEN is_text THEN {Q.pct('u', 'n', 1)} > 90 ELSE u <= 5 END"
    )


register("cardinality", profiled(Profile.cardinality_table), _cardinality_sql(Q.DIRTY_TYPES, "dirty_customer", Q.view("dirty_customer")))
_LINEITEM_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp",
}


def _marked_lines(df: DataFrame) -> DataFrame:
    """All columns, and two that must be flagged: few numbers, and text that differs in every row."""
    return df.withColumns({"step": (F.col("l_linenumber") % 3).cast("int"), "line_id": F.concat_ws("-", "l_orderkey", "l_linenumber")})


register(
    "cardinality_lineitem",
    on("lineitem", lambda df: Profile(_marked_lines(df)).cardinality_table()),
    _cardinality_sql(
        _LINEITEM_TYPES | {"step": "int", "line_id": "string"}, "lines",
        "WITH lines AS (SELECT *, l_linenumber % 3 AS step, l_orderkey || '-' || l_linenumber AS line_id FROM lineitem)",
    ),
)

_PART_TEXT = ["p_name", "p_brand", "p_type"]
_NEAR_SQL = (
    " SELECT col AS \"column\", a AS value_1, b AS value_2, round(sim, 6) AS similarity_pct FROM scored WHERE sim >= 80 AND sim < 100 "
    "QUALIFY row_number() OVER (PARTITION BY col ORDER BY sim DESC, a, b) <= 3"
)
register(
    "near_dup_values",
    on("part", lambda df: neardup.near_duplicate_values(df, _PART_TEXT)),
    Q.lcs_pairs("part", _PART_TEXT) + _NEAR_SQL,
)
register(
    "near_dup_customer",
    on("dirty_customer", lambda df: neardup.near_duplicate_values(df, Q.TEXT)),
    f"{Q.view('dirty_customer')}, {Q.close_pairs('dirty_customer', Q.TEXT)}".replace("WITH ", "WITH RECURSIVE ", 1) + _NEAR_SQL,
)


def _fd_sql(columns: list[str], source: str, prefix: str, sample: str | None = None) -> str:
    branches = Q.union(
        f"SELECT '{a}' AS determinant, '{b}' AS dependent, count(*) AS groups_checked, max(k) AS most FROM "
        f"(SELECT {a}, count(DISTINCT {b}) AS k FROM {sample or source} WHERE {a} IS NOT NULL GROUP BY {a}) "
        f"WHERE (SELECT count(DISTINCT {a}) BETWEEN 2 AND greatest(0.5 * count(*), 2) FROM {source})"
        for a in columns
        for b in columns
        if a != b
    )
    return f"{prefix} SELECT determinant, dependent, groups_checked FROM ({branches}) WHERE groups_checked >= 2 AND most = 1"


register("functional_deps", profiled(Profile.functional_deps), _fd_sql(Q.DIRTY, "dirty_customer", Q.view("dirty_customer")))
_GEO = "SELECT c_custkey, c_mktsegment, n_nationkey, n_name, r_regionkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _geo(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return (
        c.join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select("c_custkey", "c_mktsegment", "n_nationkey", "n_name", "r_regionkey", "r_name")
    )


register(
    "functional_deps_geo",
    lambda spark, sf: Profile(_geo(spark, sf)).functional_deps(),
    _fd_sql(["c_custkey", "c_mktsegment", "n_nationkey", "n_name", "r_regionkey", "r_name"], "geo", f"WITH geo AS ({_GEO})"),
)
register(
    "functional_deps_sampled",
    lambda spark, sf: Profile(_geo(spark, sf), fd_sample=1000, fd_sample_by=["c_custkey"]).functional_deps(),
    _fd_sql(["c_custkey", "c_mktsegment", "n_nationkey", "n_name", "r_regionkey", "r_name"], "geo", f"WITH geo AS ({_GEO}), drawn AS (SELECT * FROM geo ORDER BY md5(c_custkey::VARCHAR) LIMIT 1000)", "drawn"),
)

# ── score ──────────────────────────────────────────────────────────────────────────────────────

register("score", profiled(S.score), f"{Q.ALL} SELECT score, level FROM ({Q.score_select('general')})")
register("score_presets", profiled(S.score_presets), f"{Q.ALL} {Q.union(Q.score_select(p) for p in Q.WEIGHTS)}")
register(
    "score_breakdown",
    profiled(S.score_breakdown),
    f"{Q.ALL} SELECT * FROM ("
    + Q.union(
        f"SELECT '{k}' AS dimension, -round(least({k} * {w}, {Q.CAPS[k]})::DOUBLE, 1) AS deduction FROM inputs WHERE {k} > 0"
        for k, w in zip(Q.CAPS, Q.WEIGHTS["general"])
    )
    + ")",
)
register(
    "score_custom",
    profiled(lambda p: S.score(p, {"missing": 0.1, "type": 0.2})),
    f"{Q.ALL} SELECT score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 55 THEN 'attention' ELSE 'critical' END AS level "
    "FROM (SELECT round((100 - least(missing * 0.1, 30) - least(duplicates * 2, 20) - least(constant * 0.8, 10) - least(placeholder * 0.8, 10) "
    "- least(type * 0.2, 15) - least(outlier * 0.5, 10))::DOUBLE, 1) AS score FROM inputs)",
)
_ISSUES_SQL = f"""{Q.ALL},
uniq AS (SELECT pos, col, uniq AS u, non_null AS n, dtype = 'string' AS is_text, {Q.pct('uniq', 'non_null', 1)} AS share FROM basics WHERE non_null > 10),
found AS (
  SELECT * FROM (SELECT 1 AS src, row_number() OVER (ORDER BY rows - non_null DESC, pos) AS seq,
    CASE WHEN {Q.pct('rows - non_null', 'rows')} >= 25 THEN 'high' ELSE 'medium' END AS priority, 'missing data' AS issue,
    'column ' || col || ' is ' || {Q.pct('rows - non_null', 'rows')} || '% missing' AS details,
    'impute, or drop the column if it carries little signal' AS action FROM basics WHERE rows > non_null)
  UNION ALL SELECT 2, 1, CASE WHEN duplicate_rows > 100 THEN 'high' ELSE 'medium' END, 'duplicate rows',
    duplicate_rows || ' duplicate rows', 'drop exact duplicates' FROM summary WHERE duplicate_rows > 0
  UNION ALL SELECT * FROM (SELECT 3, row_number() OVER (ORDER BY pos) AS seq, 'medium', 'constant column',
    'column ' || col || ' never varies', 'drop before modelling' FROM basics WHERE constant)
  UNION ALL SELECT * FROM (SELECT 4, row_number() OVER (ORDER BY confidence DESC, pos) AS seq, 'medium', 'type mismatch',
    'column ' || col || ' looks ' || kind || ' (' || confidence || '% of values)', 'convert before analysis' FROM suggestions)
  UNION ALL SELECT 5, row_number() OVER (ORDER BY pos), 'medium', 'suspicious cardinality',
    'column ' || col || ': ' || CASE WHEN is_text THEN 'high cardinality (possible id/key)' ELSE 'low cardinality (possible coded category)' END
    || ', ' || share || '% unique', 'check whether it is a key or a coded category'
    FROM uniq WHERE CASE WHEN is_text THEN share > 90 ELSE u <= 5 END
)
SELECT row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 ELSE 1 END, issue, src, seq)::INT AS rank, priority, issue, details, action FROM found"""


register("issues", profiled(S.issues, near_dup_columns=[]), _ISSUES_SQL)
_ALIKE_SQL = f""" UNION ALL SELECT 6, row_number() OVER (ORDER BY pos), 'medium', 'near-duplicate text', 'column ' || col || ' has values that are almost alike',
    'standardise the values' FROM basics WHERE col IN (SELECT col FROM scored WHERE sim >= 80 AND sim < 100)
)
SELECT row_number"""
register(
    "issues_with_near_dups",
    profiled(S.issues),
    _ISSUES_SQL.replace("WITH ", "WITH RECURSIVE ", 1).replace("\nuniq AS (", f"\n{Q.close_pairs('dirty_customer', Q.TEXT)},\nuniq AS (").replace("\n)\nSELECT row_number", _ALIKE_SQL),
)
register(
    "alerts",
    profiled(S.alerts),
    f"{Q.ALL}, sc AS ({Q.score_select('general')}), pat AS (SELECT * FROM ({_pattern_sql('dirty_customer', Q.TEXT)[len(Q.view('dirty_customer')) + 2:].join(['WITH ', ''])})) "
    "SELECT CASE WHEN score < 55 THEN 'error' WHEN score < 75 THEN 'warning' ELSE 'ok' END AS severity, 'score' AS topic, "
    "CASE WHEN score < 55 THEN 'critical quality: treat before use' WHEN score < 75 THEN 'moderate quality: review missing data and duplicates' "
    "ELSE 'quality is adequate for analysis' END AS message FROM sc "
    "UNION ALL SELECT 'warning', 'missing', format('{:.2f}', missing_cells_pct) || '% of cells are missing' FROM summary WHERE missing_cells_pct > 20 "
    "UNION ALL SELECT 'warning', 'duplicates', format('{:.2f}', duplicate_rows_pct) || '% of rows are duplicates' FROM summary WHERE duplicate_rows_pct > 5 "
    "UNION ALL SELECT 'info', 'constant', 'constant columns: ' || string_agg(col, ', ' ORDER BY pos) FROM basics WHERE constant HAVING count(*) > 0 "
    "UNION ALL SELECT 'info', 'pattern', 'column ' || \"column\" || ' looks like ' || pattern || ' (' || format('{:.1f}', match_pct) || '%)' FROM pat",
)
register(
    "health_bands",
    profiled(S.health_bands),
    f"{Q.ALL} SELECT 'missing_cells' AS figure, missing_cells AS count, missing_cells_pct AS pct, "
    "CASE WHEN missing_cells_pct > 20 THEN 'red' WHEN missing_cells_pct > 5 THEN 'amber' ELSE 'green' END AS band FROM summary "
    "UNION ALL SELECT 'duplicate_rows', duplicate_rows, duplicate_rows_pct, "
    "CASE WHEN duplicate_rows_pct > 5 THEN 'red' WHEN duplicate_rows_pct > 1 THEN 'amber' ELSE 'green' END FROM summary",
)

# ── guards, samples, wide and large tables ──


def _empty_profile(spark: SparkSession, sf: str) -> DataFrame:
    """A table without rows, and one without columns: every report is empty and says why."""
    orders = table(spark, sf, "orders")
    rows = []
    for name, df in (("no rows", orders.where("o_orderkey < 0")), ("no columns", orders.select()), ("sound", orders)):
        p = Profile(df)
        rows.append((name, p.error, p.column_profile().count() if not p.empty else 0))
    return spark.createDataFrame(rows, "kind string, error string, columns long")


register(
    "empty_guard",
    _empty_profile,
    "SELECT 'no rows' AS kind, 'The table has no rows or no columns.' AS error, 0 AS columns UNION ALL SELECT 'no columns', 'The table has no rows or no columns.', 0 "
    "UNION ALL SELECT 'sound', NULL, (SELECT count(*) FROM information_schema.columns WHERE table_name = 'orders')",
)


def _wide_join(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    wide = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    extra = [F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.quarter("o_orderdate").alias("q"), F.substring("o_orderpriority", 1, 1).alias("urgency"), F.floor("c_acctbal").alias("whole_balance")]
    return wide.select(*_WIDE[:-5], *extra)


_WIDE = ["o_custkey", "o_orderstatus", "o_orderpriority", "c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey", "n_nationkey", "n_name", "n_regionkey", "r_regionkey", "r_name",
         "y", "m", "q", "urgency", "whole_balance"]
register(
    "functional_deps_wide",
    lambda spark, sf: Profile(_wide_join(spark, sf)).functional_deps(),
    _fd_sql(
        _WIDE, "wide",
        "WITH wide AS MATERIALIZED (SELECT " + ", ".join(_WIDE[:-5]) + ", year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q, o_orderpriority[1:1] AS urgency, floor(c_acctbal) AS whole_balance "
        "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    ),
)
register(
    "profile_documents",
    profiled(Profile.column_profile, "documents"),
    Q.union(
        f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS missing_count, {Q.pct(f'(count(*) - count({c}))', 'count(*)')} AS missing_pct, "
        f"count(DISTINCT {c}) AS \"unique\", count(DISTINCT {c}) = 1 AND count({c}) = count(*) AS constant FROM documents"
        for c, t in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))
    ),
)

# ── cleaning ───────────────────────────────────────────────────────────────────────────────────


def _messy_names(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return K.normalise_names(c.toDF(" Cust Key ", "Name (full)", "NAME full", "Saldo R$", "name_full"))


register(
    "clean_names",
    _messy_names,
    "SELECT c_custkey AS cust_key, c_name AS name_full, c_nationkey AS name_full_1, c_acctbal AS saldo_r, c_mktsegment AS name_full_2 FROM customer",
)
register("clean_trim", on("dirty_customer", K.trim_text), f"{Q.view('dirty_customer')} {Q.trimmed()}")
register(
    "clean_tokens",
    on("dirty_customer", lambda df: K.tokens_to_null(K.trim_text(df))),
    f"{Q.view('dirty_customer')}, trimmed AS ({Q.trimmed()}) {Q.untokened()}",
)
register(
    "clean_tokens_insensitive",
    on("dirty_customer", lambda df: K.tokens_to_null(K.trim_text(df), "insensitive")),
    f"{Q.view('dirty_customer')}, trimmed AS ({Q.trimmed()}) SELECT "
    + ", ".join(f"CASE WHEN lower({c}) IN {Q.TOKENS} THEN NULL ELSE {c} END AS {c}" if c in Q.TEXT else c for c in Q.DIRTY)
    + " FROM trimmed",
)
_OFF = {"fill_numeric": "none", "fill_text": "none"}


def cleaned(source: str = "dirty_customer", **options) -> Query:
    return on(source, lambda df: K.clean(df, **options).df)


register("clean_dedup", cleaned(**_OFF), f"{Q.CLEANED} SELECT * FROM deduped")
_KEPT = [c for c in Q.DIRTY if c not in ("empty_col", "segment")]
register("clean_drop_sparse", cleaned(max_missing_pct=20.0, **_OFF), f"{Q.CLEANED} SELECT {', '.join(_KEPT)} FROM deduped")
for _how in ("median", "mean", "zero"):
    register(
        f"fill_{_how}",
        (lambda h: lambda spark, sf: rounded(K.clean(table(spark, sf, "dirty_customer"), fill_numeric=h, fill_text="none").df, 4, "balance"))(_how),
        f"{Q.CLEANED}, f AS ({Q.filled(_how, 'none')}) SELECT * REPLACE (round(balance, 4) AS balance) FROM f",
    )
register("fill_mode", cleaned(fill_numeric="none", fill_text="mode"), f"{Q.CLEANED} {Q.filled('none', 'mode')}")
register("fill_unknown", cleaned(fill_numeric="none", fill_text="unknown"), f"{Q.CLEANED} {Q.filled('none', 'unknown')}")

_NUM = Q.NUMERIC


def _outlier_sql(treatment: str, method: str) -> str:
    columns = [c for c in Q.DIRTY if c != "empty_col"]
    head = f"{Q.CLEANED}, f AS ({Q.filled('median', 'mode', columns)}), {Q.bounds_cte('f', _NUM, method)}"
    if treatment == "cap":
        # Only columns that have outliers are touched, and those become double.
        body = Q.select_with({"balance": "round(least(greatest(balance, lo_balance), hi_balance), 4)"}, "f, bounds", columns)
    else:
        inside = " AND ".join(f"({c} IS NULL OR {c} BETWEEN lo_{c} AND hi_{c})" for c in _NUM)
        body = Q.select_with({"balance": "round(balance, 4)"}, "f, bounds", columns) + f" WHERE {inside}"
    return f"{head} {body}"


for _treatment in ("cap", "remove"):
    for _method in ("iqr", "zscore"):
        register(
            f"{_treatment}_{_method}",
            (
                lambda t, m: lambda spark, sf: rounded(
                    K.clean(table(spark, sf, "dirty_customer"), max_missing_pct=70.0, outliers=t, outlier_method=m).df, 4, "balance"
                )
            )(_treatment, _method),
            _outlier_sql(_treatment, _method),
        )


def _lineitem_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * F.when(F.col("l_linenumber") == 7, 9.0).otherwise(1.0)).alias("quantity"), "l_tax"
    )


_LINEITEM_VALUES = "SELECT l_orderkey, l_linenumber, l_quantity * CASE WHEN l_linenumber = 7 THEN 9.0::DOUBLE ELSE 1.0 END AS quantity, l_tax FROM lineitem"
register(
    "remove_iqr_lineitem",
    lambda spark, sf: K.clean(_lineitem_values(spark, sf), drop_duplicates=False, outliers="remove").df,
    f"WITH f AS ({_LINEITEM_VALUES}), {Q.bounds_cte('f', ['l_orderkey', 'l_linenumber', 'quantity', 'l_tax'], 'iqr')} SELECT f.* FROM f, bounds WHERE "
    + " AND ".join(f"{c} BETWEEN lo_{c} AND hi_{c}" for c in ("l_orderkey", "l_linenumber", "quantity", "l_tax")),
)
register(
    "clean_report",
    on(
        "dirty_customer",
        lambda df: K.clean(df, max_missing_pct=70.0, outliers="cap").report_frame().withColumns(
            {c: F.array_join(col(c), ",") for c in ("dropped_sparse_columns", "capped_columns")}
        ),
    ),
    f"{Q.CLEANED} SELECT (SELECT count(*) FROM dirty_customer) AS rows_before, 12::BIGINT AS columns_before, 0::BIGINT AS columns_renamed, "
    "8::BIGINT AS trimmed_text_columns, (SELECT "
    + " + ".join(f"(count(*) FILTER ({c} IN {Q.EXACT_TOKENS}))" for c in Q.TEXT)
    + " FROM trimmed)::BIGINT AS null_tokens_converted, (SELECT count(*) FROM tokened) - (SELECT count(*) FROM deduped) AS dropped_duplicate_rows, "
    "'empty_col' AS dropped_sparse_columns, 'median' AS numeric_fill, 'mode' AS text_fill, 'cap' AS outlier_treatment, 'iqr' AS outlier_method, "
    "'balance' AS capped_columns, 0::BIGINT AS outlier_rows_removed, (SELECT count(*) FROM deduped) AS rows_after, 11::BIGINT AS columns_after, "
    "0::BIGINT AS missing_cells_after",
)
register(
    "recommended_options",
    profiled(K.options_frame),
    f"{Q.ALL} SELECT * FROM (VALUES ('trim_strings', 'true'), ('normalise_names', 'true'), ('outlier_method', 'iqr'), ('token_match', 'exact')) v(option, value) "
    "UNION ALL SELECT 'replace_null_tokens', (sum(tokens) > 0)::VARCHAR FROM texts "
    "UNION ALL SELECT 'drop_duplicates', (duplicate_rows > 0)::VARCHAR FROM summary "
    "UNION ALL SELECT 'max_missing_pct', CASE WHEN missing_cells > 0 THEN '70.0' ELSE '100.0' END FROM summary "
    "UNION ALL SELECT 'fill_numeric', CASE WHEN missing_cells > 0 THEN 'median' ELSE 'none' END FROM summary "
    "UNION ALL SELECT 'fill_text', CASE WHEN missing_cells > 0 THEN 'mode' ELSE 'none' END FROM summary "
    "UNION ALL SELECT 'outliers', CASE WHEN count(*) > 0 THEN 'cap' ELSE 'none' END FROM outliers",
)


def _change_log(df: DataFrame) -> DataFrame:
    result = K.clean(df, max_missing_pct=70.0)
    log = K.change_log(df, result.plan, ["id"])
    number = lambda c: F.when(col("column") == "balance", col(c).cast("double").cast("decimal(18,4)").cast("string")).otherwise(col(c))
    return log.select("id", "column", number("before").alias("before"), number("after").alias("after"))  # the text of doubles differs between engines


_CHANGED = Q.union(
    f"SELECT d.id, '{c}' AS \"column\", d.{c} AS \"before\", coalesce(CASE WHEN {Q.strip('d.' + c)} IN {Q.EXACT_TOKENS} THEN NULL ELSE {Q.strip('d.' + c)} END, {Q.mode(c)}) AS \"after\" FROM dirty_customer d"
    for c in Q.TEXT
    if c != "empty_col"
)
_CHANGED += " UNION ALL SELECT id, 'balance', balance::DECIMAL(18,4)::VARCHAR, coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM deduped))::DECIMAL(18,4)::VARCHAR FROM dirty_customer"
register("change_log", on("dirty_customer", _change_log), f'{Q.CLEANED} SELECT * FROM ({_CHANGED}) WHERE "before" IS DISTINCT FROM "after"')


def _removed(df: DataFrame) -> DataFrame:
    return K.removed_rows(df, K.clean(df, max_missing_pct=70.0, outliers="remove").plan)


_BOUNDED = ["id", "balance", "nation_key", "region_key"]
register(
    "removed_rows",
    on("dirty_customer", _removed),
    f"{Q.CLEANED}, f AS (SELECT deduped.*, coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM deduped)) AS filled FROM deduped), "
    f"q AS (SELECT {', '.join(f'quantile_cont({v}, 0.25) AS a_{c}, quantile_cont({v}, 0.75) AS b_{c}' for c in _BOUNDED for v in ['filled' if c == 'balance' else c])} FROM f) "
    "SELECT *, count(*) - 1 AS copies, 'duplicate' AS reason FROM tokened GROUP BY ALL HAVING count(*) > 1 UNION ALL "
    "SELECT f.* EXCLUDE filled, 1, 'outlier' FROM f, q WHERE "
    + " OR ".join(f"(b_{c} > a_{c} AND ({v} < a_{c} - 1.5 * (b_{c} - a_{c}) OR {v} > b_{c} + 1.5 * (b_{c} - a_{c})))" for c in _BOUNDED for v in ["filled" if c == "balance" else c]),
)

# ── insights ───────────────────────────────────────────────────────────────────────────────────


def _names(p: Profile, names: list[str]) -> DataFrame:
    return p.spark.createDataFrame([(c,) for c in names], "column string")


_ORDERS_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
register(
    "analysable_columns",
    profiled(lambda p: _names(p, I.analysable_columns(p)), "orders"),
    "SELECT * FROM ("
    + Q.union(
        f"SELECT '{c}' AS \"column\" FROM orders HAVING stddev_samp({c}) <> 0 AND count(DISTINCT {c}) <= 0.95 * count(*)" for c in _ORDERS_NUM
    )
    + ")",
)
register(
    "grouping_columns",
    profiled(lambda p: _names(p, I.grouping_columns(p))),
    f"{Q.ALL} SELECT col AS \"column\" FROM basics WHERE dtype = 'string' AND uniq BETWEEN 2 AND 25",
)
register(
    "date_columns",
    profiled(lambda p: _names(p, I.date_columns(p))),
    f"{Q.ALL} SELECT col AS \"column\" FROM suggestions WHERE kind = 'datetime'",
)
register(
    "column_choice",
    profiled(lambda p: I.column_choice(p)),
    f"{Q.ALL} SELECT col AS \"column\", 'group' AS role FROM basics WHERE dtype = 'string' AND uniq BETWEEN 2 AND 25 "
    "UNION ALL SELECT col, 'date' FROM suggestions WHERE kind = 'datetime' "
    + "".join(
        f"UNION ALL SELECT '{c}', 'metric' FROM dirty_customer HAVING stddev_samp({c}) <> 0 AND count(DISTINCT {c}) <= 0.95 * count(*) " for c in Q.NUMERIC
    ),
)
_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _stat_sql(columns: list[str], extra: str = "") -> str:
    return Q.union(
        f"SELECT '{c}' AS \"column\", {extra.format(c=c)} round(min({c}), 4) AS \"min\", round(quantile_cont({c}, 0.5), 4) AS median, "
        f"round(avg({c}), 4) AS mean, round(max({c}), 4) AS \"max\", round(stddev_samp({c}), 4) AS std FROM lineitem"
        for c in columns
    )


register(
    "kpis",
    on("lineitem", lambda df: rounded(I.kpis(df, _LINE), 4, "mean", "median", "min", "max", "std")),
    _stat_sql(_LINE),
)
register(
    "describe",
    on("lineitem", lambda df: rounded(I.describe(df, _LINE), 4, "min", "q1", "median", "mean", "q3", "max", "std", "skewness", "kurtosis")),
    _stat_sql(
        _LINE,
        "count({c}) AS count, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3, "
        "round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis,",
    ),
)


def _bin_sql(v: str, low: str, high: str, bins: int = 30) -> str:
    return f"least(floor(({v} - {low}) / (({high} - {low}) / {bins})) + 1, {bins})::INT"


register(
    "histogram",
    on("lineitem", lambda df: rounded(I.histogram(df, "l_extendedprice"), 4, "low", "high")),
    "WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), "
    f"h AS (SELECT {_bin_sql('l_extendedprice', 'lo', 'hi')} AS bin, count(*) AS n FROM lineitem, b GROUP BY 1) "
    "SELECT bin, round(lo + (bin - 1) * ((hi - lo) / 30), 4) AS low, round(lo + bin * ((hi - lo) / 30), 4) AS high, n FROM h, b",
)
register(
    "boxplot",
    on("lineitem", lambda df: rounded(I.boxplot(df.withColumn("price2", F.col("l_extendedprice") * F.col("l_extendedprice") * F.col("l_quantity")), ["l_quantity", "price2"]), 3, "whisker_low", "q1", "median", "q3", "whisker_high")),
    "WITH li AS (SELECT l_quantity, l_extendedprice * l_extendedprice * l_quantity AS price2 FROM lineitem) "
    + Q.union(
        f"SELECT '{c}' AS \"column\", round(min({c}) FILTER ({c} BETWEEN lo AND hi), 3) AS whisker_low, round(any_value(q1), 3) AS q1, round(any_value(q2), 3) AS median, "
        f"round(any_value(q3), 3) AS q3, round(max({c}) FILTER ({c} BETWEEN lo AND hi), 3) AS whisker_high, count(*) FILTER ({c} < lo OR {c} > hi) AS beyond FROM li, "
        f"(SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM li))"
        for c in ("l_quantity", "price2")
    ),
)
_GROUP_SQL = {
    "mean": "avg(o_totalprice)", "sum": "sum(o_totalprice)", "count": "count(o_totalprice)",
    "median": "quantile_cont(o_totalprice, 0.5)", "max": "max(o_totalprice)", "min": "min(o_totalprice)",
}
for _how, _agg in _GROUP_SQL.items():
    register(
        f"group_{_how}",
        (
            lambda h: lambda spark, sf: I.group_aggregate(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", h).withColumn(
                "value", F.col("value") if h == "count" else F.round("value", 2)
            )
        )(_how),
        f"SELECT o_orderpriority, {_agg if _how == 'count' else f'round({_agg}, 2)'} AS \"value\" FROM orders GROUP BY o_orderpriority",
    )
register(
    "group_median_customer",
    on("orders", lambda df: rounded(I.group_aggregate(df, "o_custkey", "o_totalprice", "median"), 3, "value")),
    'SELECT o_custkey, round(quantile_cont(o_totalprice, 0.5), 3) AS "value" FROM orders GROUP BY o_custkey',
)


def _resample_sql(source: str, at: str, v: str, how: str, every: str) -> str:
    label = {
        "day": f"{at}::DATE", "week": f"(date_trunc('week', {at})::DATE + 6)::DATE", "month": f"last_day({at}::DATE)",
    }[every]
    agg = {"mean": f"avg({v})", "sum": f"sum({v})", "count": f"count({v})"}[how]
    steps = {
        "day": "SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS bucket FROM r",
        "week": "SELECT unnest(generate_series(lo, hi, INTERVAL 7 DAY))::DATE AS bucket FROM r",
        "month": "SELECT last_day(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH))::DATE) AS bucket FROM r",
    }[every]
    value = "round(x, 4)" if how == "mean" else "coalesce(round(x, 4), 0)" if how == "sum" else "coalesce(x, 0)"
    return (
        f"WITH b AS (SELECT {label} AS bucket, {agg} AS x FROM {source} WHERE {at} IS NOT NULL GROUP BY 1), "
        f"r AS (SELECT min(bucket) AS lo, max(bucket) AS hi FROM b), c AS ({steps}) "
        f'SELECT c.bucket, {value} AS "value" FROM c LEFT JOIN b USING (bucket)'
    )


for _every, _how, _source, _at, _v in (
    ("day", "mean", "events", "ts", "value"),
    ("week", "sum", "events", "ts", "value"),
    ("month", "count", "orders", "o_orderdate", "o_totalprice"),
):
    register(
        f"resample_{_every}",
        (
            lambda e, h, s, a, v: lambda spark, sf: I.resample(table(spark, sf, s), a, v, h, e).withColumn(
                "value", F.col("value") if h == "count" else F.round("value", 4)
            )
        )(_every, _how, _source, _at, _v),
        _resample_sql(_source, _at, _v, _how, _every),
    )
register(
    "resample_auto",
    on("orders", lambda df: rounded(I.resample(df, "o_orderdate", "o_totalprice"), 4, "value")),
    _resample_sql("orders", "o_orderdate", "o_totalprice", "mean", "month"),
)
register(
    "resample_text_dates",
    on("dirty_customer", lambda df: rounded(I.resample(df, "signup_text", "balance", "sum", "day"), 4, "value")),
    f"{Q.view('dirty_customer')}, src AS (SELECT {Q.date(Q.strip('signup_text'))} AS signup, balance FROM dirty_customer), "
    + _resample_sql("src", "signup", "balance", "sum", "day").removeprefix("WITH "),
)
register(
    "scatter",
    on("lineitem", lambda df: I.scatter(df, "l_quantity", "l_extendedprice", "l_returnflag")),
    "SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS colour FROM lineitem",
)
register(
    "scatter_bins",
    on("lineitem", lambda df: I.scatter_bins(df, "l_quantity", "l_extendedprice", colour="l_returnflag")),
    "WITH b AS (SELECT min(l_quantity) AS xl, max(l_quantity) AS xh, min(l_extendedprice) AS yl, max(l_extendedprice) AS yh FROM lineitem) "
    f"SELECT {_bin_sql('l_quantity', 'xl', 'xh')} AS x_bin, {_bin_sql('l_extendedprice', 'yl', 'yh')} AS y_bin, l_returnflag AS colour, count(*) AS n FROM lineitem, b GROUP BY ALL",
)
register(
    "correlation",
    on("lineitem", lambda df: rounded(I.correlation(df, _LINE), 6, "r")),
    Q.union(f"SELECT '{a}' AS x, '{b}' AS y, round({'1.0::DOUBLE * count(*) / count(*)' if a == b else f'corr({a}, {b})'}, 6) AS r FROM lineitem" for a in _LINE for b in _LINE),
)
register(
    "correlation_matrix",
    on("lineitem", lambda df: rounded(I.correlation_matrix(df, _LINE), 6, *_LINE)),
    Q.union(
        f"SELECT '{a}' AS x, " + ", ".join(f"round({'1.0::DOUBLE * count(*) / count(*)' if a == b else f'corr({a}, {b})'}, 6) AS {b}" for b in _LINE) + " FROM lineitem"
        for a in _LINE
    ),
)
_RANKED = ["o_orderkey", "o_totalprice", "o_orderpriority"]
register(
    "top_n",
    on("orders", lambda df: I.top_n(df, "o_totalprice", 10, _RANKED, ["o_orderkey"])),
    f"SELECT {', '.join(_RANKED)} FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10",
)
register(
    "bottom_n",
    on("orders", lambda df: I.bottom_n(df, "o_totalprice", 10, _RANKED, ["o_orderkey"])),
    f"SELECT {', '.join(_RANKED)} FROM orders ORDER BY o_totalprice ASC NULLS LAST, o_orderkey LIMIT 10",
)


def _top_displayed(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "dirty_customer")
    return I.top_n(df, "balance", 5, I.display_columns(Profile(df), "balance"), ["id", "name"])


register(
    "top_n_display_columns",
    _top_displayed,
    f"{Q.view('dirty_customer')} SELECT balance, segment, nation_key, region_key FROM dirty_customer ORDER BY balance DESC NULLS LAST, id, name LIMIT 5",
)

# ── drift ──────────────────────────────────────────────────────────────────────────────────────


def drifted(f: Callable[[Drift], DataFrame], method: str = "ks") -> Query:
    return lambda spark, sf: f(Drift(table(spark, sf, "orders_ref"), table(spark, sf, "orders_new"), method))


_PAIR = Q.view("orders_ref", "orders_new")
_KS = f"""{_PAIR},
m AS (SELECT (SELECT count(price) FROM orders_ref) AS n, (SELECT count(price) FROM orders_new) AS m, (SELECT avg(price) FROM orders_ref) AS a,
      (SELECT avg(price) FROM orders_new) AS b, (SELECT stddev_samp(price) FROM orders_ref) AS s),
v AS (SELECT price AS x, 1 AS r, 0 AS w FROM orders_ref UNION ALL SELECT price, 0, 1 FROM orders_new),
g AS (SELECT x, sum(r) AS r, sum(w) AS w FROM v WHERE x IS NOT NULL GROUP BY x),
c AS (SELECT sum(r) OVER (ORDER BY x) AS cr, sum(w) OVER (ORDER BY x) AS cw FROM g),
d AS (SELECT max(abs(cr::DOUBLE / n - cw::DOUBLE / m)) AS d FROM c, m),
t AS (SELECT d, sqrt(n::DOUBLE * m / (n + m)) * d AS x FROM d, m),
p AS (SELECT d, CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0, least(1, (SELECT sum(CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0 * k * k * x * x)) FROM range(1, 101) s(k)))) END AS p FROM t),
numeric_drift AS (SELECT 'price' AS col, round(a, 4) AS mean_ref, round(b, 4) AS mean_new, round((b - a) / abs(a) * 100, 2) AS delta_pct,
  round(d, 4) AS ks_statistic, round(p, 4) AS p_value, p < 0.05 AS drifted FROM m, p),
k AS ({Q.union(f"SELECT '{c}' AS col, coalesce(x.v, y.v) AS v, coalesce(x.n, 0) AS r, coalesce(y.n, 0) AS w FROM (SELECT {c} AS v, count(*) AS n FROM orders_ref WHERE {c} IS NOT NULL GROUP BY {c}) x FULL JOIN (SELECT {c} AS v, count(*) AS n FROM orders_new WHERE {c} IS NOT NULL GROUP BY {c}) y ON x.v = y.v" for c in ("priority", "status"))}),
pr AS (SELECT col, v, r, w, greatest(r::DOUBLE / sum(r) OVER (PARTITION BY col), 1e-6) AS pr, greatest(w::DOUBLE / sum(w) OVER (PARTITION BY col), 1e-6) AS pw FROM k),
psi AS (SELECT col, count(*) FILTER (r > 0) AS unique_ref, count(*) FILTER (w > 0) AS unique_new, sum((pw - pr) * ln(pw / pr)) AS psi FROM pr GROUP BY col HAVING count(*) BETWEEN 2 AND 50)"""
register(
    "schema_diff",
    drifted(Drift.schema_diff),
    _PAIR + ", r AS (SELECT column_name AS c FROM (DESCRIBE SELECT * FROM orders_ref)), n AS (SELECT column_name AS c FROM (DESCRIBE SELECT * FROM orders_new)) "
    "SELECT coalesce(r.c, n.c) AS \"column\", CASE WHEN r.c IS NULL THEN 'added' WHEN n.c IS NULL THEN 'removed' ELSE 'common' END AS change FROM r FULL JOIN n ON r.c = n.c",
)
register(
    "numeric_drift",
    drifted(Drift.numeric_drift),
    f'{_KS} SELECT col AS "column", mean_ref, mean_new, delta_pct, ks_statistic, p_value, drifted FROM numeric_drift',
)


def _ks(d: Drift) -> DataFrame:
    rows = [(c, round(v, 9)) for c, v in d.ks_statistics.items()]
    return d.spark.createDataFrame(rows, "column string, ks double")


register("ks", drifted(_ks), f"{_KS} SELECT 'price' AS \"column\", round(d, 9) AS ks FROM d")
register(
    "mean_shift",
    drifted(lambda d: d.numeric_drift().select("column", "mean_ref", "mean_new", "delta_pct", "drifted"), "mean_shift"),
    f"{_KS} SELECT 'price' AS \"column\", round(a, 4) AS mean_ref, round(b, 4) AS mean_new, round((b - a) / abs(a) * 100, 2) AS delta_pct, "
    "abs(b - a) > 0.2 * greatest(s, 1e-9) AS drifted FROM m",
)
register(
    "psi",
    drifted(Drift.categorical_drift),
    f"{_KS} SELECT col AS \"column\", unique_ref, unique_new, round(psi, 4) AS psi, CASE WHEN psi >= 0.2 THEN 'significant' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS severity, "
    "psi >= 0.1 AS drifted FROM psi",
)
register(
    "drift_summary",
    drifted(Drift.summary),
    f"{_KS} SELECT (SELECT count(*) FROM orders_ref) AS rows_ref, (SELECT count(*) FROM orders_new) AS rows_new, "
    "(SELECT count(*) FROM numeric_drift WHERE drifted) AS drifted_numeric, (SELECT count(*) FROM psi WHERE psi >= 0.1) AS drifted_categorical, 'ks' AS method",
)
register(
    "drift_ranked",
    drifted(Drift.ranked),
    f"{_KS} SELECT kind, \"column\", strength, drifted, row_number() OVER (PARTITION BY kind ORDER BY drifted DESC, strength DESC NULLS LAST, \"column\")::INT AS rank FROM ("
    "SELECT 'numeric' AS kind, col AS \"column\", ks_statistic AS strength, drifted FROM numeric_drift "
    "UNION ALL SELECT 'categorical', col, round(psi, 4), psi >= 0.1 FROM psi)",
)
register(
    "drift_histogram",
    drifted(lambda d: rounded(d.histogram(), 4, "low", "high")),
    f"{_PAIR}, v AS (SELECT 'reference' AS source, price FROM orders_ref UNION ALL SELECT 'current', price FROM orders_new), "
    "b AS (SELECT min(price) AS lo, max(price) AS hi FROM v), "
    f"h AS (SELECT source, {_bin_sql('price', 'lo', 'hi')} AS bin, count(*) AS n FROM v, b GROUP BY ALL) "
    "SELECT source, bin, round(lo + (bin - 1) * ((hi - lo) / 30), 4) AS low, round(lo + bin * ((hi - lo) / 30), 4) AS high, n FROM h, b",
)
register(
    "category_compare",
    drifted(Drift.category_compare),
    f"{_PAIR}, v AS (SELECT 'reference' AS source, coalesce(priority, 'None') AS category FROM orders_ref UNION ALL SELECT 'current', coalesce(priority, 'None') FROM orders_new), "
    "c AS (SELECT source, category, count(*) AS n FROM v GROUP BY source, category) "
    "SELECT source, category, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY source), 6) AS frequency FROM c "
    "QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, category) <= 12",
)


def _halves(spark: SparkSession, sf: str) -> Drift:
    df = table(spark, sf, "dirty_customer")
    return Drift(df.where("id % 2 = 0"), df.where("id % 2 = 1"))


_VALUES = Q.union(f"SELECT '{c}' AS col, {c} AS v, (id % 2 = 0)::INT AS r, (id % 2 = 1)::INT AS w FROM dirty_customer WHERE {c} IS NOT NULL" for c in Q.TEXT if c != "empty_col")
_COUNTED = f"{Q.view('dirty_customer')}, k AS (SELECT col, v, sum(r) AS r, sum(w) AS w FROM ({_VALUES}) GROUP BY col, v)"
register(
    "psi_wide",
    lambda spark, sf: _halves(spark, sf).categorical_drift_all(),
    f"{_COUNTED}, n AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY r DESC, v) AS place FROM k), "
    "c AS (SELECT col, CASE WHEN r > 0 AND place <= 49 THEN v ELSE NULL END AS v, sum(r) AS r, sum(w) AS w FROM n GROUP BY ALL), "
    "p AS (SELECT col, greatest(r::DOUBLE / sum(r) OVER (PARTITION BY col), 1e-6) AS a, greatest(w::DOUBLE / sum(w) OVER (PARTITION BY col), 1e-6) AS b FROM c), "
    "x AS (SELECT col AS \"column\", count(*) AS classes, sum((b - a) * ln(b / a)) AS psi FROM p GROUP BY col) SELECT \"column\", classes, round(psi, 4) AS psi, psi >= 0.1 AS drifted FROM x",
)
register(
    "drift_skipped",
    lambda spark, sf: _halves(spark, sf).skipped(),
    f"{_COUNTED} SELECT col AS \"column\", CASE WHEN count(*) > 50 THEN 'more than 50 different values' WHEN sum(r) = 0 OR sum(w) = 0 THEN 'no values on a side' ELSE 'a single value' END AS reason "
    "FROM k GROUP BY col HAVING count(*) NOT BETWEEN 2 AND 50 OR sum(r) = 0 OR sum(w) = 0 UNION ALL SELECT 'empty_col', 'no values on a side'",
)

# ── dates in text ──

# Shape, format of the date, what is put in front and behind.
_SHAPES = [
    ("day", "yyyy-MM-dd", ""), ("zone Z", "yyyy-MM-dd'T'HH:mm:ss", "Z"), ("zone +00:00", "yyyy-MM-dd'T'HH:mm:ss", "+00:00"), ("zone +0000", "yyyy-MM-dd HH:mm:ss", "+0000"),
    ("month day year", "MMM d, yyyy", ""), ("full month", "MMMM d, yyyy", ""), ("day full month", "d MMMM yyyy", ""), ("day-month-year", "d-MMM-yyyy", ""), ("slashes", "M/d/yyyy", ""),
    ("twelve hours", "M/d/yyyy h:mm a", ""), ("twelve hours, seconds", "M/d/yyyy h:mm:ss a", ""), ("dots", "MM.dd.yyyy", ""), ("one-digit hour", "yyyy-MM-dd H:mm", ""), ("compact", "yyyyMMdd", ""),
]


def _date_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates written in each shape: how many are read, and how many as the same day."""
    orders = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    written = [F.struct(F.lit(name).alias("shape"), F.concat(F.date_format(F.col("d").cast("timestamp"), f), F.lit(tail)).alias("s")) for name, f, tail in _SHAPES]
    written.append(F.struct(F.lit("impossible").alias("shape"), F.concat(F.date_format("d", "yyyy"), F.lit("-13-41T25:61:00Z")).alias("s")))
    cells = orders.select("d", F.explode(F.array(*written)).alias("w")).select("d", "w.shape", X.parse_datetime(F.col("w.s")).alias("t"))
    return cells.groupBy("shape").agg(F.count("d").alias("rows"), F.count("t").alias("parsed"), F.count_if(F.col("t").cast("date") == F.col("d")).alias("same"))


register(
    "date_shapes",
    _date_shapes,
    "SELECT shape, count(o_orderdate) AS rows, CASE WHEN shape = 'impossible' THEN 0 ELSE count(o_orderdate) END AS parsed, CASE WHEN shape = 'impossible' THEN 0 ELSE count(o_orderdate) END AS same "
    f"FROM orders, (VALUES {', '.join(repr((n,)).replace(',)', ')') for n, _, _ in _SHAPES)}, ('impossible')) v(shape) GROUP BY shape",
)


def _named_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that only their names and all their cells make dates: numbers as days, and text with too few dates to be suggested."""
    o = table(spark, sf, "orders")
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyyMMdd")
    df = o.select("o_orderkey", day.cast("int").alias("order_day"), (day.cast("int") + 100_000_000).alias("year_code"), F.col("o_orderdate").alias("ship_date"),
                  F.when(F.col("o_orderkey") % 3 == 0, F.lit("soon")).otherwise(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")).alias("due_date"))
    return _names(Profile(df), I.date_columns(Profile(df)))


register("date_columns_named", _named_dates, "SELECT 'order_day' AS \"column\" FROM orders HAVING count(*) > 0 UNION ALL SELECT 'ship_date' FROM orders HAVING count(*) > 0")

# ── sources and sinks ──────────────────────────────────────────────────────────────────────────


def _csv_copy(spark: SparkSession, df: DataFrame, separator: str = ",", encoding: str = "UTF-8") -> str:
    path = storage.scratch_path(spark, "csv")
    export.write_csv(df, path, separator=separator, encoding=encoding)
    return path


def _csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """What the CSV reader makes of the dirty table: types it chose and nulls it recognised."""
    loaded = tables.read_csv(spark, _csv_copy(spark, table(spark, sf, "dirty_customer"))).df
    p = Profile(loaded)
    rows = [(c, type_names(loaded)[c], p.non_null(c)) for c in p.columns]
    return spark.createDataFrame(rows, "column string, dtype string, non_null long")


# Recognised while reading: exact spellings only, so ' null ' (padded) and '-' stay.
_CSV_NULLS = "('', 'NA', 'None', 'n/a', 'null', 'nan', 'NULL', 'NaN', 'N/A')"
register(
    "csv_round_trip",
    _csv_round_trip,
    f"{Q.view('dirty_customer')} "
    + Q.union(
        f"SELECT '{c}' AS \"column\", '{'double' if c == 'empty_col' else t if t != 'int' else 'bigint'}' AS dtype, "
        f"count(*) FILTER ({c}::VARCHAR NOT IN {_CSV_NULLS}) AS non_null FROM dirty_customer"
        for c, t in Q.DIRTY_TYPES.items()
    ),
)


def _sniffed(spark: SparkSession, sf: str) -> DataFrame:
    rows = []
    for name, sep in (("comma", ","), ("semicolon", ";"), ("tab", "\t"), ("pipe", "|")):
        path = _csv_copy(spark, table(spark, sf, "orders"), sep)
        got = tables.read_csv(spark, path)
        rows.append((name, got.meta["separator"] == sep, got.df.count()))
    return spark.createDataFrame(rows, "separator string, found boolean, rows long")


register(
    "sniff_delimiter",
    _sniffed,
    "SELECT s AS separator, true AS found, (SELECT count(*) FROM orders) AS rows FROM (VALUES ('comma'), ('semicolon'), ('tab'), ('pipe')) v(s)",
)


def _misleading_head(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of the early years carry a remark with as many commas as the header, so the head of the file looks like commas."""
    remark = F.when(F.year("o_orderdate") < 1998, F.lit("a,b,c,d,e,f,g,h,i"))
    path = _csv_copy(spark, table(spark, sf, "orders").withColumn("n,o,t,e,s,x,y,z,w", remark).orderBy("o_orderdate"), ";")
    sep = tables.detect_separator(spark, path)
    total, fields, having = tables.separator_figures(spark, path)[sep]
    # every file of the copy has a header
    return spark.createDataFrame([(tables.detect_separator(spark, path, lines=100), sep, fields, having == total, tables.read_csv(spark, path).df.count())],
                                 "by_head string, by_all string, fields long, regular boolean, rows long")


register(
    "sniff_delimiter_misleading_head",
    _misleading_head,
    "SELECT ',' AS by_head, ';' AS by_all, 7 AS fields, true AS regular, count(*) AS rows FROM orders",
)


_ACCENT = "João “€”"


def _encodings(spark: SparkSession, sf: str) -> DataFrame:
    """Names with accents written in each encoding, with and without a byte-order mark, must read back the same.

    ISO-8859-1 has no quotes and euro sign, so its names have the accent alone.
    """
    df = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(_ACCENT + " "), "c_name").alias("name"))
    marked = df.withColumnRenamed("c_custkey", "\ufeffc_custkey")
    windows = df.withColumn("name", F.translate("name", tables.WINDOWS_TO, tables.WINDOWS_FROM))
    latin = df.withColumn("name", F.regexp_replace("name", " “€”", ""))
    out = None
    for label, copy, encoding in (
        ("UTF-8", df, "UTF-8"), ("UTF-8 marked", marked, "UTF-8"), ("UTF-16LE", marked, "UTF-16LE"), ("UTF-16BE", marked, "UTF-16BE"),
        ("windows-1252", windows, "ISO-8859-1"), ("ISO-8859-1", latin, "ISO-8859-1"),
    ):
        got = tables.read_csv(spark, _csv_copy(spark, copy, encoding=encoding))
        part = got.df.select(F.lit(label).alias("written"), F.lit(got.meta["encoding"]).alias("encoding"), "c_custkey", "name")
        out = part if out is None else out.unionByName(part)
    return out


register(
    "detect_encoding",
    _encodings,
    f"SELECT written, encoding, c_custkey, CASE WHEN written = 'ISO-8859-1' THEN 'João' ELSE '{_ACCENT}' END || ' ' || c_name AS name FROM customer, "
    "(VALUES ('UTF-8', 'UTF-8'), ('UTF-8 marked', 'UTF-8'), ('UTF-16LE', 'UTF-16LE'), ('UTF-16BE', 'UTF-16BE'), ('windows-1252', 'windows-1252'), ('ISO-8859-1', 'ISO-8859-1')) v(written, encoding)",
)


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    """700 columns whose header alone is longer than 20 000 characters: all must come back with their sums."""
    names = [f"a_rather_long_column_name_{i}" for i in range(700)]
    df = table(spark, sf, "supplier").select(*[(F.col("s_suppkey") + i).alias(c) for i, c in enumerate(names)])
    got = tables.read_csv(spark, _csv_copy(spark, df)).df
    cells = long_form(got, {c: col(c) for c in got.columns})
    return cells.groupBy("column").agg(F.sum("value").cast("long").alias("total"))


register(
    "csv_wide",
    _wide,
    "SELECT 'a_rather_long_column_name_' || i AS \"column\", (sum(s_suppkey) + i * count(*))::BIGINT AS total FROM supplier, range(700) r(i) GROUP BY i",
)


def _multiline(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with line breaks and quotes in their text, written as CSV and read split by split."""
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit('"'), "text", F.lit('"\n')).alias("text"), "source")
    got = tables.read_csv(spark, _csv_copy(spark, docs), multi_line=True, separator=",").df
    return got.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "source")


register("csv_multiline", _multiline, "SELECT doc_id, sha256('\"' || text || '\"' || chr(10)) AS text_sha256, source FROM documents")


def _guarded(spark: SparkSession, sf: str) -> DataFrame:
    """Files made from orders with one faulty line each, in a file of its own: what the reader says, or how many rows it has."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"))
    last = orders.agg(F.max("key").alias("key"))
    head = spark.createDataFrame([("key,priority",)], "value string")
    kinds = {"sound": None, "empty surplus": ",x,", "surplus behind an empty field": ",x,,99", "quoted separators": ',"x,y,z"', "short row": "", "no rows": None}
    rows = []
    for kind, tail in kinds.items():
        path = storage.scratch_path(spark, "guard")
        if kind == "no rows":
            head.write.text(path)
        else:
            export.write_csv(orders, path)
        if tail is not None:
            last.select(F.concat(F.lit("key,priority\n"), "key", F.lit(tail)).alias("value")).write.mode("append").text(path)
        got = tables.read_csv(spark, path, separator=",")
        rows.append((kind, got.error.split(":")[0] if got.error else None, got.df.count() if got.df else 0))
    path = storage.scratch_path(spark, "guard")
    head.limit(0).coalesce(1).write.text(path)
    rows.append(("empty file", tables.read_csv(spark, path).error, 0))
    rows.append(("missing file", tables.read_csv(spark, path + "-gone").error.split(":")[0], 0))
    return spark.createDataFrame(rows, "kind string, error string, rows long")


register(
    "load_guards",
    _guarded,
    "WITH n AS (SELECT count(*) AS n FROM orders) "
    "SELECT 'sound' AS kind, NULL::VARCHAR AS error, n AS rows FROM n UNION ALL SELECT 'empty surplus', 'Malformed file', 0 UNION ALL SELECT 'surplus behind an empty field', 'Malformed file', 0 "
    "UNION ALL SELECT 'quoted separators', NULL, n + 1 FROM n UNION ALL SELECT 'short row', NULL, n + 1 FROM n UNION ALL SELECT 'no rows', 'The file has a header but no rows.', 0 "
    "UNION ALL SELECT 'empty file', 'The file is empty.', 0 UNION ALL SELECT 'missing file', 'The file cannot be read', 0",
)


def _persisted(spark: SparkSession, sf: str) -> DataFrame:
    """A table kept while it is read twice."""
    got = tables.read_table(spark, f"{sf}/orders.parquet", persist=True).df
    rows = [(got.is_cached, got.count(), got.where("o_orderstatus = 'F'").count())]
    got.unpersist()
    return spark.createDataFrame(rows, "kept boolean, rows long, finished long")


register("persisted_read", _persisted, "SELECT true AS kept, count(*) AS rows, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders")


def _exported(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "dirty_customer")
    path = storage.scratch_path(spark, "export")
    export.export_tables(K.clean(df).df, Profile(df), path)
    counts = [t.agg(F.lit(n).alias("part"), F.count("*").alias("rows")) for n, t in export.read_exported(spark, path).items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


register(
    "export_tables",
    _exported,
    f"{Q.CLEANED}, {Q.BASICS}, {Q.OUTLIERS} SELECT 'data' AS part, count(*) AS rows FROM deduped UNION ALL SELECT 'missing', count(*) FROM basics WHERE rows > non_null "
    "UNION ALL SELECT 'outliers', count(*) FROM outliers",
)


def _reported(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "dirty_customer")
    p = Profile(df)
    value, level, _ = S.score_of(S.penalty_inputs(p))
    path = storage.scratch_path(spark, "report")
    export.write_report(export.report_frame(p, "dirty_customer", value, level, K.clean(df).report), path)
    back = spark.read.json(path)
    return back.select("dataset", "quality_score", "quality_level", F.col("summary.rows").alias("rows"), F.col("treatment_report.rows_after").alias("rows_after"))


register(
    "export_report",
    _reported,
    f"{Q.ALL}, trimmed AS ({Q.trimmed()}), tokened AS ({Q.untokened()}) SELECT 'dirty_customer' AS dataset, score AS quality_score, level AS quality_level, "
    f"(SELECT rows FROM summary) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM tokened)) AS rows_after FROM ({Q.score_select('general')})",
)


def _clean_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned table written as CSV and read back."""
    path = storage.scratch_path(spark, "clean-csv")
    export.write_csv(K.clean(table(spark, sf, "dirty_customer"), max_missing_pct=70.0, fill_text="unknown").df, path)
    return tables.read_csv(spark, path).df.select("id", "name", "segment", "age_text", "signup_text", "email", "cpf", "country")


register(
    "clean_csv",
    _clean_csv,
    # 'None' survives cleaning (mixed case) but is one of the spellings a CSV read drops.
    f"{Q.CLEANED}, f AS ({Q.filled('median', 'unknown')}) SELECT id, name, nullif(segment, 'None') AS segment, age_text, signup_text, email, cpf, country FROM f",
)


def _multi_load(spark: SparkSession, sf: str) -> DataFrame:
    """Several tables at once; the missing one is reported and the rest load."""
    got = tables.read_tables(
        spark, {"tc_nation": f"{sf}/nation.parquet", "tc_orders": f"{sf}/orders.parquet", "tc_absent": f"{sf}/absent.parquet"}
    )
    rows = [(n, r.df is not None, spark.table(n).count() if r.df is not None else 0) for n, r in got.items()]
    return spark.createDataFrame(rows, "name string, loaded boolean, rows long")


register(
    "multi_load",
    _multi_load,
    "SELECT 'tc_nation' AS name, true AS loaded, count(*) AS rows FROM nation UNION ALL SELECT 'tc_orders', true, count(*) FROM orders UNION ALL SELECT 'tc_absent', false, 0",
)


# ── stored profile ─────────────────────────────────────────


def _profile_increment(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of the years before 1996 are profiled first, the later ones added to the stored state, 1996 twice."""
    orders, path = table(spark, sf, "orders"), storage.scratch_path(spark, "profile-state")
    year = F.year("o_orderdate")
    add_parts(orders.filter((year < 1996) | year.isNull()), path, year)
    add_parts(orders.filter(year >= 1996), path, year)
    add_parts(orders.filter(year == 1996), path, year)
    return rounded(stored_profile(spark, path).drop("distinct_estimate", "infinite"), 4, "mean", "std")


def _increment_sql(c: str, kind: str) -> str:
    figures = ("min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std" if kind == "numeric"
               else "NULL::DOUBLE AS low, NULL::DOUBLE AS high, NULL::DOUBLE AS mean, NULL::DOUBLE AS std")
    return f"""SELECT '{c}' AS "column", '{kind}' AS class, count(*) AS rows, count({c}) AS non_null, count(*) - count({c}) AS missing, {figures.format(c=c)} FROM orders"""


register(
    "profile_increment",
    _profile_increment,
    Q.union(_increment_sql(c, kind) for c, kind in (
        ("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "text"),
        ("o_totalprice", "numeric"), ("o_orderdate", "datetime"), ("o_orderpriority", "text"),
    )),
)
