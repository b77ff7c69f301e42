"""Plain-SQL counterparts of the operators, as text that DuckDB runs on the same tables.

Independent of the Spark code: these spell out the definition of each result, one branch per column,
and serve as the correctness reference of the registered queries.
"""

from __future__ import annotations

from tablecheck.plans.views import VIEWS

DIRTY_TYPES = {
    "id": "bigint", "name": "string", "segment": "string", "balance": "double", "age_text": "string",
    "signup_text": "string", "email": "string", "cpf": "string", "nation_key": "int", "region_key": "int",
    "country": "string", "empty_col": "string",
}
DIRTY = list(DIRTY_TYPES)
TEXT = [c for c, t in DIRTY_TYPES.items() if t == "string"]
NUMERIC = [c for c, t in DIRTY_TYPES.items() if t != "string"]
WIDTH = {"bigint": 8, "double": 8, "int": 4, "string": 0}

TOKENS = "('', ' ', 'na', 'n/a', 'null', 'none', 'nan', '-')"
EXACT_TOKENS = "('', ' ', 'na', 'n/a', 'null', 'none', 'nan', '-', 'NA', 'N/A', 'NULL', 'NONE', 'NAN')"
NUMBER = r"[+\-]?(?:(?:\d+(?:\.\d*)?|\.\d+)(?:e[+\-]?\d+)?|inf|infinity)"
PATTERNS = {
    "email": r"[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}",
    "cpf": r"\d{3}[.\-]?\d{3}[.\-]?\d{3}-?\d{2}",
    "cnpj": r"\d{2}[.\-]?\d{3}[.\-]?\d{3}/?\d{4}-?\d{2}",
    "cep": r"\d{5}-?\d{3}",
    "phone": r"(?:\+?55\s?)?\(?\d{2}\)?[\s\-]?\d{4,5}[\-\s]?\d{4}",
    "plate": r"[A-Z]{3}-?(?:\d{4}|\d[A-Z]\d{2})",
    "date_br": r"\d{1,2}/\d{1,2}/\d{4}",
    "url": r"https?://\S+",
}
DATES = [
    (r"\d{4}-\d{1,2}-\d{1,2}", ["%Y-%m-%d"]),
    (r"\d{8}", ["%Y%m%d"]),
    (r"\d{4}-\d{2}", ["%Y-%m"]),
    (r"\d{4}", ["%Y"]),
    (r"\d{1,2}/\d{1,2}/\d{4}", ["%m/%d/%Y", "%d/%m/%Y"]),
    (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", ["%Y-%m-%d %H:%M:%S"]),
]


def view(*names: str) -> str:
    """``WITH`` list that defines derived views."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def date(s: str) -> str:
    cases = " ".join(
        f"WHEN regexp_full_match({s}, '{shape}') THEN coalesce(" + ", ".join(f"try_strptime({s}, '{f}')" for f in formats) + ")"
        for shape, formats in DATES
    )
    return f"(CASE {cases} END)"


def union(branches) -> str:
    return " UNION ALL ".join(branches)


def pct(part: str, total: str, digits: int = 2) -> str:
    return f"round(100.0::DOUBLE * ({part}) / ({total}), {digits})"


# ── building blocks over dirty_customer, as CTEs ───────────────────────────────────────────────

BASICS = "basics AS (" + union(
    f"SELECT {i} AS pos, '{c}' AS col, '{t}' AS dtype, count(*) AS rows, count({c}) AS non_null, "
    f"count(DISTINCT {c}) AS uniq, "
    f"(count({c}) = 0 OR (count({c}) = count(*) AND min({c}) = max({c}))) AS constant, "
    + (f"coalesce(sum(strlen({c})), 0)::BIGINT" if t == "string" else f"(count(*) * {WIDTH[t]})::BIGINT")
    + " AS bytes FROM dirty_customer"
    for i, (c, t) in enumerate(DIRTY_TYPES.items())
) + ")"

TEXTS = "texts AS (" + union(
    f"SELECT {DIRTY.index(c)} AS pos, '{c}' AS col, count({c}) AS n, "
    f"count(*) FILTER (lower({strip(c)}) IN {TOKENS}) AS tokens, "
    f"count(*) FILTER (regexp_full_match({strip(c)}, '{NUMBER}', 'i')) AS numbers, "
    f"count({date(strip(c))}) AS dates FROM dirty_customer"
    for c in TEXT
) + ")"

SUGGESTIONS = """suggestions AS (
  SELECT pos, col, CASE WHEN numbers >= 0.8 * n AND numbers >= dates THEN 'numeric' ELSE 'datetime' END AS kind,
         round(100.0::DOUBLE * CASE WHEN numbers >= 0.8 * n AND numbers >= dates THEN numbers ELSE dates END / n, 2) AS confidence
  FROM texts WHERE n > 0 AND ((numbers >= 0.8 * n AND numbers >= dates) OR dates >= 0.8 * n))"""


def outliers_cte(table: str, columns: list[str], positions: dict[str, int] | None = None) -> str:
    positions = positions or {c: i for i, c in enumerate(columns)}
    return "outliers AS (SELECT * FROM (" + union(
        f"SELECT {positions[c]} AS pos, '{c}' AS col, count(*) AS rows, "
        f"count(*) FILTER (q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))) AS iqr, "
        f"count(*) FILTER (sd > 0 AND abs(({c} - mu) / sd) > 3) AS z FROM {table}, "
        f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, avg({c}) AS mu, stddev_samp({c}) AS sd FROM {table})"
        for c in columns
    ) + ") WHERE iqr > 0 OR z > 0)"


OUTLIERS = outliers_cte("dirty_customer", NUMERIC, {c: DIRTY.index(c) for c in NUMERIC})

SUMMARY = f"""summary AS (
  SELECT max(rows) AS rows, count(*) AS columns, sum(rows - non_null)::BIGINT AS missing_cells,
         {pct('sum(rows - non_null)', 'sum(rows)')} AS missing_cells_pct,
         max(rows) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_customer)) AS duplicate_rows,
         {pct('max(rows) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_customer))', 'max(rows)')} AS duplicate_rows_pct,
         round(sum(bytes) / 1048576.0::DOUBLE, 3) AS footprint_mb,
         count(*) FILTER (constant) AS constant_columns
  FROM basics)"""

INPUTS = """inputs AS (
  SELECT missing_cells_pct AS missing, duplicate_rows_pct AS duplicates,
         100.0::DOUBLE * constant_columns / columns AS constant,
         100.0::DOUBLE * (SELECT coalesce(sum(tokens), 0) FROM texts) / (rows * columns) AS placeholder,
         100.0::DOUBLE * (SELECT count(*) FROM suggestions) / columns AS type,
         (SELECT coalesce(avg(round(100.0::DOUBLE * iqr / rows, 2)), 0) FROM outliers) AS outlier
  FROM summary)"""

ALL = ", ".join([view("dirty_customer"), BASICS, TEXTS, SUGGESTIONS, OUTLIERS, SUMMARY, INPUTS])

CAPS = {"missing": 30, "duplicates": 20, "constant": 10, "placeholder": 10, "type": 15, "outlier": 10}
WEIGHTS = {
    "general": (1.5, 2.0, 0.8, 0.8, 1.0, 0.5),
    "financial": (2.5, 3.0, 0.8, 1.2, 1.5, 1.0),
    "marketing": (1.0, 1.5, 0.5, 0.8, 0.8, 0.3),
    "hr": (2.0, 2.5, 0.6, 1.0, 1.0, 0.4),
    "logistics": (1.8, 2.0, 0.7, 0.9, 1.2, 0.8),
}


def score_select(preset: str) -> str:
    cut = " + ".join(f"least({k} * {w}, {CAPS[k]})" for k, w in zip(CAPS, WEIGHTS[preset]))
    return (
        f"SELECT '{preset}' AS preset, score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' "
        f"WHEN score >= 55 THEN 'attention' ELSE 'critical' END AS level FROM "
        f"(SELECT round(greatest(0, least(100, 100 - ({cut})))::DOUBLE, 1) AS score FROM inputs)"
    )


# ── cleaning steps over dirty_customer ─────────────────────────────────────────────────────────


def trimmed(source: str = "dirty_customer") -> str:
    return "SELECT " + ", ".join(f"{strip(c)} AS {c}" if c in TEXT else c for c in DIRTY) + f" FROM {source}"


def untokened(source: str = "trimmed") -> str:
    return "SELECT " + ", ".join(
        f"CASE WHEN {c} IN {EXACT_TOKENS} THEN NULL ELSE {c} END AS {c}" if c in TEXT else c for c in DIRTY
    ) + f" FROM {source}"


CLEANED = ", ".join(
    [view("dirty_customer"), f"trimmed AS ({trimmed()})", f"tokened AS ({untokened()})", "deduped AS (SELECT DISTINCT * FROM tokened)"]
)


def select_with(changes: dict[str, str], source: str, columns: list[str] = DIRTY) -> str:
    return "SELECT " + ", ".join(f"{changes[c]} AS {c}" if c in changes else c for c in columns) + f" FROM {source}"


def mode(c: str, source: str = "deduped") -> str:
    return f"coalesce((SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1), 'unknown')"


def filled(numeric: str, text: str, columns: list[str] = DIRTY) -> str:
    number = {
        "median": "coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM deduped))",
        "mean": "coalesce(balance, (SELECT avg(balance) FROM deduped))",
        "zero": "coalesce(balance, 0)",
    }
    changes = {"balance": number[numeric]} if numeric in number else {}
    for c in TEXT:
        if text == "mode":
            changes[c] = f"coalesce({c}, {mode(c)})"
        elif text == "unknown":
            changes[c] = f"coalesce({c}, 'unknown')"
    return select_with(changes, "deduped", columns)


def bounds_cte(table: str, columns: list[str], method: str) -> str:
    if method == "iqr":
        parts = [
            f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
            f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}"
            for c in columns
        ]
    else:
        parts = [
            f"avg({c}) - 3 * stddev_samp({c}) AS lo_{c}, avg({c}) + 3 * stddev_samp({c}) AS hi_{c}" for c in columns
        ]
    return f"bounds AS (SELECT {', '.join(parts)} FROM {table})"


def lcs_pairs(table: str, columns: list[str]) -> str:
    """All pairs of distinct values per column with their LCS, bit-parallel in a recursive CTE."""
    values = union(
        f"SELECT DISTINCT '{c}' AS col, {strip(c)} AS v FROM {table} WHERE {c} IS NOT NULL" for c in columns
    )
    return f"""WITH RECURSIVE vals AS ({values}),
    pairs AS (SELECT a.col, a.v AS a, b.v AS b FROM vals a JOIN vals b ON a.col = b.col AND a.v < b.v),
    steps AS (
      SELECT col, a, b, 0 AS i, (1::HUGEINT << length(a)) - 1 AS bits FROM pairs
      UNION ALL
      SELECT col, a, b, i + 1,
        (((bits + hit) | (bits - hit)) & ((1::HUGEINT << length(a)) - 1)) AS bits
      FROM (SELECT *, bits & coalesce(list_sum([CASE WHEN substr(a, k::INT, 1) = substr(b, i + 1, 1)
              THEN 1::HUGEINT << (k - 1)::INT ELSE 0::HUGEINT END FOR k IN range(1, length(a) + 1)])::HUGEINT, 0) AS hit
            FROM steps WHERE i < length(b))
    ),
    scored AS (
      SELECT col, a, b, 100.0::DOUBLE * 2 * (length(a) - bit_count(bits)) / (length(a) + length(b)) AS sim
      FROM steps WHERE i = length(b)
    )"""


def close_pairs(table: str, columns: list[str], few: int = 120) -> str:
    """``scored`` pairs of distinct values per column, without scoring all pairs of a column of many values.

    Columns of at most ``few`` values: every pair, by the plain recurrence over rows of prefix lengths. Others: the pairs
    that are at most two insertions or deletions apart, which follow from DuckDB's own edit distance (never above
    that number): one edit is one of them, or two if the lengths agree; two edits are two of them only if the
    lengths differ by two, or if both values are the same after dropping a character each. That is enough
    wherever the third best pair of a column is within two.
    """
    values = union(f"SELECT DISTINCT '{c}' AS col, {strip(c)} AS v FROM {table} WHERE {c} IS NOT NULL" for c in columns)
    dropped = "[substr({v}, 1, k - 1) || substr({v}, k + 1) FOR k IN range(1, length({v}) + 1)]"
    return f"""vals AS MATERIALIZED (SELECT col, v, count(*) OVER (PARTITION BY col) AS k FROM ({values})),
    pairs AS (SELECT a.col, a.v AS a, b.v AS b, a.k, length(a.v) AS la, length(b.v) AS lb FROM vals a JOIN vals b ON a.col = b.col AND a.v < b.v),
    steps AS (
      SELECT col, a, b, 0 AS i, list_transform(range(0, la + 1), lambda x: 0) AS line FROM pairs WHERE k <= {few}
      UNION ALL
      SELECT col, a, b, i + 1, list_reduce(list_prepend([0], list_transform(range(1, length(a) + 1), lambda x: [x::INT])),
        lambda done, x: list_append(done, CASE WHEN substr(a, x[1], 1) = substr(b, i + 1, 1) THEN line[x[1]] + 1 ELSE greatest(line[x[1] + 1], done[x[1]]) END)) AS line
      FROM steps WHERE i < length(b)
    ),
    edits AS (SELECT col, a, b, la, lb, levenshtein(a, b) AS e FROM pairs WHERE k > {few} AND abs(la - lb) <= 2),
    apart AS (
      SELECT col, a, b, la, lb, CASE WHEN e = 1 AND la <> lb THEN 1 WHEN e = 1 OR abs(la - lb) = 2
               OR (la = lb AND list_has_any({dropped.format(v='a')}, {dropped.format(v='b')})) THEN 2 END AS d FROM edits WHERE e <= 2
      UNION ALL SELECT col, a, b, length(a), length(b), length(a) + length(b) - 2 * line[length(a) + 1] FROM steps WHERE i = length(b)
    ),
    scored AS (SELECT col, a, b, 100.0::DOUBLE * (la + lb - d) / (la + lb) AS sim FROM apart WHERE d IS NOT NULL AND la + lb > 0)"""
