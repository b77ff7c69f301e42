"""Reading delimited files the way a table profiler expects them, and other formats as they are.

The file is first read as text: encoding and field separator are detected, every field is read as a
string, null values are recognised, and only then types are chosen from one aggregate over all rows.
"""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, IllegalArgumentException, SparkRuntimeException, UnknownException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecheck.functions import columns as C
from tablecheck.functions import text as X
from tablecheck.functions.columns import col
from tablecheck.sources.records import quoted_records

SEPARATORS = [",", ";", "\t", "|"]  # fixed value: separators that are told apart

# Byte-order marks as they stand before the first line, and the bytes of a line break.
MARKS = {"FFFE": "UTF-16LE", "FEFF": "UTF-16BE"}
# Windows-1252 is ISO-8859-1 but for these characters (five bytes are undefined and stay).
_CONTROLS = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
WINDOWS_FROM, WINDOWS_TO = "".join(map(chr, _CONTROLS)), bytes(_CONTROLS).decode("windows-1252")

ALL_NULL = "null"

_READ_ERRORS = (AnalysisException, IllegalArgumentException, SparkRuntimeException, UnknownException)


@dataclass
class LoadResult:
    """``df`` is None exactly when ``error`` says why."""

    df: DataFrame | None
    error: str | None = None
    meta: dict[str, str] = field(default_factory=dict)


def detect_encoding(spark: SparkSession, path: str) -> str:
    """The encoding of a file: by its byte-order mark; else ``UTF-8`` if every line is valid UTF-8; else
    ``windows-1252`` if a byte from 0x80 to 0x9F occurs (control characters in ISO-8859-1), else ``ISO-8859-1``.

    The text source hands out the raw bytes of each line, so this is one map-only pass over all of
    it; a single bad byte at the very end still counts.
    """
    lines = spark.read.text(path)
    first = lines.select(F.hex(F.substring(F.col("value").cast("binary"), 1, 2))).first()
    if first and first[0] in MARKS:
        return MARKS[first[0]]
    high = _latin(F.col("value")).rlike("[\\x80-\\x9f]")
    bad, windows = lines.agg(F.count_if(~F.is_valid_utf8("value")), F.count_if(high)).first()
    return "UTF-8" if not bad else "windows-1252" if windows else "ISO-8859-1"


def _latin(c: Column) -> Column:
    return F.decode(c.cast("binary"), "ISO-8859-1")


def _to_windows(c: Column) -> Column:
    return F.translate(c, WINDOWS_FROM, WINDOWS_TO)


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """All lines as text, in a column ``line``."""
    wide = encoding.startswith("UTF-16")
    reader = spark.read.option("encoding", encoding).option("lineSep", "\n") if wide else spark.read
    raw = reader.text(path)
    if wide:
        decoded = F.decode(F.col("value").cast("binary"), encoding)
    elif encoding == "UTF-8":
        decoded = F.col("value")
    else:
        decoded = _to_windows(_latin(F.col("value"))) if encoding == "windows-1252" else _latin(F.col("value"))
    return raw.select(F.rtrim(F.ltrim(decoded, F.lit("\ufeff")), F.lit("\r")).alias("line"))


def _head(spark: SparkSession, path: str, encoding: str, lines: int) -> list[str]:
    """First lines of the file that are not blank, each of them whole."""
    return [r[0] for r in _lines(spark, path, encoding).filter(F.col("line").rlike(r"\S")).limit(lines).collect()]


def sniff_separator(lines: list[str]) -> str:
    """The separator whose field count is most often the same over the sample; a comma if none is.

    Fields are counted with quoting respected. Among equally regular candidates the one with more
    fields wins, then the order of ``SEPARATORS``.
    """
    sample = [line for line in lines if line.strip()]
    best, best_rank = ",", (0.0, 0)
    for sep in SEPARATORS:
        counts = [len(next(csv.reader([line], delimiter=sep), [])) for line in sample]
        if not counts:
            break
        usual = max(sorted(set(counts), reverse=True), key=counts.count)
        rank = (counts.count(usual) / len(counts), usual)
        if usual > 1 and rank > best_rank:
            best, best_rank = sep, rank
    return best


def separator_figures(spark: SparkSession, path: str, encoding: str = "UTF-8") -> dict[str, tuple[int, int, int]]:
    """Per separator over all lines that are not blank: (lines, their most frequent number of fields, lines that have it).

    A field in quotes counts as one; a quote opens at the start of a field. One scan: a task sends its counts of lines by
    separator and number of fields, four rows come to the driver. A record with line breaks in quotes is several lines.
    """
    def fields(sep: str) -> Column:
        mark = re.escape(sep)
        bare = F.regexp_replace("line", f'(^|{mark})(?:"[^"]*+(?:"|$))++', "$1")
        return F.length(bare) - F.length(F.translate(bare, sep, "")) + 1

    counts = F.array(*[F.struct(F.lit(i).alias("sep"), fields(sep).alias("fields")) for i, sep in enumerate(SEPARATORS)])
    lines = _lines(spark, path, encoding).filter(F.col("line").rlike(r"\S")).select(F.explode(counts).alias("c"))
    found = lines.groupBy("c.sep", "c.fields").count().groupBy("sep").agg(F.sum("count").alias("lines"), F.max(F.struct("count", "fields")).alias("usual"))
    return {SEPARATORS[r["sep"]]: (r["lines"], r["usual"]["fields"], r["usual"]["count"]) for r in found.collect()}


def detect_separator(spark: SparkSession, path: str, encoding: str = "UTF-8", lines: int | None = None) -> str:
    """By the rule of :func:`sniff_separator`, over all lines of the file or the first ``lines``."""
    if lines is not None:
        return sniff_separator(_head(spark, path, encoding, lines))
    best, best_rank = ",", (0.0, 0)
    figures = separator_figures(spark, path, encoding)
    for sep in SEPARATORS:
        total, usual, having = figures.get(sep, (0, 0, 0))
        if usual > 1 and (having / total, usual) > best_rank:
            best, best_rank = sep, (having / total, usual)
    return best


def _header_names(names: list[str], case_sensitive: bool) -> list[str]:
    """Header fields as column names: empty ones numbered, repeated ones suffixed ``.1``, ``.2``.

    Spark resolves names without regard to case unless told otherwise, so ``Name`` and ``name``
    count as repeated then.
    """
    taken: set[str] = set()
    out = []
    for i, name in enumerate(names):
        base = name if name.strip() else f"Unnamed: {i}"
        candidate, n = base, 0
        while (candidate if case_sensitive else candidate.lower()) in taken:
            n += 1
            candidate = f"{base}.{n}"
        taken.add(candidate if case_sensitive else candidate.lower())
        out.append(candidate)
    return out


def null_values_to_null(df: DataFrame) -> DataFrame:
    """The exact spellings of "no value" that a table reader drops while reading."""
    return df.select(*[F.when(~col(c).isin(X.CSV_NULL_VALUES), col(c)).alias(c) for c in df.columns])


def infer_types(df: DataFrame) -> dict[str, str]:
    """``long``, ``double``, ``boolean``, ``string`` or ``null`` per all-string column.

    Judged on every row: a column is numeric only if each non-null cell parses; one blank makes it
    text. Integers with nulls become double, booleans with nulls and dates stay text.
    """
    cells = C.long_form(df, {c: col(c) for c in df.columns})
    v = F.trim("value")
    whole = F.when(v.rlike(X.INTEGER), v.try_cast("long"))
    rows = (
        cells.groupBy("column")
        .agg(
            F.count("*").alias("rows"),
            F.count("value").alias("n"),
            F.count(whole).alias("whole"),
            F.count_if(v.rlike(X.NUMBER)).alias("number"),
            F.count_if(F.col("value").isin("True", "TRUE", "true", "False", "FALSE", "false")).alias("bool"),
        )
        .collect()
    )
    out = dict.fromkeys(df.columns, ALL_NULL)
    for r in rows:
        full = r["n"] == r["rows"]
        if r["n"] == 0:
            kind = ALL_NULL
        elif r["whole"] == r["n"]:
            kind = "long" if full else "double"
        elif r["number"] == r["n"]:
            kind = "double"
        elif r["bool"] == r["n"] and full:
            kind = "boolean"
        else:
            kind = "string"
        out[r["column"]] = kind
    return out


def cast_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    def cast(c: str):
        if types[c] == "string":
            return col(c)
        # A column without any value is read as numbers.
        return F.trim(col(c)).cast("double" if types[c] == ALL_NULL else types[c]).alias(c)

    return df.select(*[cast(c) for c in df.columns])


def read_csv(
    spark: SparkSession,
    path: str,
    *,
    separator: str | None = None,
    encoding: str | None = None,
    multi_line: bool = False,
    sample_lines: int | None = None,
) -> LoadResult:
    """Read a delimited file or directory of files with a header line.

    Files are split over tasks by Spark whatever their size. ``multi_line`` allows line breaks within
    quotes, which costs one more scan (:func:`quoted_records`; UTF-16 files are then read by one task each). The separator is judged by all
    lines, or the first ``sample_lines`` that are not blank. A row with more fields than the header, empty ones included, makes the file malformed; shorter
    rows are filled with nulls.
    """
    meta: dict[str, str] = {}
    try:
        encoding = encoding or detect_encoding(spark, path)
        first = _head(spark, path, encoding, 1)
        meta["encoding"] = encoding
        if not first:
            return LoadResult(None, "The file is empty.", meta)
        separator = separator or detect_separator(spark, path, encoding, sample_lines)
        meta["separator"] = separator
        header = next(csv.reader(first, delimiter=separator))
        names = _header_names(header, spark.conf.get("spark.sql.caseSensitive") == "true")
        # A row with too few or too many fields also comes back whole; its fields are counted then.
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names) + 1)])
        extra = f"c{len(names)}"
        raw = (
            spark.read.schema(schema)
            .option("header", True).option("enforceSchema", True).option("sep", separator)
            .option("encoding", "ISO-8859-1" if encoding == "windows-1252" else encoding).option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line).option("maxCharsPerColumn", -1).option("maxColumns", max(20480, len(names) + 2))
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", extra)
        )
        if encoding.startswith("UTF-16") and not multi_line:
            raw = raw.option("lineSep", "\n")
        if multi_line and not encoding.startswith("UTF-16"):
            raw = _from_records(spark, path, "ISO-8859-1" if encoding == "windows-1252" else encoding, schema, separator)
        else:
            raw = raw.csv(path)
        if encoding.startswith("UTF-16"):  # a carriage return before the line break is not cut off there
            last = f"c{len(names) - 1}"
            raw = raw.withColumn(last, F.regexp_replace(last, r"\r\z", ""))
        if encoding == "windows-1252":
            raw = raw.select(*[_to_windows(col(c)).alias(c) for c in raw.columns])
        if raw.isEmpty():
            return LoadResult(None, "The file has a header but no rows.", meta)
        plain = F.regexp_replace(extra, r'"(?:[^"]|"")*"', "")
        surplus = F.char_length(F.regexp_replace(plain, f"[^{re.escape(separator)}]", "")) >= len(names)
        cells = null_values_to_null(raw.withColumn(extra, F.when(surplus, "surplus")))
        types = infer_types(cells)
        if types.pop(extra) != ALL_NULL:
            return LoadResult(None, f"Malformed file: a row has more than {len(names)} fields.", meta)
        df = cells.drop(extra).toDF(*names)
        return LoadResult(cast_types(df, dict(zip(names, types.values()))), None, meta)
    except _READ_ERRORS as e:
        return LoadResult(None, f"The file cannot be read: {e.getCondition() or e}", meta)
    except csv.Error as e:
        return LoadResult(None, f"Malformed file: {e}", meta)


def _from_records(spark: SparkSession, path: str, encoding: str, schema: T.StructType, separator: str) -> DataFrame:
    """The fields of all records but the header of each file, the last column as for rows with a wrong number of fields."""
    records = quoted_records(spark, path, encoding)
    extra = schema.fieldNames()[-1]
    options = {"sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": extra, "maxCharsPerColumn": "-1", "maxColumns": str(max(20480, len(schema) + 1)), "multiLine": "true"}
    rows = records.where("not first")
    return rows.select(F.from_csv("record", ", ".join(f"{c} STRING" for c in schema.fieldNames()), options).alias("r")).select("r.*")


def read_table(
    spark: SparkSession, path: str, fmt: str | None = None, persist: bool = False, **options
) -> LoadResult:
    """A table from CSV (detected as above), Parquet, ORC, JSON or the catalog (``fmt="table"``).

    ``persist`` keeps it in memory and on disk for the passes to come, which pays for small text files;
    large columnar tables are better read again.
    """
    result = _read(spark, path, fmt, options)
    if persist and result.df is not None:
        result.df.persist()
    return result


def _read(spark: SparkSession, path: str, fmt: str | None, options: dict) -> LoadResult:
    fmt = fmt or next((f for f in ("parquet", "orc", "json") if path.rstrip("/").endswith(f".{f}")), "csv")
    if fmt == "csv":
        return read_csv(spark, path, **options)
    try:
        df = spark.table(path) if fmt == "table" else spark.read.format(fmt).options(**options).load(path)
    except _READ_ERRORS as e:
        return LoadResult(None, f"The table cannot be read: {e.getCondition() or e}")
    if not df.columns:
        return LoadResult(None, "The table has no columns.")
    if df.isEmpty():
        return LoadResult(None, "The table has no rows.")
    return LoadResult(C.normalise_missing(df), None, {"format": fmt})


def read_tables(spark: SparkSession, paths: dict[str, str], **options) -> dict[str, LoadResult]:
    """Several tables by name, each also a temporary view; a failing one does not stop the rest."""
    out = {}
    for name, path in paths.items():
        out[name] = read_table(spark, path, **options)
        if out[name].df is not None:
            out[name].df.createOrReplaceTempView(name)
    return out
