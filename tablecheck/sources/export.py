"""Writing results: the cleaned table, its companion tables and a JSON report."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.functions.columns import local_frame
from tablecheck.operators.profile import Profile


def write_csv(
    df: DataFrame, path: str, mode: str = "errorifexists", separator: str = ",", encoding: str = "UTF-8"
) -> None:
    """One file per partition, each with a header.

    Quotes are doubled and blanks around text are kept; Spark would drop them while writing.
    """
    writer = df.write.mode(mode).option("header", True).option("sep", separator).option("encoding", encoding)
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}
    writer.options(**keep).csv(path)


def export_tables(cleaned: DataFrame, p: Profile, path: str, fmt: str = "parquet") -> list[str]:
    """``data``, and where they have rows ``missing`` and ``outliers``, as sub-directories.

    ``manifest`` (table, format, rows) is written last, so :func:`read_exported` sees all tables of an export or none.
    A run that failed leaves a folder without manifest; the next one takes another path.
    """
    parts = {"data": cleaned}
    if p.missing_rows():
        parts["missing"] = p.missing_table()
    if p.outlier_rows():
        parts["outliers"] = p.outlier_table()
    for name, table in parts.items():
        if fmt == "csv":
            write_csv(table, f"{path}/{name}")
        else:
            table.write.format(fmt).save(f"{path}/{name}")
    rows = [(name, fmt, _read(p.spark, f"{path}/{name}", fmt, table.schema).count()) for name, table in parts.items()]
    local_frame(p.spark, rows, MANIFEST).coalesce(1).write.json(f"{path}/manifest")
    return list(parts)


MANIFEST = "table string, format string, rows long"


def _read(spark: SparkSession, path: str, fmt: str, schema=None) -> DataFrame:
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    reader = spark.read.option("header", True).options(escape='"', multiLine=True)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_exported(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an export by name. Only what the manifest lists is trusted: without one, the export did not end;
    with fewer or more rows than it says, a table was changed afterwards. Both raise."""
    try:
        listed = spark.read.schema(MANIFEST).json(f"{path}/manifest").collect()  # one row per table
    except AnalysisException as e:
        raise FileNotFoundError(f"{path} holds no finished export") from e
    tables = {r["table"]: _read(spark, f"{path}/{r['table']}", r["format"]) for r in listed}
    for r in listed:
        if (n := tables[r["table"]].count()) != r["rows"]:
            raise ValueError(f"{path}/{r['table']} holds {n} rows, the manifest says {r['rows']}")
    return tables


def report_frame(p: Profile, dataset: str, score: float, level: str, treatment: dict | None = None) -> DataFrame:
    """One row: when, which table, score, level, summary and what cleaning did."""
    s = p.summary_values()
    whole = [k for k, v in s.items() if isinstance(v, int)]
    summary = F.struct(*[F.lit(v).cast("long" if k in whole else "double").alias(k) for k, v in s.items()])

    def literal(v):
        return F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, list) else F.lit(v)

    steps = F.struct(*[literal(v).alias(k) for k, v in (treatment or {"applied": False}).items()])
    base = local_frame(p.spark, [(dataset, float(score), level)], "dataset string, quality_score double, quality_level string")
    return base.select(
        F.current_timestamp().alias("generated_at"), "dataset", "quality_score", "quality_level",
        summary.alias("summary"), steps.alias("treatment_report"),
    )


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    report.coalesce(1).write.mode(mode).json(path)  # one row
