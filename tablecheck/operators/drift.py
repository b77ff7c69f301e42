"""Comparison of two tables: schema, numeric distributions (KS) and category shares (PSI)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.functions import columns as C
from tablecheck.functions.columns import col, local_frame, measure
from tablecheck.functions.figures import ks_p_value, psi_term
from tablecheck.operators.frequency import value_counts
from tablecheck.operators.quantiles import with_bucket
from tablecheck.sources.storage import materialise

MIN_VALUES = 5  # fixed value: fewer non-null values on a side and a numeric column is skipped
MAX_CATEGORIES = 50  # fixed value: more distinct values in the union and a text column is skipped
ALPHA = 0.05  # fixed value: KS significance
PSI_MODERATE, PSI_SIGNIFICANT = 0.1, 0.2  # fixed values
EDGES = 256  # histogram edges per numeric column in the first KS pass
PIECE_ROWS = 1_000_000  # rows whose values are put in order together in the second pass, about

NUMERIC_SCHEMA = (
    "column string, mean_ref double, mean_new double, delta_pct double, ks_statistic double, "
    "p_value double, drifted boolean"
)


class Drift:
    """Drift of ``new`` against ``ref``. ``method`` is ``"ks"`` or ``"mean_shift"``."""

    def __init__(self, ref: DataFrame, new: DataFrame, method: str = "ks", edges: int = EDGES, piece_rows: int = PIECE_ROWS):
        if method not in ("ks", "mean_shift"):
            raise ValueError(f"unknown method {method!r}")
        self.spark = ref.sparkSession
        self.ref, self.new = C.normalise_missing(ref), C.normalise_missing(new)
        self.method, self.edges, self.piece_rows = method, edges, piece_rows
        self.common = sorted(set(ref.columns) & set(new.columns))
        number_like = (C.NUMERIC, C.BOOLEAN)
        self.numeric = [c for c in self.common if self._class(ref, c) in number_like and self._class(new, c) in number_like]
        self.text = [c for c in self.common if self._class(ref, c) == C.TEXT]

    @staticmethod
    def _class(df: DataFrame, c: str) -> str:
        return C.class_of(df.schema[c].dataType)

    # ── schema ─────────────────────────────────────────────────────────────────────────────

    def schema_diff(self) -> DataFrame:
        ref, new = set(self.ref.columns), set(self.new.columns)
        rows = [(c, "added") for c in sorted(new - ref)] + [(c, "removed") for c in sorted(ref - new)]
        return local_frame(self.spark, rows + [(c, "common") for c in self.common], "column string, change string")

    # ── numeric ────────────────────────────────────────────────────────────────────────────

    @cached_property
    def _both(self) -> DataFrame:
        """Numeric columns of both sides as doubles, tagged; one scan of each table per pass."""

        def side(df: DataFrame, is_new: bool) -> DataFrame:
            return df.select(F.lit(is_new).alias("is_new"), *[C.as_number(df, c).alias(c) for c in self.numeric])

        return side(self.ref, False).unionByName(side(self.new, True))

    @cached_property
    def _moments(self) -> dict[str, dict]:
        """Per column and side: count, mean, std, min, max. Columns with too few values drop out."""
        if not self.numeric:
            return {}
        fs = (F.count, F.avg, F.stddev_samp, F.min, F.max)
        sides = []
        for df in (self.ref, self.new):
            sides.append(C.by_column(df, {c: C.as_number(df, c) for c in self.numeric}, {f.__name__: f("value") for f in fs}))
        ref, new = sides
        enough = [c for c in self.numeric if min(ref[c]["count"], new[c]["count"]) >= MIN_VALUES]
        return {c: {"ref": ref[c], "new": new[c]} for c in enough}

    @cached_property
    def ks_statistics(self) -> dict[str, float]:
        """Exact two-sample KS distance per column.

        A histogram over shared edges gives both distribution functions at the edges and, between
        two edges, a bound on how far apart they can get. Only values between edges whose bound
        beats the best edge are counted one by one, so a small part of the data is shuffled. Their running
        sums are taken in two levels: over pieces of the value range, and over the values of a piece.
        """
        columns = list(self._moments)
        if not columns:
            return {}
        probs = [i / self.edges for i in range(1, self.edges)]
        cuts = self._both.agg(
            *[F.percentile_approx(col(c), probs, 10 * self.edges).alias(f"e{i}") for i, c in enumerate(columns)]
        ).first()
        cells = self._both
        for i, c in enumerate(columns):
            finite = sorted({e for e in cuts[i] if e not in (float("inf"), float("-inf"))})
            cells = with_bucket(cells, c, finite, f"__b{i}")
        long = cells.select(
            "is_new",
            F.explode(
                F.array(*[F.struct(F.lit(i).alias("i"), col(c).alias("v"), col(f"__b{i}").alias("b")) for i, c in enumerate(columns)])
            ).alias("x"),
        ).select("is_new", "x.*").where("v is not null")
        sides = [F.count_if(~F.col("is_new")).alias("ref"), F.count_if(F.col("is_new")).alias("new")]
        hist = long.groupBy("i", "b").agg(*sides).orderBy("i", "b").collect()  # at most `edges` rows per column

        best = dict.fromkeys(range(len(columns)), 0.0)
        inside: list[tuple[int, float, float, float, int, int, int]] = []
        for i, c in enumerate(columns):
            n, m = self._moments[c]["ref"]["count"], self._moments[c]["new"]["count"]
            a = b = 0
            for r in (r for r in hist if r["i"] == i):
                gap = a / n - b / m
                inside.append((i, r["b"], gap + r["ref"] / n, gap - r["new"] / m, r["ref"] + r["new"], a, b))
                a, b = a + r["ref"], b + r["new"]
                best[i] = max(best[i], abs(a / n - b / m))
        deep = [x for x in inside if max(x[2], -x[3]) > best[x[0]]]
        if deep:
            start = {(i, b): (ra, rb) for i, b, _, _, _, ra, rb in deep}
            keys = self.spark.createDataFrame([(i, b, *ab) for (i, b), ab in start.items()], "i int, b double, a0 long, b0 long")
            counts = (
                long.join(F.broadcast(keys), ["i", "b"])  # at most `edges` rows per column
                .groupBy("i", "b", "a0", "b0", "v")
                .agg(*sides)
            )
            pieces = -(-sum(x[4] for x in deep) // self.piece_rows)
            counts = self._in_pieces(counts, pieces)
            w = Window.partitionBy("i", "b", "piece").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
            size = F.create_map(
                *[x for i, c in enumerate(columns) for x in (
                    F.lit(i), F.array(F.lit(float(self._moments[c]["ref"]["count"])), F.lit(float(self._moments[c]["new"]["count"])))
                )]
            )[F.col("i")]
            gap = (F.sum("ref").over(w) + F.col("a0")) / size[0] - (F.sum("new").over(w) + F.col("b0")) / size[1]
            for r in counts.select("i", F.abs(gap).alias("d")).groupBy("i").agg(F.max("d").alias("d")).collect():
                best[r["i"]] = max(best[r["i"]], r["d"])
        return {c: best[i] for i, c in enumerate(columns)}

    @staticmethod
    def _in_pieces(counts: DataFrame, pieces: int) -> DataFrame:
        """Cut the counted values of each cell into pieces of the value range, and add to the cell's start what the
        pieces before hold. The pieces of a table are its range partitions, so none holds more than its share of
        the values however many lie in one cell."""
        ranged = counts.repartitionByRange(max(1, pieces), "i", "b", "v").withColumn("piece", F.spark_partition_id())
        ranged = materialise(ranged, "ks-pieces")
        sums = ranged.groupBy("i", "b", "piece").agg(F.sum("ref").alias("ref"), F.sum("new").alias("new"))
        earlier = Window.partitionBy("i", "b").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        before = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in ("ref", "new")]
        starts = sums.select("i", "b", "piece", *before)
        moved = {"a0": F.col("a0") + F.col("before_ref"), "b0": F.col("b0") + F.col("before_new")}
        return ranged.join(starts, ["i", "b", "piece"]).withColumns(moved)

    def numeric_drift(self) -> DataFrame:
        """One row per comparable numeric column.

        The p-value is the asymptotic one; against an exact small-sample test the flag can differ
        for small samples near the limit.
        """
        ks = self.ks_statistics if self.method == "ks" else {}
        rows = [
            (c, m["ref"]["count"], m["new"]["count"], m["ref"]["avg"], m["new"]["avg"], m["ref"]["stddev_samp"], ks.get(c))
            for c, m in self._moments.items()
        ]
        t = local_frame(
            self.spark, rows, "column string, n long, m long, a double, b double, s double, d double"
        )
        p = ks_p_value(F.col("d"), F.col("n"), F.col("m"))
        shifted = F.abs(F.col("b") - F.col("a")) > 0.2 * F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(1e-9))
        delta = F.when(F.col("a") != 0, F.try_divide(F.col("b") - F.col("a"), F.abs("a")) * 100)
        return t.select(
            "column",
            F.round("a", 4).alias("mean_ref"),
            F.round("b", 4).alias("mean_new"),
            F.round(delta, 2).alias("delta_pct"),
            F.round("d", 4).alias("ks_statistic"),
            F.when(F.col("d").isNotNull(), F.round(p, 4)).alias("p_value"),
            F.when(F.col("d").isNotNull(), p < ALPHA).otherwise(shifted).alias("drifted"),
        )

    # ── categorical ────────────────────────────────────────────────────────────────────────

    @cached_property
    def _few_valued(self) -> list[str]:
        """Text columns that may have at most 50 values; sketches rule the others out unshuffled.

        Small cardinalities are counted almost exactly by the sketch, so four times the limit leaves
        no doubt; what is left is counted exactly.
        """
        found = list(self.text)
        for df in (self.ref, self.new):
            k = measure(df, {c: F.approx_count_distinct(col(c).cast("string")) for c in found})
            found = [c for c in found if k[c] <= 4 * MAX_CATEGORIES]
        return found

    @cached_property
    def _categories(self) -> DataFrame:
        """``(column, value, ref, new)`` counts of non-null cells, one shuffle of merged counts."""

        def side(df: DataFrame, ref: int) -> DataFrame:
            counts = value_counts(df, self._few_valued)
            return counts.select("column", "value", *[(F.col("n") * x).alias(k) for k, x in (("ref", ref), ("new", 1 - ref))])

        both = side(self.ref, 1).unionByName(side(self.new, 0))
        return both.groupBy("column", "value").agg(F.sum("ref").alias("ref"), F.sum("new").alias("new"))

    def categorical_drift(self) -> DataFrame:
        """PSI per text column with 2 to 50 distinct values over both sides."""
        if not self.text or not self._few_valued:
            return local_frame(
                self.spark, [],
                "column string, unique_ref long, unique_new long, psi double, severity string, drifted boolean",
            )
        totals = (
            self._categories.groupBy("column")
            .agg(
                F.count("*").alias("k"), F.sum("ref").alias("n"), F.sum("new").alias("m"),
                F.count_if(F.col("ref") > 0).alias("unique_ref"), F.count_if(F.col("new") > 0).alias("unique_new"),
            )
            .where((F.col("k").between(2, MAX_CATEGORIES)) & (F.col("n") > 0) & (F.col("m") > 0))
        )
        term = psi_term(F.col("ref") / F.col("n"), F.col("new") / F.col("m"))
        psi = (
            self._categories.join(F.broadcast(totals), "column")  # one row per text column
            .groupBy("column", "unique_ref", "unique_new")
            .agg(F.sum(term).alias("psi"))
        )
        severity = (
            F.when(F.col("psi") >= PSI_SIGNIFICANT, "significant").when(F.col("psi") >= PSI_MODERATE, "moderate").otherwise("stable")
        )
        return psi.select(
            "column", "unique_ref", "unique_new", F.round("psi", 4).alias("psi"), severity.alias("severity"),
            (F.col("psi") >= PSI_MODERATE).alias("drifted"),
        )

    def categorical_drift_all(self, top: int = MAX_CATEGORIES - 1) -> DataFrame:
        """PSI of every common text column with values on both sides, whatever their number: the ``top`` most frequent
        values of the reference (ties by value) are classes of their own, all others one more. ``(column, classes, psi, drifted)``.

        Values are counted exactly; only the first ``top`` of each task and column meet in one window.
        """
        if not self.text:
            return local_frame(self.spark, [], "column string, classes long, psi double, drifted boolean")

        def side(df: DataFrame, ref: int) -> DataFrame:
            return value_counts(df, self.text).select("column", "value", *[(F.col("n") * x).alias(k) for k, x in (("ref", ref), ("new", 1 - ref))])

        counts = side(self.ref, 1).unionByName(side(self.new, 0)).groupBy("column", "value").agg(F.sum("ref").alias("ref"), F.sum("new").alias("new"))
        counts = materialise(counts, "value-counts")
        order = Window.partitionBy("column").orderBy(F.desc("ref"), "value")
        first = counts.where("ref > 0").withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).select("column", "value", "ref", "new")
        whole = counts.groupBy("column").agg(F.sum("ref").alias("n"), F.sum("new").alias("m"))
        named = first.groupBy("column").agg(F.collect_list(F.struct("ref", "new")).alias("named"), F.sum("ref").alias("r"), F.sum("new").alias("w"))  # at most ``top`` each
        rows = whole.join(named, "column").where("n > 0 and m > 0")
        others = F.struct((F.col("n") - F.col("r")).alias("ref"), (F.col("m") - F.col("w")).alias("new"))
        classes = F.filter(F.concat("named", F.array(others)), lambda c: c["ref"] + c["new"] > 0)
        psi = F.aggregate(classes, F.lit(0.0), lambda a, c: a + psi_term(c["ref"] / F.col("n"), c["new"] / F.col("m")))
        out = rows.select("column", F.size(classes).cast("long").alias("classes"), psi.alias("psi"))
        return out.select("column", "classes", F.round("psi", 4).alias("psi"), (F.col("psi") >= PSI_MODERATE).alias("drifted"))

    def skipped(self) -> DataFrame:
        """``(column, reason)`` of every column of either table that no drift figure covers."""
        rows = [(c, "only in the new table") for c in sorted(set(self.new.columns) - set(self.common))]
        rows += [(c, "only in the reference") for c in sorted(set(self.ref.columns) - set(self.common))]
        rows += [(c, "neither numeric nor text on both sides") for c in self.common if c not in self.numeric and c not in self.text]
        rows += [(c, f"fewer than {MIN_VALUES} values on a side") for c in self.numeric if c not in self._moments]
        covered = {r["column"] for r in self.categorical_drift().select("column").collect()}
        few = set(self._few_valued)
        left = [c for c in self.text if c not in covered]
        small = {}
        if any(c in few for c in left):
            totals = self._categories.groupBy("column").agg(F.count("*").alias("k"), F.sum("ref").alias("n"), F.sum("new").alias("m"))
            small = {r["column"]: r for r in totals.collect()}
        for c in left:
            r = small.get(c)
            if c not in few or (r and r["k"] > MAX_CATEGORIES):
                rows.append((c, f"more than {MAX_CATEGORIES} different values"))
            else:
                rows.append((c, "no values on a side" if not r or not r["n"] or not r["m"] else "a single value"))
        return local_frame(self.spark, rows, "column string, reason string")

    # ── reports ────────────────────────────────────────────────────────────────────────────

    def summary(self) -> DataFrame:
        rows = [df.agg(F.count("*")).first()[0] for df in (self.ref, self.new)]
        drifted = [t.where("drifted").count() for t in (self.numeric_drift(), self.categorical_drift())]
        return local_frame(
            self.spark, [(*rows, *drifted, self.method)],
            "rows_ref long, rows_new long, drifted_numeric long, drifted_categorical long, method string",
        )

    def ranked(self) -> DataFrame:
        """Drifted columns, strongest first within their kind, then the stable ones."""
        numeric = self.numeric_drift().select(F.lit("numeric").alias("kind"), "column", F.col("ks_statistic").alias("strength"), "drifted")
        text = self.categorical_drift().select(F.lit("categorical").alias("kind"), "column", F.col("psi").alias("strength"), "drifted")
        w = Window.partitionBy("kind").orderBy(F.desc("drifted"), F.desc_nulls_last("strength"), "column")
        both = numeric.unionByName(text)  # one row per column
        return both.withColumn("rank", F.row_number().over(w)).orderBy("kind", "rank")

    def top_numeric(self) -> str | None:
        r = self.numeric_drift().where("drifted").orderBy(F.desc_nulls_last("ks_statistic"), "column").first()
        return r["column"] if r else None

    def top_category(self) -> str | None:
        r = self.categorical_drift().where("drifted").orderBy(F.desc("psi"), "column").first()
        return r["column"] if r else None

    def histogram(self, column: str | None = None, bins: int = 30) -> DataFrame:
        """``(source, bin, low, high, n)`` of both sides over shared equal-width bins."""
        from tablecheck.operators.insights import bin_number, bin_edges

        column = column or self.top_numeric()
        empty = local_frame(self.spark, [], "source string, bin int, low double, high double, n long")
        if column is None:
            return empty
        v = C.finite(col(column))
        m = measure(self._both, {"low": F.min(v), "high": F.max(v)})
        if m["low"] is None:
            return empty
        low, high = m["low"], m["high"]
        source = F.when(F.col("is_new"), "current").otherwise("reference")
        counts = (
            self._both.where(v.isNotNull())
            .groupBy(source.alias("source"), bin_number(v, low, high, bins).alias("bin"))
            .agg(F.count("*").alias("n"))
        )
        return counts.select("source", "bin", *bin_edges(F.col("bin"), low, high, bins), "n")

    def category_compare(self, column: str | None = None, top: int = 12) -> DataFrame:
        """``(source, category, frequency)``: the commonest categories per side, null counted as one."""
        column = column or self.top_category()
        if column is None:
            return local_frame(self.spark, [], "source string, category string, n long, frequency double")

        def side(df: DataFrame, source: str) -> DataFrame:
            return df.select(F.lit(source).alias("source"), F.coalesce(col(column).cast("string"), F.lit("None")).alias("category"))

        counts = (
            side(self.ref, "reference").unionByName(side(self.new, "current")).groupBy("source", "category").agg(F.count("*").alias("n"))
        )
        # Totals come from a grouped sum, so no window ever holds all categories of a side.
        totals = counts.groupBy("source").agg(F.sum("n").alias("total"))
        w = Window.partitionBy("source").orderBy(F.desc("n"), "category")
        best = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
        return best.join(F.broadcast(totals), "source").select(  # two rows
            "source", "category", "n", F.round(F.col("n") / F.col("total"), 6).alias("frequency")
        )
