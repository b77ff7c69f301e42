"""Quality score, ranked problems and alerts, from the figures of a profile."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tablecheck.functions.columns import local_frame
from tablecheck.functions.figures import round_half_up
from tablecheck.operators.profile import Profile

# Points deducted per percent, largest deduction per dimension, and level limits.
DEFAULT_WEIGHTS = {
    "missing": 1.5, "duplicates": 2.0, "constant": 0.8, "placeholder": 0.8, "type": 1.0, "outlier": 0.5,
}
CAPS = {
    "missing": 30.0, "duplicates": 20.0, "constant": 10.0, "placeholder": 10.0, "type": 15.0, "outlier": 10.0,
}
LEVELS = [(90, "excellent"), (75, "good"), (55, "attention"), (0, "critical")]

# Weights per domain.
PRESETS = {
    "general": DEFAULT_WEIGHTS,
    "financial": {
        "missing": 2.5, "duplicates": 3.0, "constant": 0.8, "placeholder": 1.2, "type": 1.5, "outlier": 1.0,
    },
    "marketing": {
        "missing": 1.0, "duplicates": 1.5, "constant": 0.5, "placeholder": 0.8, "type": 0.8, "outlier": 0.3,
    },
    "hr": {
        "missing": 2.0, "duplicates": 2.5, "constant": 0.6, "placeholder": 1.0, "type": 1.0, "outlier": 0.4,
    },
    "logistics": {
        "missing": 1.8, "duplicates": 2.0, "constant": 0.7, "placeholder": 0.9, "type": 1.2, "outlier": 0.8,
    },
}

_SEVERITY = {"high": 0, "medium": 1, "low": 2}


def penalty_inputs(p: Profile) -> dict[str, float]:
    """The six percentages a score is made of."""
    p.gather("duplicate_rows", "text_figures", "numeric_figures")
    columns = max(len(p.columns), 1)
    cells = max(p.rows * columns, 1)
    summary = p.summary_values()
    outliers = [pct for _, _, pct, _, _ in p.outlier_rows()]
    return {
        "missing": summary["missing_cells_pct"],
        "duplicates": summary["duplicate_rows_pct"],
        "constant": 100.0 * len(p.constant_columns) / columns,
        "placeholder": 100.0 * sum(n for _, n, _ in p.placeholder_rows()) / cells,
        "type": 100.0 * len(p.suggestion_rows()) / columns,
        "outlier": sum(outliers) / len(outliers) if outliers else 0.0,
    }


def score_of(inputs: dict[str, float], weights: dict[str, float] | None = None) -> tuple[float, str, dict[str, float]]:
    """``(score, level, deduction per dimension)``; given weights override the general ones."""
    used = {**DEFAULT_WEIGHTS, **(weights or {})}
    cuts = {k: min(inputs[k] * used[k], CAPS[k]) for k in DEFAULT_WEIGHTS}
    score = round_half_up(min(100.0, max(0.0, 100.0 - sum(c for c in cuts.values() if c > 0))), 1)
    return score, level_of(score), {k: -round_half_up(c, 1) for k, c in cuts.items() if c > 0}


def level_of(score: float) -> str:
    return next(name for limit, name in LEVELS if score >= limit)


def score(p: Profile, weights: dict[str, float] | None = None) -> DataFrame:
    value, level, _ = score_of(penalty_inputs(p), weights)
    return local_frame(p.spark, [(value, level)], "score double, level string")


def score_presets(p: Profile) -> DataFrame:
    inputs = penalty_inputs(p)
    rows = [(name, *score_of(inputs, weights)[:2]) for name, weights in PRESETS.items()]
    return local_frame(p.spark, rows, "preset string, score double, level string")


def score_breakdown(p: Profile, weights: dict[str, float] | None = None) -> DataFrame:
    cuts = score_of(penalty_inputs(p), weights)[2]
    return local_frame(p.spark, list(cuts.items()), "dimension string, deduction double")


@dataclass(frozen=True)
class Rule:
    """A kind of problem: where it is read off, how bad it is, what is said and advised.

    ``found`` lists the cases, worst first; ``serious`` tells the urgent ones; ``text`` describes a case.
    """

    issue: str
    found: Callable[[Profile], list]
    text: Callable
    advice: str
    serious: Callable = lambda case: False


# A quarter of a column missing, and more than a hundred copies, are urgent.
RULES = [
    Rule("missing data", lambda p: sorted(p.missing_rows(), key=lambda r: -r[2]), lambda r: f"column {r[0]} is {r[2]}% missing",
         "impute, or drop the column if it carries little signal", lambda r: r[2] >= 25),
    Rule("duplicate rows", lambda p: [p.duplicate_rows] if not p.empty and p.duplicate_rows else [], lambda n: f"{n} duplicate rows", "drop exact duplicates", lambda n: n > 100),
    Rule("constant column", lambda p: p.constant_columns, lambda c: f"column {c} never varies", "drop before modelling"),
    Rule("type mismatch", lambda p: sorted(p.suggestion_rows(), key=lambda r: -r[3]), lambda r: f"column {r[0]} looks {r[2]} ({r[3]}% of values)", "convert before analysis"),
    Rule("suspicious cardinality", lambda p: p.cardinality_rows(), lambda r: f"column {r[0]}: {r[3]}, {r[2]}% unique", "check whether it is a key or a coded category"),
    Rule("near-duplicate text", lambda p: list(dict.fromkeys(r[0] for r in p.near_dup_rows())), lambda c: f"column {c} has values that are almost alike", "standardise the values"),
]


def issue_rows(p: Profile, most: dict[str, int] | None = None) -> list[tuple[str, str, str, str]]:
    """``(priority, issue, details, action)``, most urgent first.

    ``most`` limits the cases listed of an issue; what it leaves out is counted in a row of its own.
    """
    p.gather("duplicate_rows", "text_figures", "distinct")
    rows: list[tuple[str, str, str, str]] = []
    for rule in RULES:
        cases = rule.found(p)
        limit = (most or {}).get(rule.issue, len(cases))
        rows += [("high" if rule.serious(x) else "medium", rule.issue, rule.text(x), rule.advice) for x in cases[:limit]]
        if len(cases) > limit:
            rows.append(("medium", rule.issue, f"{len(cases) - limit} more", rule.advice))
    if not rows:
        rows.append(("low", "no critical problem", "nothing blocking was found", "go on to analysis"))
    return sorted(rows, key=lambda r: (_SEVERITY[r[0]], r[1]))


def issues(p: Profile, most: dict[str, int] | None = None) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(issue_rows(p, most), 1)]
    return local_frame(p.spark, rows, "rank int, priority string, issue string, details string, action string")


def alerts(p: Profile) -> DataFrame:
    value, _, _ = score_of(penalty_inputs(p))  # before the summary: it measures side by side
    s = p.summary_values()
    rows = [
        ("error", "score", "critical quality: treat before use") if value < 55
        else ("warning", "score", "moderate quality: review missing data and duplicates") if value < 75
        else ("ok", "score", "quality is adequate for analysis")
    ]
    if s["missing_cells_pct"] > 20:
        rows.append(("warning", "missing", f"{s['missing_cells_pct']:.2f}% of cells are missing"))
    if s["duplicate_rows_pct"] > 5:
        rows.append(("warning", "duplicates", f"{s['duplicate_rows_pct']:.2f}% of rows are duplicates"))
    if p.constant_columns:
        rows.append(("info", "constant", "constant columns: " + ", ".join(p.constant_columns)))
    for c, pattern, pct, _ in p.pattern_rows():
        rows.append(("info", "pattern", f"column {c} looks like {pattern} ({pct:.1f}%)"))
    return local_frame(p.spark, rows, "severity string, topic string, message string")


def health_bands(p: Profile) -> DataFrame:
    """Traffic-light band per headline figure."""
    s = p.summary_values()

    def band(x: float, red: float, amber: float) -> str:
        return "red" if x > red else "amber" if x > amber else "green"

    rows = [
        ("missing_cells", s["missing_cells"], s["missing_cells_pct"], band(s["missing_cells_pct"], 20, 5)),
        ("duplicate_rows", s["duplicate_rows"], s["duplicate_rows_pct"], band(s["duplicate_rows_pct"], 5, 1)),
    ]
    return local_frame(p.spark, rows, "figure string, count long, pct double, band string")


