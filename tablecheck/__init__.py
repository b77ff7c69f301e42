"""Judging and repairing tabular data with Spark."""

from tablecheck.operators.clean import CleanOptions, CleanPlan, change_log, clean, recommended_options
from tablecheck.operators.drift import Drift
from tablecheck.operators.profile import Profile
from tablecheck.operators.profile_state import add_parts, stored_profile
from tablecheck.operators.score import alerts, health_bands, issues, score, score_breakdown, score_presets
from tablecheck.sources.export import export_tables, read_exported, report_frame, write_csv, write_report
from tablecheck.sources.tables import read_csv, read_table, read_tables

__all__ = [
    "CleanOptions", "CleanPlan", "Drift", "Profile", "add_parts", "alerts", "change_log", "clean", "export_tables",
    "health_bands", "issues", "read_csv", "read_exported", "read_table", "read_tables", "recommended_options",
    "report_frame", "score", "score_breakdown", "score_presets", "stored_profile", "write_csv", "write_report",
]
