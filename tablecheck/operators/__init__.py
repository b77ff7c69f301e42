"""Operators: each takes DataFrames and returns DataFrames (or bounded per-column figures)."""
