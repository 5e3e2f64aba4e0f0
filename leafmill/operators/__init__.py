"""Joins, windows and aggregations over the canonical tables."""
