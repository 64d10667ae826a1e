"""Whole operators on DataFrames: joins, matching, field alignment, aggregation."""
