"""Operators: pure functions from DataFrames and an as-of time to DataFrames."""
