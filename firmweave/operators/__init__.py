"""Operators: pure functions from DataFrames (plus parameters) to DataFrames."""
