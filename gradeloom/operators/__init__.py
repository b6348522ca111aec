"""Joins, reports, samples, text operators and models on DataFrames."""
