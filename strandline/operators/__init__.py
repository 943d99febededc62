"""Operators on DataFrames: geometry, metrics, inference, text, time series, sets, alignment, encoding."""
