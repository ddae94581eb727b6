"""Operators: pure functions from DataFrames to DataFrames, each over all keys at once."""
