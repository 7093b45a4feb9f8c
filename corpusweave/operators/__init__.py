"""Operators: DataFrames in, DataFrames out, one module per family of decisions."""
