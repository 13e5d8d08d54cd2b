"""Operators of the ranking engine: DataFrames in, DataFrames out."""
