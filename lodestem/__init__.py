"""Deterministic text-similarity and ranking analytics on Spark DataFrames."""
