"""Structured Streaming: incremental frequencies, scoring of arriving queries."""
