"""Streaming variants of the run-log operators."""
