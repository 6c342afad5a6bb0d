"""Operators on DataFrames: guards, screens, joins, aggregates, windows, allocation, graphs."""
