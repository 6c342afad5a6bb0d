"""Queries that bind operators to tables, with their SQL."""
