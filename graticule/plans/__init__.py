"""Queries as trees: syntax, text, types and the description of how a query splits."""
