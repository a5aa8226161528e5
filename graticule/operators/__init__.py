"""Compilation of query trees to DataFrames."""
