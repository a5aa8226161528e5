"""Metric sources: catalog, importers and derived fixtures."""
