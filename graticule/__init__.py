"""A PySpark engine for PromQL queries over many metric sources, and for training-data pipelines."""
