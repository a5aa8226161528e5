"""Functions of the query language as Spark expressions."""
