"""Document analytics on Spark: corpora are DataFrames, operators are DataFrame functions."""

__version__ = "0.1.0"
