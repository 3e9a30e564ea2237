"""Tidemark: ordered-series fitness analytics on Spark DataFrames."""
