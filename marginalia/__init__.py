"""Ranked full-text search and bulk text processing on PySpark DataFrames."""
