"""Operators: each takes and returns Spark DataFrames (or small fitted tables)."""
