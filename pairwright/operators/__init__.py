"""Operators: DataFrames in, one DataFrame out."""
