"""Operators: they take and return DataFrames."""
