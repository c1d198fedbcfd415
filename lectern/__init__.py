"""Lectern: spoken-document preparation on PySpark DataFrames."""
