"""Operators over catalogue tables: DataFrames in, DataFrames out."""
