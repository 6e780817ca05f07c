"""Operators on DataFrames, usable without the query language."""
