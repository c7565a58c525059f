"""Relational operators of the dialect on DataFrames."""
