"""Expressions of the dialect as Spark columns."""
