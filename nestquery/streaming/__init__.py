"""Queries on unbounded sources: the same dialect on a streaming DataFrame."""

from .continuous import stream

__all__ = ["stream"]
