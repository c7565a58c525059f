"""Aggregates, by Spark's partial and final aggregation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nestquery.errors import ExecutionError
from nestquery.functions.types import BIGINT, DOUBLE, E, double, key, null


def total(c: Column) -> Column:
    """A sum of nothing is 0."""
    return F.coalesce(c, F.lit(0.0))


def aggregate(name: str, arg: E | None) -> E:
    """COUNT of no argument counts rows; SUM and AVG are of doubles; MIN and MAX take any scalar and ignore NULLs. A SUM
    is NULL if it is of nothing, until ``total``."""
    if name == "COUNT":
        return E(F.count(F.lit(1) if arg is None else arg.col), BIGINT)
    if arg is None:
        raise ExecutionError(f"{name} takes a column")
    if name == "SUM":
        return E(F.sum(double(arg)), DOUBLE)
    if name == "AVG":
        return E(F.avg(double(arg)), DOUBLE)
    if not arg.scalar:
        return null()
    f = F.min_by if name == "MIN" else F.max_by
    if arg.family == "variant":
        return E(f(arg.col, key(arg).col), arg.type)
    return E((F.min if name == "MIN" else F.max)(arg.col), arg.type, arg.whole)


def finished(name: str, c: Column) -> Column:
    return total(c) if name == "SUM" else c
