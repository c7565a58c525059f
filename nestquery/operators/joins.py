"""Equality joins whose NULL keys match each other. Which side is broadcast, hashed or sorted is left to Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestquery.errors import ExecutionError
from nestquery.functions.types import E, key, variant_key


def same_key(a: E, b: E) -> Column:
    """NULL-safe equality, which stays an equi-join; numbers of different types are compared as doubles."""
    if not (a.scalar and b.scalar):
        raise ExecutionError("a join key has to be a scalar")
    if "variant" in (a.family, b.family):
        x, y = (key(e).col if e.family == "variant" else variant_key(e) for e in (a, b))
        return x.eqNullSafe(y)
    if "null" in (a.family, b.family) or a.family != b.family:  # nothing but NULLs can match
        return F.when(a.col.isNull(), 0).otherwise(1).eqNullSafe(F.when(b.col.isNull(), 0).otherwise(2))
    if a.type != b.type and a.family == "number":
        return a.col.cast("double").eqNullSafe(b.col.cast("double"))
    return a.col.eqNullSafe(b.col)


def join(left: DataFrame, right: DataFrame, keys: list[tuple[E, E]], kind: str) -> DataFrame:
    return left.join(right, reduce(lambda a, b: a & b, [same_key(x, y) for x, y in keys]), kind)
