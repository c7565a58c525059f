"""DISTINCT after ORDER BY and LIMIT: the first of equal rows stays, in the order that the rows had."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestquery.functions.types import E, holds_variant, identity
from nestquery.plans.scope import quoted


def distinct(df: DataFrame, ordered: bool) -> DataFrame:
    plain = not any(holds_variant(f.dataType) for f in df.schema.fields)
    if plain and not ordered:
        return df.distinct()
    names = df.columns
    place = df.withColumn("__place", F.monotonically_increasing_id())  # rises through the partitions of a sorted result
    if plain:
        first = place.groupBy(*[quoted(n) for n in names]).agg(F.min("__place").alias("__place"))
        return first.orderBy("__place").select(*[quoted(n) for n in names])
    # values of several types are told apart by what identifies them; the first row stands for its equals
    keys = [identity(E(F.col(quoted(f.name)), f.dataType)).alias(f"__key{k}") for k, f in enumerate(df.schema.fields)]
    row = F.min_by(F.struct(*[quoted(n) for n in names]), "__place").alias("__row")
    first = place.groupBy(*keys).agg(F.min("__place").alias("__place"), row)
    return (first.orderBy("__place") if ordered else first).select("__row.*")
