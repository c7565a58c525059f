"""Window functions. Aggregates are over the whole partition, with or without an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestquery.errors import ExecutionError
from nestquery.functions.types import BIGINT, E, key

from .aggregates import aggregate, total

SEQUENCE = "__sequence"


def sort_key(e: E, descending: bool) -> Column:
    """NULLs come first, or last if descending, as in Spark."""
    c = key(e).col
    return c.desc() if descending else c.asc()


def window(name: str, args: list[E] | None, partition: list[E], order: list[tuple[E, bool]]) -> E:
    by = Window.partitionBy(*[key(p).col for p in partition])
    if name in ("SUM", "AVG", "MIN", "MAX", "COUNT"):
        e = aggregate(name, args[0] if args else None)
        over = e.col.over(by)
        return E(total(over), e.type) if name == "SUM" else E(over, e.type)
    if order:
        spec = by.orderBy(*[sort_key(e, d) for e, d in order])
    elif name in ("RANK", "DENSE_RANK"):  # all rows are peers
        spec = by.orderBy(F.lit(1))
    else:  # the order of the input
        spec = by.orderBy(SEQUENCE)
    if name == "ROW_NUMBER":
        return E(F.row_number().over(spec).cast("bigint"), BIGINT)
    if name == "RANK":
        return E(F.rank().over(spec).cast("bigint"), BIGINT)
    if name == "DENSE_RANK":
        return E(F.dense_rank().over(spec).cast("bigint"), BIGINT)
    steps = args[-1].value if name == "NTILE" or len(args or []) > 1 else 1
    if isinstance(steps, bool) or not isinstance(steps, int) or steps < (1 if name == "NTILE" else 0):
        raise ExecutionError(f"{name} takes a whole constant")
    if name == "NTILE":
        return E(F.ntile(steps).over(spec).cast("bigint"), BIGINT)
    f = F.lag if name == "LAG" else F.lead
    return E(f(args[0].col, steps).over(spec), args[0].type, args[0].whole)


def needs_sequence(name: str, order: list) -> bool:
    return not order and name in ("ROW_NUMBER", "NTILE", "LAG", "LEAD")


def over_all(df: DataFrame, aggregates: dict[str, tuple[str, E | None]]) -> DataFrame:
    """Aggregates over all rows: partial sums meet in one row, which is joined to every row, so that the rows themselves
    stay where they are and are not all moved to one task."""
    one = df.agg(*[aggregate(f, e).col.alias(n) for n, (f, e) in aggregates.items()])
    one = one.select(*[(total(F.col(n)) if f == "SUM" else F.col(n)).alias(n) for n, (f, _) in aggregates.items()])
    return df.crossJoin(F.broadcast(one))  # one row

