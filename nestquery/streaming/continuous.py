"""A query as a Structured Streaming plan.

Projections, filters, joins with static sources and grouped aggregates run continuously. What needs the end of its input
(ORDER BY without GROUP BY, LIMIT, DISTINCT after them, window functions) is refused when the query is compiled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from nestquery.errors import ExecutionError
from nestquery.plans import tree as t
from nestquery.plans.compiler import ROOT, compile_query
from nestquery.plans.params import bind
from nestquery.plans.parser import parse
from nestquery.settings import Settings


def stream(sql: str, sources: DataFrame | Mapping[str, DataFrame], params: Mapping[str, Any] | Sequence[Any] | None = None, watermark: tuple[str, str] | None = None, settings: Settings = Settings()) -> DataFrame:
    """The streaming result. ``watermark`` is (column, delay) of the streaming sources; with it, the state of groups that
    hold the column is dropped once they are late."""
    query = bind(parse(sql, settings.limits), params, settings.limits)
    frames = {ROOT: sources} if isinstance(sources, DataFrame) else dict(sources)
    if any(df.isStreaming for df in frames.values()):
        for q in (n for n in t.walk(query) if isinstance(n, t.Query)):
            if q.limit is not None or (q.order and not q.group):
                raise ExecutionError("a stream has no end: ORDER BY needs GROUP BY, and LIMIT cannot stand")
        if any(isinstance(n, t.Win) for n in t.walk(query)):
            raise ExecutionError("window functions need the whole input")
    if watermark:
        frames = {k: df.withWatermark(*watermark) if df.isStreaming and watermark[0] in df.columns else df for k, df in frames.items()}
    return compile_query(query, frames, settings)
