"""Queries on sources: once, prepared, or on an engine that keeps its sources and results."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import lru_cache
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from nestquery import sinks
from nestquery.errors import ExecutionError, NestQueryError
from nestquery.plans import tree as t
from nestquery.plans.compiler import ROOT, compile_query
from nestquery.plans.params import bind
from nestquery.plans.parser import parse
from nestquery.settings import Limits, Settings
from nestquery.sources import from_json

Source = DataFrame | str | list | dict
Values = Mapping[str, Any] | Sequence[Any] | None


class Sources(dict):
    """Sources by name, each a DataFrame, JSON text or parsed JSON: ``Sources(orders=..., customers=...)``."""


@contextmanager
def exact_names(spark: SparkSession) -> Iterator[None]:
    """Field names that differ in case only are different fields. Plans are analysed when they are made, so the session's
    setting comes back at once."""
    name = "spark.sql.caseSensitive"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _container(text: str) -> bool:
    try:
        return text.lstrip()[:1] in ("[", "{") and isinstance(json.loads(text), (list, dict))
    except ValueError:
        return False


def _named(values: list[Any]) -> bool:
    return any(isinstance(v, DataFrame) for v in values) or (bool(values) and all(isinstance(v, str) and _container(v) for v in values))


def sources_of(spark: SparkSession, data: Source | Mapping[str, Source], settings: Settings) -> dict[str, DataFrame]:
    """Named sources. ``Sources`` names its sources, and so does a mapping with DataFrames, or whose values are all whole JSON
    arrays and objects as text. Anything else is the root source ``$r``: a DataFrame, JSON text, or parsed JSON."""
    one = lambda x: x if isinstance(x, DataFrame) else from_json(spark, x, settings.json, settings.codec)
    with exact_names(spark):
        if isinstance(data, Sources) or (isinstance(data, Mapping) and _named(list(data.values()))):
            return {k: one(v) for k, v in data.items()}
        return {ROOT: one(data)}


@lru_cache(maxsize=256)
def _parsed(sql: str, limits: Limits) -> t.Query:
    return parse(sql, limits)


class PreparedQuery:
    """A query that is parsed once and runs on any sources, with any parameters."""

    def __init__(self, sql: str, settings: Settings = Settings()) -> None:
        self.sql, self.settings = sql, settings
        self.query = _parsed(sql, settings.limits)

    def frame(self, sources: Mapping[str, DataFrame], params: Values = None) -> DataFrame:
        try:
            bound = bind(self.query, params, self.settings.limits)
            if not sources:
                return compile_query(bound, sources, self.settings)
            with exact_names(next(iter(sources.values())).sparkSession):
                return compile_query(bound, sources, self.settings)
        except NestQueryError as x:
            if self.settings.redact_errors and type(x) is ExecutionError:
                raise ExecutionError("the query failed") from None
            raise

    def run(self, spark: SparkSession, data: Source | Mapping[str, Source], params: Values = None) -> DataFrame:
        return self.frame(sources_of(spark, data, self.settings), params)


def prepare(sql: str, settings: Settings = Settings()) -> PreparedQuery:
    return PreparedQuery(sql, settings)


def query(spark: SparkSession, sql: str, data: Source | Mapping[str, Source], params: Values = None, settings: Settings = Settings()) -> DataFrame:
    """The result of a query as a DataFrame; nothing runs before an action does."""
    return PreparedQuery(sql, settings).run(spark, data, params)


def query_json(spark: SparkSession, sql: str, data: Source | Mapping[str, Source], params: Values = None, settings: Settings = Settings(), pretty: bool = False) -> str:
    return sinks.to_json(query(spark, sql, data, params, settings), settings, pretty)


class Engine:
    """Sources under names, and, if ``cached_results`` or ``result_cache`` is set, the results of the last queries without
    parameters and without NOW, by their text. Kept results are persisted by Spark where they are, and spill; a cache of
    the caller's own gets plain DataFrames and decides itself."""

    def __init__(self, spark: SparkSession, settings: Settings = Settings()) -> None:
        self.spark, self.settings = spark, settings
        self.sources: dict[str, DataFrame] = {}
        self._results: OrderedDict[str, DataFrame] = OrderedDict()

    def register(self, name: str, data: Source, persist: bool = False) -> Engine:
        with exact_names(self.spark):
            df = data if isinstance(data, DataFrame) else from_json(self.spark, data, self.settings.json, self.settings.codec)
        self.sources[name] = df.persist() if persist else df
        self.clear()
        return self

    def root(self, data: Source, persist: bool = False) -> Engine:
        return self.register(ROOT, data, persist)

    def clear(self) -> None:
        for df in self._results.values():
            df.unpersist()
        self._results.clear()
        if self.settings.result_cache is not None:
            self.settings.result_cache.clear()

    @property
    def cached(self) -> list[str]:
        return list(self._results)

    def query(self, sql: str, params: Values = None) -> DataFrame:
        own = self.settings.result_cache
        keep = (own is not None or self.settings.cached_results > 0) and not params
        if keep and own is not None and (kept := own.get(sql)) is not None:
            return kept
        if keep and sql in self._results:
            self._results.move_to_end(sql)
            return self._results[sql]
        prepared = PreparedQuery(sql, self.settings)
        df = prepared.frame(self.sources, params)
        if keep and not any(isinstance(n, t.Fn) and n.name == "NOW" for n in t.walk(prepared.query)):
            if own is not None:
                own.put(sql, df)
                return df
            self._results[sql] = df.persist()
            if len(self._results) > self.settings.cached_results:
                self._results.popitem(last=False)[1].unpersist()
        return df

    def json(self, sql: str, params: Values = None, pretty: bool = False) -> str:
        return sinks.to_json(self.query(sql, params), self.settings, pretty)
