"""Immutable settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from typing import Any, Protocol

from pyspark.sql import DataFrame


class ResultCache(Protocol):
    """Results by the text of their query. ``get`` gives None for a query that isn't kept."""

    def get(self, sql: str) -> DataFrame | None: ...

    def put(self, sql: str, result: DataFrame) -> None: ...

    def clear(self) -> None: ...

    def __len__(self) -> int: ...


class DuplicateKeys(Enum):
    REJECT = "reject"
    LAST_WINS = "last"
    FIRST_WINS = "first"


class MissingFields(Enum):
    IGNORE = "ignore"
    FAIL = "fail"


@dataclass(frozen=True)
class Limits:
    sql_length: int = 65_536
    subquery_depth: int = 16
    in_list: int = 1_024
    #: Rows that a sink hands to the driver; DataFrames are not limited.
    rows: int = 1_000_000
    parameters: int = 1_024
    like_wildcards: int = 16


@dataclass(frozen=True)
class JsonLimits:
    """Limits of JSON. ``length`` is for text that is given to the driver; files are parsed on executors, whatever their size."""

    length: int = 10 << 20
    depth: int = 64
    string: int = 1 << 20
    number: int = 64
    key: int = 1_024
    array: int = 1_000_000
    duplicate_keys: DuplicateKeys = DuplicateKeys.REJECT


@dataclass(frozen=True)
class Settings:
    limits: Limits = field(default_factory=Limits)
    json: JsonLimits = field(default_factory=JsonLimits)
    #: Reads JSON text as values in place of the parser with limits.
    codec: Callable[[str], Any] | None = None
    #: Results that an engine keeps; 0: none.
    cached_results: int = 0
    #: Keeps results in place of the engine's own cache.
    result_cache: ResultCache | None = None
    redact_errors: bool = False
    missing_fields: MissingFields = MissingFields.IGNORE
    #: Unknown columns are errors instead of NULL.
    strict_columns: bool = False
    #: Objects and arrays count as NULL for IS NULL and IS NOT NULL.
    nested_is_null: bool = False
