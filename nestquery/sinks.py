"""Where results go: JSON text, JSON files, Python objects."""

from __future__ import annotations

import json
from dataclasses import MISSING, fields, is_dataclass
from datetime import date, datetime
from decimal import Decimal
from enum import Enum
from types import NoneType, UnionType
from typing import Any, TypeVar, Union, get_args, get_origin, get_type_hints

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from nestquery.errors import ExecutionError, MappingError
from nestquery.settings import MissingFields, Settings

C = TypeVar("C")


def rows(df: DataFrame, settings: Settings = Settings()) -> list[dict[str, Any]]:
    """All rows on the driver; more than the limit are an error. DataFrames themselves have no limit."""
    most = settings.limits.rows
    got = df.limit(most + 1).collect()
    if len(got) > most:
        raise ExecutionError(f"the result has more than {most} rows")
    whole = {f.name for f in df.schema.fields if (f.metadata or {}).get("whole")}
    out = []
    for r in got:
        d = {k: _plain(v) for k, v in zip(df.columns, r)}
        for k in whole:
            if isinstance(d[k], float) and d[k].is_integer():
                d[k] = int(d[k])
        out.append(d)
    return out


def _plain(v: Any) -> Any:
    if isinstance(v, Row):
        return {k: _plain(x) for k, x in v.asDict().items()}
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if isinstance(v, Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if type(v).__name__ == "VariantVal":
        return json.loads(v.toJson())
    return v


def _time(v: Any) -> str:
    if isinstance(v, datetime):
        text = v.isoformat()
        return text[:-3] if v.second == 0 and v.microsecond == 0 else text.rstrip("0") if v.microsecond else text
    if isinstance(v, date):
        return v.isoformat()
    raise TypeError(type(v).__name__)


def to_json(df: DataFrame, settings: Settings = Settings(), pretty: bool = False) -> str:
    """An array of objects, NULLs included."""
    got = rows(df, settings)
    if pretty:
        return json.dumps(got, indent=2, ensure_ascii=False, default=_time)
    return json.dumps(got, separators=(",", ":"), ensure_ascii=False, default=_time)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON Lines, one file a task, NULLs included."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """One column ``value`` with an object of each row."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def to_objects(df: DataFrame, kind: type[C], settings: Settings = Settings()) -> list[C]:
    return [convert(r, kind, settings) for r in rows(df, settings)]


def to_object(df: DataFrame, kind: type[C], settings: Settings = Settings()) -> C:
    got = rows(df.limit(2), settings)
    if len(got) != 1:
        raise MappingError("the result has not exactly one row")
    return convert(got[0], kind, settings)


def convert(value: Any, kind: Any, settings: Settings = Settings(), place: str = "$") -> Any:
    """A value as a dataclass, a collection, an enum, a date or a scalar."""
    origin, args = get_origin(kind), get_args(kind)
    if kind is Any:
        return value
    if origin in (Union, UnionType):
        if value is None and NoneType in args:
            return None
        for a in args:
            if a is not NoneType:
                try:
                    return convert(value, a, settings, place)
                except MappingError:
                    continue
        raise MappingError(f"{place}: {value!r} is none of {args}")
    if value is None:
        if kind in (int, float, bool):
            raise MappingError(f"{place}: NULL is no {kind.__name__}")
        return None
    if is_dataclass(kind):
        if not isinstance(value, dict):
            raise MappingError(f"{place}: no object")
        hints, out = get_type_hints(kind), {}
        for f in fields(kind):
            if f.name in value:
                out[f.name] = convert(value[f.name], hints[f.name], settings, f"{place}.{f.name}")
            elif settings.missing_fields is MissingFields.FAIL and f.default is MISSING and f.default_factory is MISSING:
                raise MappingError(f"{place}: field {f.name!r} is missing")
            elif f.default is MISSING and f.default_factory is MISSING:
                out[f.name] = convert(None, hints[f.name], settings, f"{place}.{f.name}") if hints[f.name] not in (int, float, bool) else hints[f.name]()
        return kind(**out)
    if origin in (list, set, tuple, frozenset):
        if not isinstance(value, list):
            raise MappingError(f"{place}: no array")
        item = args[0] if args else Any
        return origin(convert(v, item, settings, f"{place}[{i}]") for i, v in enumerate(value))
    if origin is dict or kind is dict:
        if not isinstance(value, dict):
            raise MappingError(f"{place}: no object")
        item = args[1] if args else Any
        return {k: convert(v, item, settings, f"{place}.{k}") for k, v in value.items()}
    try:
        if isinstance(kind, type) and issubclass(kind, Enum):
            return kind[value] if isinstance(value, str) and value in kind.__members__ else kind(value)
        if kind is datetime:
            return value if isinstance(value, datetime) else datetime.combine(value, datetime.min.time()) if isinstance(value, date) else datetime.fromisoformat(value)
        if kind is date:
            return value.date() if isinstance(value, datetime) else value if isinstance(value, date) else date.fromisoformat(value)
        if kind is str:
            return value if isinstance(value, str) else _time(value) if isinstance(value, date) else json.dumps(value)
        if kind is bool:
            if not isinstance(value, bool):
                raise ValueError(value)
            return value
        if kind is int:
            if isinstance(value, bool) or float(value) != int(value):
                raise ValueError(value)
            return int(value)
        if kind in (float, Decimal):
            if isinstance(value, (bool, str)):
                raise ValueError(value)
            return kind(str(value)) if kind is Decimal else float(value)
    except (ValueError, TypeError, KeyError) as x:
        raise MappingError(f"{place}: {value!r} is no {kind.__name__}") from x
    if isinstance(value, kind):
        return value
    raise MappingError(f"{place}: {value!r} is no {kind.__name__}")


