"""JSON as text, in files and in columns: strict parsing under limits, and a DataFrame with the schema of its values.

An array of objects gives a row for each, one object gives one row, anything else no rows. Where a field holds values
of several types its column is a VARIANT, so that each value keeps its own. Files and columns are read by the same rules,
on the executors: one pass finds the types, of which only one schema for each task comes back, another parses the rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import replace
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestquery.errors import ExecutionError
from nestquery.settings import DuplicateKeys, JsonLimits

Json = Any
#: Reads text as JSON values; ``parse_json`` is one, and others may take its place.
Codec = Callable[[str], Json]


def parse_json(text: str, limits: JsonLimits = JsonLimits()) -> Json:
    if len(text) > limits.length:
        raise ExecutionError(f"the JSON is longer than {limits.length} characters")
    depth = deepest = 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', text, re.DOTALL):
        mark = m.group()
        if mark in "[{":
            depth += 1
            deepest = max(deepest, depth)
            if deepest > limits.depth:
                raise ExecutionError(f"the JSON is nested deeper than {limits.depth}")
        elif mark in "]}":
            depth -= 1

    def pairs(items: list[tuple[str, Json]]) -> dict[str, Json]:
        out: dict[str, Json] = {}
        for k, v in items:
            if len(k) > limits.key:
                raise ExecutionError(f"a JSON key is longer than {limits.key} characters")
            if k in out:
                if limits.duplicate_keys is DuplicateKeys.REJECT:
                    raise ExecutionError(f"the JSON key {k!r} occurs twice in an object")
                if limits.duplicate_keys is DuplicateKeys.FIRST_WINS:
                    continue
            out[k] = v
        return out

    def number(make: Callable[[str], Any]) -> Callable[[str], Any]:
        def read(s: str) -> Any:
            if len(s) > limits.number:
                raise ExecutionError(f"a JSON number is longer than {limits.number} characters")
            return make(s)

        return read

    def constant(s: str) -> Any:
        raise ExecutionError(f"{s} is no JSON")

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_int=number(int), parse_float=number(float), parse_constant=constant)
    except json.JSONDecodeError as x:
        raise ExecutionError(f"the text is no JSON: {x}") from None
    _check(value, limits)
    return value


def _check(value: Json, limits: JsonLimits) -> None:
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, str) and len(v) > limits.string:
            raise ExecutionError(f"a JSON string is longer than {limits.string} characters")
        if isinstance(v, list):
            if len(v) > limits.array:
                raise ExecutionError(f"a JSON array has more than {limits.array} values")
            todo += v
        elif isinstance(v, dict):
            todo += v.values()


def kind_of(value: Json) -> T.DataType:
    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType() if -(2**63) <= value < 2**63 else T.DecimalType(38, 0)
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, list):
        kind: T.DataType = T.NullType()
        for v in value:
            kind = merged(kind, kind_of(v))
        return T.ArrayType(kind)
    return T.StructType([T.StructField(k, kind_of(v)) for k, v in value.items()])


def merged(a: T.DataType, b: T.DataType) -> T.DataType:
    """One type for values of two."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType() if isinstance(a, T.DoubleType) or isinstance(b, T.DoubleType) else T.DecimalType(38, 0)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = {f.name: f.dataType for f in a.fields}
        for f in b.fields:
            fields[f.name] = merged(fields[f.name], f.dataType) if f.name in fields else f.dataType
        return T.StructType([T.StructField(k, v) for k, v in fields.items()])
    return T.VariantType()


def _settled(kind: T.DataType) -> T.DataType:
    """Fields that are always null are strings."""
    if isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_settled(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _settled(f.dataType)) for f in kind.fields])
    return kind


def _plain(x: Any) -> Any:
    return int(x) if isinstance(x, Decimal) else str(x)


def from_json(spark: SparkSession, data: str | Json, limits: JsonLimits = JsonLimits(), codec: Codec | None = None) -> DataFrame:
    """Rows of JSON text or of parsed values."""
    rows = _objects((codec(data) if codec else parse_json(data, limits)) if isinstance(data, str) else data)
    kind: T.DataType = T.StructType([])
    for r in rows:
        kind = merged(kind, kind_of(r))
    kind = _settled(kind)
    if not rows or not kind.fields:
        return spark.createDataFrame([()] * len(rows), T.StructType([])) if not rows else spark.range(len(rows)).select()
    text = spark.createDataFrame([(k, json.dumps(r, default=_plain)) for k, r in enumerate(rows)], "place bigint, value string")
    return text.select(F.from_json("value", kind).alias("row")).select("row.*")


def _objects(value: Json) -> list[dict]:
    rows = value if isinstance(value, list) else [value] if isinstance(value, dict) else []
    return [r for r in rows if isinstance(r, dict)]


def from_json_column(df: DataFrame, column: str, limits: JsonLimits = JsonLimits(), codec: Codec | None = None) -> DataFrame:
    """Rows of the JSON texts (or bytes in UTF-8) in a column, parsed as strictly as ``from_json`` does; a NULL has no rows."""
    spark = df.sparkSession
    whole = replace(limits, length=1 << 62)
    texts = df.select(F.col(column).cast("binary").alias("value"))

    def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        for batch in batches:
            for raw in batch.column("value"):
                if raw.is_valid:
                    text = raw.as_py().decode("utf-8-sig")
                    yield _objects(codec(text) if codec else parse_json(text, whole))

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: T.DataType = T.StructType([])
        for rows in objects(batches):
            for r in rows:
                kind = merged(kind, kind_of(r))
        yield pa.RecordBatch.from_arrays([pa.array([kind.json()])], names=["kind"])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in objects(batches):
            for at in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps(r, default=_plain) for r in rows[at : at + 1000]], pa.string())], names=["value"])

    kind: T.DataType = T.StructType([])
    try:
        for r in texts.mapInArrow(kinds, "kind string").distinct().toLocalIterator():
            kind = merged(kind, T.StructType.fromJson(json.loads(r.kind)))
    except PySparkException as x:
        said = re.search(r"ExecutionError: (.*)", str(x))
        raise ExecutionError(said[1] if said else f"the JSON can't be read: {x}") from None
    kind = _settled(kind)
    lines = texts.mapInArrow(values, "value string")
    return lines.select(F.from_json("value", kind).alias("row")).select("row.*") if kind.fields else lines.select()


def from_json_files(spark: SparkSession, path: str, limits: JsonLimits = JsonLimits(), codec: Codec | None = None) -> DataFrame:
    """Rows of JSON files of any size, one value each. A file is one task's."""
    return from_json_column(spark.read.format("binaryFile").load(path), "content", limits, codec)
