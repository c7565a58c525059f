"""Files. JSON Lines and Parquet are split among tasks; one large JSON array is one task's, as in any reader."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_FORMATS = {".parquet": "parquet", ".orc": "orc", ".csv": "csv", ".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json"}


def read_file(spark: SparkSession, path: str, format: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """A DataFrame of a file or folder. ``json`` is an array or an object that may span lines, ``jsonl`` a value a line.
    Malformed JSON is an error."""
    kind = format or _FORMATS.get(PurePosixPath(path).suffix.lower(), "parquet")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind in ("json", "jsonl"):
        return reader.json(path, multiLine=kind == "json", mode="FAILFAST")
    if kind == "csv":
        return reader.csv(path, header=True)
    return reader.format(kind).load(path)
