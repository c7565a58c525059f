"""Command line: ``python -m nestquery.cli -q QUERY -f FILE`` or ``--data NAME=FILE`` for several sources.

Exit codes: 0 done, 1 the query failed, 2 the arguments are wrong.
"""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any, TextIO

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from nestquery import sinks
from nestquery.engine import Sources, exact_names, query
from nestquery.errors import NestQueryError
from nestquery.settings import Settings
from nestquery.sources import from_json, from_json_files, read_file

VERSION = "0.1"


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:  # type: ignore[override]
        raise ValueError(message)


def arguments(argv: list[str]) -> argparse.Namespace:
    p = _Parser(prog="nestquery", description="Runs a query on JSON or any file that Spark reads.", exit_on_error=False)
    p.add_argument("-q", "--query", help="the query, or @FILE")
    p.add_argument("-f", "--file", help="the root source: a file; - or none reads JSON from standard input")
    p.add_argument("-o", "--output", help="a file for the result instead of standard output")
    p.add_argument("--data", action="append", default=[], metavar="NAME=FILE", help="a named source")
    p.add_argument("--param", action="append", default=[], metavar="NAME=VALUE", help="a named parameter; the value is JSON, or else text")
    p.add_argument("--pretty", action="store_true", help="indented output")
    p.add_argument("-v", "--version", action="store_true")
    args = p.parse_args(argv)
    if not args.version and not args.query:
        raise ValueError("a query is needed")
    for option in ("data", "param"):
        pairs = [x.partition("=") for x in getattr(args, option)]
        if any(not name or not mark for name, mark, _ in pairs):
            raise ValueError(f"--{option} takes NAME=...")
        if len({name for name, _, _ in pairs}) < len(pairs):
            raise ValueError(f"a name of --{option} is given twice")
        setattr(args, option, {name: value for name, _, value in pairs})
    if args.data and args.file:
        raise ValueError("-f and --data cannot be mixed")
    return args


def value(text: str) -> Any:
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return text


def _load(spark: SparkSession, path: str, settings: Settings) -> DataFrame:
    """A JSON file of any size is parsed strictly; other formats are Spark's to read."""
    if path.lower().endswith(".json"):
        with exact_names(spark):
            return from_json_files(spark, path, settings.json, settings.codec)
    return read_file(spark, path)


def main(argv: list[str] | None = None, stdin: TextIO = sys.stdin, stdout: TextIO = sys.stdout, stderr: TextIO = sys.stderr, spark: SparkSession | None = None) -> int:
    try:
        args = arguments(sys.argv[1:] if argv is None else argv)
    except SystemExit as x:  # --help
        return int(x.code or 0)
    except (ValueError, argparse.ArgumentError) as x:
        print(f"nestquery: {x}", file=stderr)
        return 2
    if args.version:
        print(VERSION, file=stdout)
        return 0
    settings = Settings()
    try:
        spark = spark or SparkSession.builder.appName("nestquery").getOrCreate()
        sql = args.query
        if sql.startswith("@"):
            with open(sql[1:], encoding="utf-8") as f:
                sql = f.read()
        if args.data:
            data: Any = Sources({name: _load(spark, path, settings) for name, path in args.data.items()})
        elif args.file and args.file != "-":
            data = _load(spark, args.file, settings)
        else:
            data = from_json(spark, stdin.read(), settings.json)
        text = sinks.to_json(query(spark, sql, data, {k: value(v) for k, v in args.param.items()} or None, settings), settings, args.pretty)
        if args.output:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(text + "\n")
        else:
            print(text, file=stdout)
        return 0
    except (NestQueryError, OSError, AnalysisException) as x:
        print(f"nestquery: {x}", file=stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
