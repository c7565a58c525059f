"""Errors of the engine, all under one base."""

from __future__ import annotations


class NestQueryError(Exception):
    """Base of all errors the engine raises itself."""


class ParseError(NestQueryError):
    """Text that is no query, with the place where it goes wrong."""

    def __init__(self, message: str, line: int = 0, column: int = 0) -> None:
        super().__init__(f"{message} (line {line}, column {column})" if line else message)
        self.line, self.column = line, column


class ExecutionError(NestQueryError):
    """A query that cannot run on its data, or whose result exceeds a limit."""


class BindError(NestQueryError):
    """Parameters that don't fit the query."""


class MappingError(NestQueryError):
    """A row that doesn't fit the class it is mapped to."""
