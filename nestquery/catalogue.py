"""What tools such as editors want to know of the dialect: keywords, functions, and the tokens of a text."""

from __future__ import annotations

from dataclasses import dataclass

from nestquery.functions.scalar import ARITY
from nestquery.plans.lexer import AGGREGATES, CAST_TYPES, KEYWORDS, RANKING, Token, scan

_MATH = ("ABS", "ROUND", "CEIL", "FLOOR", "MOD", "POWER", "SQRT", "SIGN")
_TIME = ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "DATE_ADD", "DATE_DIFF", "TO_DATE", "NOW")
_CONVERT = ("NULLIF", "COALESCE", "CAST")


@dataclass(frozen=True)
class Function:
    name: str
    #: string, math, date, conversion, aggregate or window.
    kind: str
    least: int
    #: None: any number of arguments.
    most: int | None


def keywords() -> tuple[str, ...]:
    return tuple(sorted(KEYWORDS))


def cast_types() -> tuple[str, ...]:
    return tuple(sorted(CAST_TYPES))


def functions() -> tuple[Function, ...]:
    kind = lambda n: "math" if n in _MATH else "date" if n in _TIME else "conversion" if n in _CONVERT else "string"
    scalar = [Function(n, kind(n), low, high) for n, (low, high) in {**ARITY, "CAST": (1, 1)}.items()]
    window = [Function(n, "window", *{"NTILE": (1, 1), "LAG": (1, 2), "LEAD": (1, 2)}.get(n, (0, 0))) for n in RANKING]
    return tuple(sorted([*scalar, *[Function(n, "aggregate", 1, 1) for n in AGGREGATES], *window], key=lambda f: f.name))


def tokenize(text: str) -> list[Token]:
    """All tokens of a text with their kind and place; what is no token is of kind ``bad``. Never raises."""
    return scan(text)


__all__ = ["Function", "Token", "cast_types", "functions", "keywords", "tokenize"]
