"""Tokens, and the tables of keywords and functions that tools may want."""

from __future__ import annotations

import re
from dataclasses import dataclass

from nestquery.errors import ParseError

KEYWORDS = frozenset(
    "SELECT FROM WHERE AS GROUP BY ORDER HAVING LIKE IS NOT AND OR NULL ASC DESC TRUE FALSE DISTINCT LIMIT OFFSET IN BETWEEN CAST INNER JOIN LEFT RIGHT ON OVER PARTITION CASE WHEN THEN ELSE END CONTAINS ARRAY".split()
)
AGGREGATES = frozenset("AVG SUM COUNT MIN MAX".split())
RANKING = frozenset("ROW_NUMBER RANK DENSE_RANK NTILE LAG LEAD".split())
CAST_TYPES = frozenset("STRING NUMBER INTEGER DECIMAL BOOLEAN DATE DATETIME".split())
#: Words that may also name a column, a table or a function.
SOFT = frozenset("INNER LEFT RIGHT JOIN ON OVER PARTITION CASE WHEN THEN ELSE END".split()) | RANKING

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n]+)|(?P<string>'(?:[^']|'')*')|(?P<number>-?[0-9]+(?:\.[0-9]+)?)|(?P<root>\$[rR](?![A-Za-z0-9_-]))|(?P<word>[A-Za-z_][A-Za-z0-9_-]*)"""
    r"""|(?P<named>:[A-Za-z_][A-Za-z0-9_]*)|(?P<op>@>|<@|&&|>=|<=|!=|[><=])|(?P<mark>[;,.*()\[\]?])"""
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    line: int
    column: int

    @property
    def upper(self) -> str:
        return self.text.upper()


def scan(sql: str) -> list[Token]:
    """All tokens but white space, including runs that are none, as kind ``bad``; never raises."""
    out: list[Token] = []
    at, line, start = 0, 1, 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        text = m.group() if m else sql[at]
        kind = (m.lastgroup or "bad") if m else "bad"
        if kind == "word":
            upper = text.upper()
            kind = "keyword" if upper in KEYWORDS else "aggregate" if upper in AGGREGATES else "ranking" if upper in RANKING else "word"
        if kind != "space":
            out.append(Token(kind, text, line, at - start + 1))
        breaks = text.count("\n")
        if breaks:
            line, start = line + breaks, at + text.rindex("\n") + 1
        at += len(text)
    return out


def tokens(sql: str) -> list[Token]:
    """As ``scan``, but text that is no token is an error."""
    out = scan(sql)
    for t in out:
        if t.kind == "bad":
            raise ParseError(f"unexpected {t.text!r}", t.line, t.column)
    end = out[-1] if out else Token("", "", 1, 1)
    return [*out, Token("end", "", end.line, end.column + len(end.text))]
