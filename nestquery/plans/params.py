"""Parameters: what a query needs, and the query with values in their place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timezone
from decimal import Decimal
from typing import Any

from nestquery.errors import BindError
from nestquery.settings import Limits

from . import tree as t


def literal(value: Any) -> t.Lit:
    """A Python value as a literal; a datetime with a zone becomes the local time in UTC."""
    if value is None:
        return t.Lit(None, "null")
    if isinstance(value, bool):
        return t.Lit(value, "boolean")
    if isinstance(value, int):
        return t.Lit(value, "number") if -(2**63) <= value < 2**63 else t.Lit(Decimal(value), "decimal")
    if isinstance(value, float):
        return t.Lit(value, "double")
    if isinstance(value, Decimal):
        return t.Lit(value, "decimal")
    if isinstance(value, str):
        return t.Lit(value, "string")
    if isinstance(value, datetime):
        return t.Lit(value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value, "datetime")
    if isinstance(value, date):
        return t.Lit(value, "date")
    raise BindError(f"a {type(value).__name__} cannot be a parameter")


def _several(value: Any) -> bool:
    return isinstance(value, (list, tuple, set, frozenset, range))


def parameters(query: t.Query) -> list[str | int]:
    return list(dict.fromkeys(n.key for n in t.walk(query) if isinstance(n, t.Param)))


def bind(query: t.Query, values: Mapping[str, Any] | Sequence[Any] | None, limits: Limits = Limits()) -> t.Query:
    """The query with values for all parameters, in subqueries too. Names that the query lacks are ignored."""
    keys = parameters(query)
    if not keys:
        return query
    if values is None:
        raise BindError(f"no value for parameter {keys[0]!r}")
    if isinstance(values, (str, bytes)):
        raise BindError("parameters are a mapping or a sequence")
    if isinstance(values, Mapping) != isinstance(keys[0], str):
        raise BindError("named parameters take a mapping, positional ones a sequence")

    def get(key: str | int) -> Any:
        if isinstance(values, Mapping):
            if key not in values:
                raise BindError(f"no value for parameter {key!r}")
            return values[key]
        if int(key) >= len(values):
            raise BindError(f"no value for parameter {int(key) + 1}")
        return values[int(key)]

    def one(key: str | int) -> t.Lit:
        value = get(key)
        if _several(value):
            raise BindError(f"parameter {key!r} takes one value here")
        return literal(value)

    def items(nodes: tuple[t.Node, ...]) -> tuple[t.Node, ...]:
        out: list[t.Node] = []
        for n in nodes:
            if isinstance(n, t.Param) and _several(get(n.key)):
                out += [literal(v) for v in get(n.key)]
            else:
                out.append(t.rewrite(n, visit))
        return tuple(out)

    def count(node: t.Node | None) -> t.Node | None:
        if not isinstance(node, t.Param):
            return node
        value = get(node.key)
        if isinstance(value, float) and value.is_integer():
            value = int(value)
        if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value < 2**31:
            raise BindError("LIMIT and OFFSET take a whole number that is not negative")
        return t.Lit(value, "number")

    def visit(node: t.Node) -> t.Node | None:
        if isinstance(node, t.Param):
            return one(node.key)
        if isinstance(node, t.In):
            new = items(node.items)
            if len(new) > limits.in_list:
                raise BindError(f"an IN list has more than {limits.in_list} items")
            return t.In(t.rewrite(node.left, visit), new, node.negated)
        if isinstance(node, (t.ArrayOp, t.Compare)) and isinstance(node.right, t.Param) and _several(get(node.right.key)):
            if node.op not in ("=", "!=", "@>", "<@", "&&"):
                raise BindError(f"arrays cannot be compared by {node.op}")
            return t.ArrayOp(node.op, t.rewrite(node.left, visit), t.Array(tuple(literal(v) for v in get(node.right.key))))
        if isinstance(node, t.Query) and (isinstance(node.limit, t.Param) or isinstance(node.offset, t.Param)):
            return t.rewrite(t.replace(node, limit=count(node.limit), offset=count(node.offset)), visit)
        return None

    return t.rewrite(query, visit)
