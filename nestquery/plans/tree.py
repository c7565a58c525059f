"""The syntax tree: frozen, so that equal expressions are equal keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Col(Node):
    path: tuple[str, ...]


@dataclass(frozen=True)
class Lit(Node):
    value: Any
    #: 1, 1.0 and TRUE are equal in Python but are different literals.
    kind: str


@dataclass(frozen=True)
class Param(Node):
    key: str | int


@dataclass(frozen=True)
class Fn(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Cast(Node):
    arg: Node
    type: str


@dataclass(frozen=True)
class Agg(Node):
    name: str
    #: None: ``*``.
    arg: Node | None


@dataclass(frozen=True)
class Order(Node):
    arg: Node
    descending: bool


@dataclass(frozen=True)
class Win(Node):
    name: str
    #: None: ``*``.
    args: tuple[Node, ...] | None
    partition: tuple[Node, ...]
    order: tuple[Order, ...]


@dataclass(frozen=True)
class Case(Node):
    operand: Node | None
    whens: tuple[tuple[Node, Node], ...]
    default: Node | None


@dataclass(frozen=True)
class Array(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Compare(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Like(Node):
    left: Node
    right: Node
    negated: bool


@dataclass(frozen=True)
class In(Node):
    left: Node
    items: tuple[Node, ...]
    negated: bool


@dataclass(frozen=True)
class Between(Node):
    left: Node
    low: Node
    high: Node
    negated: bool


@dataclass(frozen=True)
class IsNull(Node):
    left: Node
    negated: bool


@dataclass(frozen=True)
class Contains(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class ArrayOp(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class And(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Or(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Output(Node):
    expr: Node
    alias: tuple[str, ...] | None
    text: str


@dataclass(frozen=True)
class Root(Node):
    path: tuple[str, ...]


@dataclass(frozen=True)
class Table(Node):
    name: str
    alias: str | None


@dataclass(frozen=True)
class Sub(Node):
    query: Query


@dataclass(frozen=True)
class Join(Node):
    kind: str
    table: Table
    on: tuple[tuple[Col, Col], ...]


@dataclass(frozen=True)
class Query(Node):
    distinct: bool
    #: None: ``*``.
    select: tuple[Output, ...] | None
    source: Node
    joins: tuple[Join, ...]
    where: Node | None
    group: tuple[Node, ...]
    having: Node | None
    order: tuple[Order, ...]
    limit: Node | None
    offset: Node | None


def _parts(value: Any) -> Iterator[Node]:
    if isinstance(value, Node):
        yield value
    elif isinstance(value, tuple):
        for v in value:
            yield from _parts(v)


def children(node: Node) -> Iterator[Node]:
    for f in fields(node):
        yield from _parts(getattr(node, f.name))


def walk(node: Node, into: Callable[[Node], bool] = lambda _: True) -> Iterator[Node]:
    yield node
    if into(node):
        for c in children(node):
            yield from walk(c, into)


def rewrite(node: Any, f: Callable[[Node], Node | None]) -> Any:
    """The tree with every node for which ``f`` gives one replaced, from the top."""
    if isinstance(node, tuple):
        return tuple(rewrite(x, f) for x in node)
    if not isinstance(node, Node):
        return node
    new = f(node)
    if new is not None:
        return new
    return replace(node, **{x.name: rewrite(getattr(node, x.name), f) for x in fields(node)})
