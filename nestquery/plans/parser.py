"""Recursive descent from tokens to a query."""

from __future__ import annotations

from decimal import Decimal

from nestquery.errors import ParseError
from nestquery.functions.scalar import ARITY
from nestquery.settings import Limits

from . import tree as t
from .lexer import AGGREGATES, CAST_TYPES, RANKING, SOFT, Token, tokens


def parse(sql: str, limits: Limits = Limits()) -> t.Query:
    if sql is None or not sql.strip():
        raise ParseError("the query is empty", 1, 1)
    if len(sql) > limits.sql_length:
        raise ParseError(f"the query is longer than {limits.sql_length} characters")
    parser = _Parser(sql, limits)
    query = parser.query(0)
    parser.take_mark(";")
    parser.expect_end()
    return query


class _Parser:
    def __init__(self, sql: str, limits: Limits) -> None:
        self.tokens, self.at, self.limits = tokens(sql), 0, limits
        self.positional, self.named = 0, set()

    # tokens
    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def fail(self, message: str, token: Token | None = None) -> ParseError:
        token = token or self.now
        return ParseError(message, token.line, token.column)

    def step(self) -> Token:
        token = self.now
        self.at += 1
        return token

    def is_word(self, *words: str) -> bool:
        return self.now.kind in ("keyword", "aggregate", "ranking", "word") and self.now.upper in words

    def take(self, *words: str) -> bool:
        """Takes all these words or none."""
        for k, w in enumerate(words):
            token = self.peek(k)
            if token.kind not in ("keyword", "ranking", "word") or token.upper != w:
                return False
        self.at += len(words)
        return True

    def need(self, *words: str) -> None:
        for w in words:
            if not self.take(w):
                raise self.fail(f"expected {w} but found {self.now.text or 'the end'!r}")

    def is_mark(self, mark: str) -> bool:
        return self.now.kind in ("mark", "op") and self.now.text == mark

    def take_mark(self, mark: str) -> bool:
        if self.is_mark(mark):
            self.at += 1
            return True
        return False

    def need_mark(self, mark: str) -> None:
        if not self.take_mark(mark):
            raise self.fail(f"expected {mark!r} but found {self.now.text or 'the end'!r}")

    def expect_end(self) -> None:
        if self.now.kind != "end":
            raise self.fail(f"unexpected {self.now.text!r} after the query")

    # names
    def is_name(self, token: Token | None = None) -> bool:
        token = token or self.now
        return token.kind in ("word", "ranking") or (token.kind == "keyword" and token.upper in SOFT)

    def name(self) -> str:
        if not self.is_name():
            raise self.fail(f"expected a name but found {self.now.text or 'the end'!r}")
        return self.step().text

    def path(self) -> tuple[str, ...]:
        parts = [self.name()]
        while self.is_mark("."):
            self.step()
            # after a dot any word names a field
            if self.now.kind not in ("word", "ranking", "keyword", "aggregate"):
                raise self.fail("expected a field name")
            parts.append(self.step().text)
        return tuple(parts)

    # query
    def query(self, depth: int) -> t.Query:
        if depth > self.limits.subquery_depth:
            raise self.fail(f"subqueries are nested deeper than {self.limits.subquery_depth}")
        self.need("SELECT")
        distinct = self.take("DISTINCT")
        select: tuple[t.Output, ...] | None = None
        if not self.take_mark("*"):
            outputs = [self.output()]
            while self.take_mark(","):
                outputs.append(self.output())
            select = tuple(outputs)
        self.need("FROM")
        source, joins = self.source(depth), []
        while self.is_word("JOIN", "INNER", "LEFT", "RIGHT"):
            if not isinstance(source, t.Table):
                raise self.fail("only a named table can be joined")
            joins.append(self.join())
        where = self.conditions() if self.take("WHERE") else None
        group: list[t.Node] = []
        if self.take("GROUP", "BY"):
            group = self.list(self.expr)
        having = self.conditions() if self.take("HAVING") else None
        order = tuple(self.list(self.order)) if self.take("ORDER", "BY") else ()
        limit = self.limit() if self.take("LIMIT") else None
        offset = self.limit() if limit is not None and self.take("OFFSET") else None
        query = t.Query(distinct, select, source, tuple(joins), where, tuple(group), having, order, limit, offset)
        for place, parts in (("WHERE", [where] if where else []), ("HAVING", [having] if having else []), ("GROUP BY", group)):
            if any(isinstance(n, t.Win) for p in parts for n in t.walk(p)):
                raise self.fail(f"a window function cannot stand in {place}")
        if any(isinstance(n, t.Agg) for p in ([where] if where else []) for n in t.walk(p)):
            raise self.fail("an aggregate cannot stand in WHERE")
        names = [j.table.alias or j.table.name for j in joins] + ([source.alias or source.name] if isinstance(source, t.Table) else [])
        if len(set(names)) < len(names):
            raise self.fail("two tables of a join have the same name")
        return query

    def list(self, item) -> list:
        out = [item()]
        while self.take_mark(","):
            out.append(item())
        return out

    def source(self, depth: int) -> t.Node:
        if self.now.kind == "root":
            self.step()
            path = []
            while self.take_mark("."):
                path += self.path()
            return t.Root(tuple(path))
        if self.take_mark("("):
            inner = self.query(depth + 1)
            self.need_mark(")")
            return t.Sub(inner)
        return self.table()

    def table(self) -> t.Table:
        name = self.name()
        alias = self.step().text if self.now.kind == "word" else None
        return t.Table(name, alias)

    def join(self) -> t.Join:
        kind = "inner"
        if self.is_word("INNER", "LEFT", "RIGHT"):
            kind = self.step().text.lower()
        self.need("JOIN")
        table = self.table()
        self.need("ON")
        on = []
        while True:
            left = t.Col(self.path())
            op = self.step()
            if op.kind != "op" or op.text != "=":
                raise self.fail("a join condition is an equality of two columns", op)
            on.append((left, t.Col(self.path())))
            if not self.take("AND"):
                return t.Join(kind, table, tuple(on))

    def output(self) -> t.Output:
        begin = self.at
        expr = self.expr()
        text = "".join(f"{' ' if k and a.kind not in ('mark', 'op') and b.kind not in ('mark', 'op') else ''}{a.text}" for k, (b, a) in enumerate(zip(self.tokens[begin - 1 : self.at - 1] if begin else [self.tokens[0], *self.tokens[: self.at - 1]], self.tokens[begin : self.at])))
        return t.Output(expr, self.path() if self.take("AS") else None, text)

    def order(self) -> t.Order:
        expr = self.expr()
        if self.take("DESC"):
            return t.Order(expr, True)
        self.take("ASC")
        return t.Order(expr, False)

    def limit(self) -> t.Node:
        if (self.now.kind == "mark" and self.now.text == "?") or self.now.kind == "named":
            return self.value()
        token = self.step()
        if token.kind != "number" or not token.text.isdigit():
            raise self.fail("LIMIT and OFFSET take a whole number that is not negative", token)
        return t.Lit(int(token.text), "number")

    # expressions
    def value(self) -> t.Node:
        token = self.now
        if token.kind == "string":
            self.step()
            return t.Lit(token.text[1:-1].replace("''", "'"), "string")
        if token.kind == "number":
            self.step()
            if "." in token.text:
                return t.Lit(float(token.text), "double")
            n = int(token.text)
            return t.Lit(n, "number") if -(2**63) <= n < 2**63 else t.Lit(Decimal(n), "decimal")
        if token.kind == "keyword" and token.upper in ("TRUE", "FALSE"):
            self.step()
            return t.Lit(token.upper == "TRUE", "boolean")
        if token.kind == "keyword" and token.upper == "NULL":
            self.step()
            return t.Lit(None, "null")
        if token.kind == "named" or (token.kind == "mark" and token.text == "?"):
            self.step()
            if token.kind == "named":
                self.named.add(token.text[1:])
                param = t.Param(token.text[1:])
            else:
                self.positional += 1
                param = t.Param(self.positional - 1)
            if self.named and self.positional:
                raise self.fail("positional and named parameters cannot be mixed", token)
            if len(self.named) + self.positional > self.limits.parameters:
                raise self.fail(f"there are more than {self.limits.parameters} parameters", token)
            return param
        raise self.fail(f"expected a value but found {token.text or 'the end'!r}")

    def expr(self) -> t.Node:
        token = self.now
        if token.kind == "keyword" and token.upper == "CASE" and not (self.peek().kind == "mark" and self.peek().text in ".,)("):
            return self.case()
        if token.kind == "keyword" and token.upper == "CAST":
            self.step()
            self.need_mark("(")
            arg = self.expr()
            self.need("AS")
            kind = self.step()
            if kind.upper not in CAST_TYPES:
                raise self.fail(f"{kind.text!r} is no type", kind)
            self.need_mark(")")
            return t.Cast(arg, kind.upper)
        if token.kind == "aggregate":
            self.step()
            self.need_mark("(")
            arg = None if self.take_mark("*") else self.expr()
            if arg is None and token.upper != "COUNT":
                raise self.fail(f"{token.upper}(*) is no aggregate", token)
            self.need_mark(")")
            if self.is_word("OVER"):
                return self.over(token.upper, None if arg is None else (arg,))
            return t.Agg(token.upper, arg)
        if self.is_name() and self.peek().kind == "mark" and self.peek().text == "(":
            self.step()
            self.need_mark("(")
            args = [] if self.is_mark(")") else self.list(self.expr)
            self.need_mark(")")
            name = token.upper
            if name in RANKING:
                if not self.is_word("OVER"):
                    raise self.fail(f"{name} needs OVER", token)
                low, high = {"NTILE": (1, 1), "LAG": (1, 2), "LEAD": (1, 2)}.get(name, (0, 0))
                if not low <= len(args) <= high:
                    raise self.fail(f"{name} takes {low} to {high} arguments", token)
                return self.over(name, tuple(args))
            return self.function(name, args, token)
        if self.is_name():
            return t.Col(self.path())
        return self.value()

    def function(self, name: str, args: list[t.Node], token: Token) -> t.Fn:
        if name not in ARITY:
            raise self.fail(f"there is no function {name}", token)
        low, high = ARITY[name]
        if len(args) < low or (high is not None and len(args) > high):
            raise self.fail(f"{name} takes {low}{'' if high == low else ' or more' if high is None else f' to {high}'} arguments", token)
        return t.Fn(name, tuple(args))

    def over(self, name: str, args: tuple[t.Node, ...] | None) -> t.Win:
        self.need("OVER")
        self.need_mark("(")
        partition = self.list(self.expr) if self.take("PARTITION", "BY") else []
        order = self.list(self.order) if self.take("ORDER", "BY") else []
        self.need_mark(")")
        return t.Win(name, args, tuple(partition), tuple(order))

    def case(self) -> t.Case:
        self.need("CASE")
        operand = None if self.is_word("WHEN") else self.expr()
        whens = []
        while self.take("WHEN"):
            test = self.conditions() if operand is None else self.expr()
            self.need("THEN")
            whens.append((test, self.expr()))
        if not whens:
            raise self.fail("CASE needs WHEN")
        default = self.expr() if self.take("ELSE") else None
        self.need("END")
        return t.Case(operand, tuple(whens), default)

    # conditions
    def conditions(self) -> t.Node:
        items = [self.conjunction()]
        while self.take("OR"):
            items.append(self.conjunction())
        return items[0] if len(items) == 1 else t.Or(tuple(items))

    def conjunction(self) -> t.Node:
        items = [self.single()]
        while self.take("AND"):
            items.append(self.single())
        return items[0] if len(items) == 1 else t.And(tuple(items))

    def single(self) -> t.Node:
        if self.take_mark("("):
            inner = self.conditions()
            self.need_mark(")")
            return inner
        return self.condition()

    def right(self) -> t.Node:
        """The right side of a predicate: a value, a constant function, a cast, a column or an array."""
        if self.is_word("ARRAY") and self.peek().text == "[":
            self.step()
            self.need_mark("[")
            items = [] if self.is_mark("]") else self.list(self.right)
            self.need_mark("]")
            return t.Array(tuple(items))
        expr = self.expr()
        if isinstance(expr, t.Fn) and any(isinstance(n, t.Col) for n in t.walk(expr)):
            raise self.fail("a function on the right side takes constants only")
        return expr

    def array_right(self) -> t.Node:
        right = self.right()
        if not isinstance(right, (t.Array, t.Col, t.Param)):
            raise self.fail("an array operator needs ARRAY[...], a column or a parameter on its right")
        return right

    def condition(self) -> t.Node:
        left = self.expr()
        token = self.now
        if token.kind == "op":
            self.step()
            if token.text in ("@>", "<@", "&&"):
                return t.ArrayOp(token.text, left, self.array_right())
            right = self.right()
            if isinstance(right, t.Array):
                if token.text not in ("=", "!="):
                    raise self.fail(f"arrays cannot be compared by {token.text}", token)
                return t.ArrayOp(token.text, left, right)
            return t.Compare(token.text, left, right)
        if self.take("IS"):
            negated = self.take("NOT")
            self.need("NULL")
            return t.IsNull(left, negated)
        if self.take("CONTAINS"):
            return t.Contains(left, self.right())
        negated = self.take("NOT")
        if self.take("LIKE"):
            pattern = self.right()
            if isinstance(pattern, t.Lit) and isinstance(pattern.value, str) and pattern.value.count("%") + pattern.value.count("_") > self.limits.like_wildcards:
                raise self.fail(f"a LIKE pattern has more than {self.limits.like_wildcards} wildcards", token)
            return t.Like(left, pattern, negated)
        if self.take("IN"):
            self.need_mark("(")
            items = self.list(self.right)
            self.need_mark(")")
            if len(items) > self.limits.in_list:
                raise self.fail(f"an IN list has more than {self.limits.in_list} items", token)
            if any(isinstance(n, t.Col) for i in items for n in t.walk(i)):
                raise self.fail("an IN list takes constants only", token)
            return t.In(left, tuple(items), negated)
        if self.take("BETWEEN"):
            low = self.right()
            self.need("AND")
            return t.Between(left, low, self.right(), negated)
        raise self.fail(f"expected a predicate but found {self.now.text or 'the end'!r}")


__all__ = ["parse", "AGGREGATES"]
