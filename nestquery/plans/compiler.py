"""From a syntax tree to one DataFrame. Catalyst does the rest: nothing is executed or materialised here."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestquery.errors import ExecutionError
from nestquery.functions import conditions as c
from nestquery.functions import scalar
from nestquery.functions.types import BIGINT, BOOLEAN, DATE, DATETIME, DOUBLE, NULL, STRING, E, holds_variant, identity, key, null, unify
from nestquery.operators.aggregates import aggregate, finished
from nestquery.operators.distinct import distinct
from nestquery.operators.joins import join
from nestquery.operators.windows import SEQUENCE, needs_sequence, over_all, sort_key, window
from nestquery.settings import Settings

from . import tree as t
from .scope import Field, Scope, quoted, tree

#: The source that ``$r`` stands for.
ROOT = "$r"


def compile_query(query: t.Query, sources: Mapping[str, DataFrame], settings: Settings = Settings()) -> DataFrame:
    return _Compiler(query, sources, settings).run()


class _Compiler:
    def __init__(self, query: t.Query, sources: Mapping[str, DataFrame], settings: Settings) -> None:
        self.query, self.sources, self.settings = query, sources, settings
        #: What aggregates, group keys and windows have become.
        self.bound: dict[t.Node, E] = {}
        self.scope = Scope(())
        self.grouped = False
        self.aliases = {o.alias: o.expr for o in query.select or () if o.alias}

    # rows
    def run(self) -> DataFrame:
        q = self.query
        df = self.source(q.source)
        for j in q.joins:
            df = self.join(df, j)
        if q.where is not None:
            df = df.filter(self.condition(q.where))
        df = self.group(df)
        if q.having is not None:
            df = df.filter(self.condition(self.named(q.having)))
        df = self.windows(df)
        if q.distinct and q.order and q.limit is None:
            places = {o.expr: o.alias or (self.output_name(o),) for o in q.select or ()}
            by = [places.get(self.named(o.arg)) for o in q.order]
            if all(by):  # equal rows are equal in order too, so that only the rows that stay are sorted
                keys = [(E(F.col(".".join(map(quoted, path))), self.expr(self.named(o.arg)).type), o.descending) for path, o in zip(by, q.order)]
                return distinct(self.project(df), False).orderBy(*[sort_key(e, d) for e, d in keys])
        order = [(self.expr(self.named(o.arg)), o.descending) for o in q.order]
        if order:
            df = df.orderBy(*[sort_key(e, d) for e, d in order])
        if q.offset is not None:
            df = df.offset(q.offset.value)
        if q.limit is not None:
            df = df.limit(q.limit.value)
        df = self.project(df)
        return distinct(df, bool(q.order)) if q.distinct else df

    def source(self, node: t.Node) -> DataFrame:
        if isinstance(node, t.Sub):
            df = compile_query(node.query, self.sources, self.settings)
            self.scope = Scope.of(df)
            return df
        if isinstance(node, t.Root):
            if ROOT not in self.sources:
                raise ExecutionError("there is no root source")
            df = nested(self.sources[ROOT], node.path)
            self.scope = Scope.of(df)
            return df
        alias = node.alias or node.name
        if self.query.joins:
            df = self.prefixed(self.table(node), alias)
            return df
        df = self.table(node)
        self.scope = Scope.of(df, alias)
        return df

    def table(self, node: t.Table) -> DataFrame:
        if node.name in self.sources:
            return self.sources[node.name]
        if ROOT in self.sources and not self.query.joins:
            return nested(self.sources[ROOT], (node.name,))
        raise ExecutionError(f"there is no source {node.name!r}")

    def prefixed(self, df: DataFrame, alias: str) -> DataFrame:
        """The columns under names that no other source has."""
        own = Scope.of(df, alias, f"{alias}.")
        self.scope = Scope(self.scope.fields + own.fields)
        return df.select(*[F.col(quoted(f.name)).alias(f.column, metadata={"whole": f.whole}) for f in own.fields])

    def join(self, df: DataFrame, node: t.Join) -> DataFrame:
        before = self.scope
        right = self.prefixed(self.table(node.table), node.table.alias or node.table.name)
        after = Scope(self.scope.fields[len(before.fields) :])
        keys = []
        for a, b in node.on:  # either way round
            x, y = before.find(a.path), after.find(b.path)
            if (x is None or y is None) and before.find(b.path) is not None and after.find(a.path) is not None:
                x, y = before.find(b.path), after.find(a.path)
            keys.append((x or self.missing(a), y or self.missing(b)))
        return join(df, right, keys, node.kind)

    def group(self, df: DataFrame) -> DataFrame:
        q = self.query
        places: list[t.Node] = [o.expr for o in q.select or ()] + [o.arg for o in q.order] + ([q.having] if q.having is not None else [])
        aggs = list(dict.fromkeys(n for p in places for n in t.walk(p) if isinstance(n, t.Agg)))
        if not q.group and not aggs:
            return df
        self.grouped = True
        keys = [self.aliases[g.path] if isinstance(g, t.Col) and self.scope.find(g.path) is None and g.path in self.aliases else g for g in q.group]
        columns: dict[str, Column] = {}
        bound: dict[t.Node, E] = {}
        firsts: list[Column] = []
        for k, node in enumerate(dict.fromkeys(keys)):
            e, name = self.expr(node), f"__key{k}"
            columns[name] = (key(e).col if e.family == "variant" else identity(e)).alias(name)
            bound[node] = E(F.col(name), e.type, e.whole)
            if holds_variant(e.type):  # grouped by what identifies it; the first of the group stands for it
                firsts.append(F.first(e.col).alias(f"{name}v"))
                bound[node] = E(F.col(f"{name}v"), e.type)
        measures = []
        for k, a in enumerate(aggs):
            e = aggregate(a.name, None if a.arg is None else self.expr(a.arg))
            measures.append(e.col.alias(f"__agg{k}"))
            bound[a] = E(finished(a.name, F.col(f"__agg{k}")), e.type, e.whole)
        # other columns come from one row of the group
        rest = q.select is None or any(isinstance(n, t.Col) and self.scope.find(n.path) is not None for p in map(self.named, places) for n in t.walk(p, lambda n: n not in bound) if n not in bound)
        if rest:
            measures.append(F.first(F.struct(*[quoted(f.column) for f in self.scope.fields])).alias("__row"))
        measures += firsts
        out = df.groupBy(*columns.values()).agg(*(measures or [F.count(F.lit(1)).alias("__rows")])) if columns else df.agg(*measures)
        if rest:
            out = out.select("*", *[F.col("__row").getField(f.column).alias(f"__row.{f.column}") for f in self.scope.fields])
            self.scope = Scope(tuple(Field(f.alias, f.name, f"__row.{f.column}", f.type, f.whole) for f in self.scope.fields))
        else:
            self.scope = Scope(())
        self.bound |= bound
        return out

    def windows(self, df: DataFrame) -> DataFrame:
        q = self.query
        places = [o.expr for o in q.select or ()] + [self.named(o.arg) for o in q.order]
        wins = list(dict.fromkeys(n for p in places for n in t.walk(p) if isinstance(n, t.Win)))
        if not wins:
            return df
        if any(needs_sequence(w.name, list(w.order)) for w in wins):
            df = df.withColumn(SEQUENCE, F.monotonically_increasing_id())
        whole: dict[str, tuple[str, E | None]] = {}
        columns: dict[str, Column] = {}
        for k, w in enumerate(wins):
            name = f"__win{k}"
            args = None if w.args is None else [self.expr(a) for a in w.args]
            if not w.partition and w.name in ("SUM", "AVG", "MIN", "MAX", "COUNT"):
                whole[name] = w.name, args[0] if args else None
                e = aggregate(*whole[name])
            else:
                e = window(w.name, args, [self.expr(self.named(p)) for p in w.partition], [(self.expr(self.named(o.arg)), o.descending) for o in w.order])
                columns[name] = e.col
            self.bound[w] = E(F.col(name), e.type, e.whole)
        if whole:
            df = over_all(df, whole)
        return df.withColumns(columns) if columns else df

    def project(self, df: DataFrame) -> DataFrame:
        q = self.query
        if q.select is None:
            return self.everything(df)
        items = []
        for o in q.select:
            e = self.expr(o.expr)
            path = o.alias or (self.output_name(o),)
            items.append((path, e.col, {"whole": True} if e.whole else None))
        return df.select(*tree(items))

    @staticmethod
    def output_name(o: t.Output) -> str:
        """The innermost first column, or the text."""
        node = o.expr
        while isinstance(node, (t.Fn, t.Cast, t.Agg)):
            node = node.arg if not isinstance(node, t.Fn) else (node.args[0] if node.args else None)
        return ".".join(node.path) if isinstance(node, t.Col) else o.text

    def everything(self, df: DataFrame) -> DataFrame:
        if not self.query.joins:
            return df.select(*[F.col(quoted(f.column)).alias(f.name, metadata={"whole": f.whole}) for f in self.scope.fields])
        by: dict[str, list[Field]] = {}
        for f in self.scope.fields:
            by.setdefault(f.alias, []).append(f)
        return df.select(*[F.struct(*[F.col(quoted(f.column)).alias(f.name) for f in fields]).alias(alias) for alias, fields in by.items()])

    # expressions
    def named(self, node: t.Node) -> t.Node:
        """With aliases replaced by what they stand for: those of aggregates and windows always, others where no column has
        the name."""
        def visit(n: t.Node) -> t.Node | None:
            if isinstance(n, t.Agg) and not self.grouped:
                return None
            if isinstance(n, t.Col) and n.path in self.aliases:
                expr = self.aliases[n.path]
                computed = any(isinstance(x, (t.Agg, t.Win)) for x in t.walk(expr))
                if computed or (self.scope.find(n.path) is None and n not in self.bound):
                    return expr
                return n
            return None

        return t.rewrite(node, visit)

    def missing(self, node: t.Col) -> E:
        if self.scope.ambiguous(node.path):
            raise ExecutionError(f"{'.'.join(node.path)} is a column of several sources")
        if self.settings.strict_columns:
            raise ExecutionError(f"there is no column {'.'.join(node.path)}")
        return null()

    def expr(self, node: t.Node) -> E:
        if node in self.bound:
            return self.bound[node]
        if isinstance(node, t.Col):
            return self.scope.find(node.path) or self.missing(node)
        if isinstance(node, t.Lit):
            return literal(node)
        if isinstance(node, t.Fn):
            return scalar.build(node.name, [self.expr(a) for a in node.args])
        if isinstance(node, t.Cast):
            return scalar.cast(self.expr(node.arg), node.type)
        if isinstance(node, t.Case):
            return self.case(node)
        if isinstance(node, t.Array):
            own = [self.expr(i) for i in node.items]
            items, kind = unify(own)
            each = own if kind == T.VariantType() else [E(i.col, kind, value=o.value) for i, o in zip(items, own)]
            return E(F.array(*[i.col for i in items]).cast(T.ArrayType(kind)), T.ArrayType(kind), items=tuple(each))
        if isinstance(node, t.Param):
            raise ExecutionError("a parameter has no value")
        raise ExecutionError(f"{type(node).__name__} cannot stand here")

    def case(self, node: t.Case) -> E:
        results = [self.expr(r) for _, r in node.whens] + ([self.expr(node.default)] if node.default is not None else [])
        results, kind = unify(results)
        operand = None if node.operand is None else self.expr(node.operand)
        tests = [c.compare("=", operand, self.expr(w)) if operand is not None else self.condition(w) for w, _ in node.whens]
        if kind == NULL:
            return null()
        out = F.when(tests[0], results[0].col)
        for test, r in zip(tests[1:], results[1:]):
            out = out.when(test, r.col)
        if node.default is not None:
            out = out.otherwise(results[-1].col)
        return E(out, kind, all(r.whole for r in results))

    def condition(self, node: t.Node) -> Column:
        """True, or false or NULL: for filters and CASE the two are the same."""
        if isinstance(node, (t.And, t.Or)):
            parts = [self.condition(i) for i in node.items]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(node, t.And) else out | p
            return out
        if isinstance(node, t.Compare):
            a, b = self.expr(node.left), self.expr(node.right)
            if "array" in (a.family, b.family):
                if node.op not in ("=", "!="):
                    return F.lit(False)
                return c.array_op(node.op, a, b)
            return c.raw(node.op, a, b)
        if isinstance(node, t.Like):
            return c.like(self.expr(node.left), self.expr(node.right), node.negated)
        if isinstance(node, t.In):
            return c.within(self.expr(node.left), [self.expr(i) for i in node.items], node.negated)
        if isinstance(node, t.Between):
            return c.between(self.expr(node.left), self.expr(node.low), self.expr(node.high), node.negated)
        if isinstance(node, t.IsNull):
            return c.is_null(self.expr(node.left), node.negated, self.settings.nested_is_null)
        if isinstance(node, t.Contains):
            return c.contains(self.expr(node.left), self.expr(node.right))
        if isinstance(node, t.ArrayOp):
            return c.array_op(node.op, self.expr(node.left), self.expr(node.right))
        raise ExecutionError(f"{type(node).__name__} is no predicate")


def literal(node: t.Lit) -> E:
    kind = {"number": BIGINT, "double": DOUBLE, "string": STRING, "boolean": BOOLEAN, "date": DATE, "datetime": DATETIME, "decimal": T.DecimalType(38, 0), "null": NULL}[node.kind]
    if node.kind == "decimal" and node.value.as_tuple().exponent < 0:
        return E(F.lit(float(node.value)), DOUBLE, value=float(node.value))
    if node.kind == "null":
        return null()
    return E(F.lit(node.value).cast(kind), kind, value=node.value)


def nested(df: DataFrame, path: tuple[str, ...]) -> DataFrame:
    """The rows of an array, or the one row of an object, inside every row."""
    for step in path:
        kinds = {f.name: f.dataType for f in df.schema.fields}
        kind = kinds.get(step)
        if isinstance(kind, T.StructType):
            df = df.filter(F.col(quoted(step)).isNotNull()).select(f"{quoted(step)}.*")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            df = df.select(F.inline(quoted(step)))
        else:
            return df.sparkSession.createDataFrame([], T.StructType([]))
    return df
