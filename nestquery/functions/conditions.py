"""Predicates. Each gives true or false, never NULL: a comparison with NULL is false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import BIGINT, DOUBLE, RANK, E, key, schema_name, text, token, tokens, variant_key

_ORDERED = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _no() -> Column:
    return F.lit(False)


def sure(c: Column) -> Column:
    return F.coalesce(c, _no())


def raw(op: str, a: E, b: E) -> Column:
    """The comparison as a filter needs it: NULL where a side is NULL, so that it can reach the scan."""
    if not (a.scalar and b.scalar) or "null" in (a.family, b.family):
        return _no()
    x, y = a.col, b.col
    if "variant" in (a.family, b.family):
        x, y = (key(e).col if e.family == "variant" else variant_key(e) for e in (a, b))
    elif a.family != b.family:
        both = x.isNotNull() & y.isNotNull()
        if op == "=":
            return _no()
        if op == "!=":
            return both
        return both & F.lit(bool(_ORDERED[op](RANK[a.family], RANK[b.family])))
    if op == "=":
        return x == y
    if op == "!=":
        return x != y
    return _ORDERED[op](x, y)


def compare(op: str, a: E, b: E) -> Column:
    return sure(raw(op, a, b))


def like(a: E, pattern: E, negated: bool) -> Column:
    """Without regard to case; ``\\`` is an ordinary character."""
    if a.family not in ("string", "variant") or pattern.family == "null":
        return _no()
    left = text(a).col
    if isinstance(pattern.value, str):
        p: Column = F.lit(pattern.value.replace("\\", "\\\\"))
        hit = left.ilike(pattern.value.replace("\\", "\\\\"))
    else:
        p = F.replace(text(pattern).col, F.lit("\\"), F.lit("\\\\"))
        hit = F.ilike(left, p)
    return ~hit if negated else hit


def within(a: E, items: list[E], negated: bool) -> Column:
    """NULL items don't count."""
    if not a.scalar or a.family == "null":
        return _no()
    if a.family == "variant":
        hits = [compare("=", a, i) for i in items if i.family != "null"]
        any_hit = hits[0] if hits else _no()
        for h in hits[1:]:
            any_hit = any_hit | h
        return a.col.isNotNull() & ~any_hit if negated else any_hit
    use = [i for i in items if i.family == a.family]
    if not use:
        return a.col.isNotNull() if negated else _no()
    if all(i.value is not None for i in use):
        hit = a.col.isin([i.value for i in use])
        return ~hit if negated else hit
    hit = sure(a.col == use[0].col)
    for i in use[1:]:
        hit = hit | sure(a.col == i.col)
    return a.col.isNotNull() & ~hit if negated else hit


def between(a: E, low: E, high: E, negated: bool) -> Column:
    if negated:
        known = a.col.isNotNull() & low.col.isNotNull() & high.col.isNotNull()
        return known & ~(compare(">=", a, low) & compare("<=", a, high))
    return raw(">=", a, low) & raw("<=", a, high)


def is_null(a: E, negated: bool, nested: bool = False) -> Column:
    """``nested``: objects and arrays count as NULL too."""
    if a.family == "null" or (nested and a.family in ("array", "struct")):
        return F.lit(not negated)
    c = a.col.isNull()
    if a.family == "variant":
        c = c | F.is_variant_null(a.col)
        if nested:
            c = c | schema_name(a.col).rlike("^(ARRAY|OBJECT)")
    return ~c if negated else c


def _array(a: E) -> E | None:
    """An array; of a VARIANT the arrays among its values."""
    if a.family == "variant":
        kind = T.ArrayType(T.VariantType())
        return E(F.try_variant_get(a.col, "$", "array<variant>"), kind)
    return a if a.family == "array" else None


def _equal(a: E, b: E, x: Column, y: Column) -> Column:
    """Whether an element of ``a`` and one of ``b`` are equal; NULL is equal to nothing."""
    left, right = E(x, a.type.elementType), E(y, b.type.elementType)
    if left.family == right.family and not left.scalar:
        return sure(x == y)
    return compare("=", left, right)


def contains(a: E, needle: E) -> Column:
    a = _array(a)
    if a is None or needle.family == "null" or not needle.scalar:
        return _no()
    element = E(a.col, a.type.elementType)
    if "variant" in (element.family, needle.family):
        return sure(F.array_contains(tokens(a), token(needle)))
    if element.family != needle.family:
        return _no()
    if element.type == needle.type:
        return sure(F.array_contains(a.col, needle.col))
    one = E(needle.col, T.ArrayType(needle.type))
    return sure(F.exists(a.col, lambda x: _equal(a, one, x, needle.col)))


def _plain(a: E, b: E) -> tuple[Column, Column] | None:
    """Arrays of one static type whose elements are equal where Spark says so."""
    kinds = [e.type.elementType for e in (a, b)]
    if all(isinstance(k, T.IntegralType) for k in kinds):
        return a.col.cast(T.ArrayType(BIGINT)), b.col.cast(T.ArrayType(BIGINT))
    if all(isinstance(k, T.NumericType) for k in kinds) and any(isinstance(k, (T.DoubleType, T.FloatType)) for k in kinds):
        x, y = (F.transform(e.col.cast(T.ArrayType(DOUBLE)), lambda v: v + F.lit(0.0)) for e in (a, b))  # -0.0 is 0.0
        return x, y
    return (a.col, b.col) if kinds[0] == kinds[1] and E(a.col, kinds[0]).family not in ("null", "variant") else None


def _each(haystack: Column, needles: Column) -> Column:
    """Every needle is in the haystack, which holds no NULL; a NULL one is not. Both arrays are gone through once."""
    return sure(F.array_size(F.array_except(needles, haystack)) == 0)


def _known(e: E, c: Column) -> Column:
    """The array without its NULLs."""
    return c if e.items is not None and all(i.value is not None for i in e.items) else F.array_compact(c)


def array_op(op: str, a: E, b: E) -> Column:
    """Sets for ``@>``, ``<@`` and ``&&``, order and length for ``=``."""
    a, b = _array(a), _array(b)
    if a is None or b is None:
        return _no()
    if op == "<@":
        return array_op("@>", b, a)
    if op == "!=":
        return a.col.isNotNull() & b.col.isNotNull() & ~array_op("=", a, b)
    nested = [not E(e.col, e.type.elementType).scalar for e in (a, b)]
    plain = None if any(nested) else _plain(a, b)
    if any(nested) or (plain is None and _same_family(a, b)):
        return _pairs(op, a, b)
    if op == "@>":
        return _each(tokens(a, ""), tokens(b)) if plain is None else _each(_known(a, plain[0]), plain[1])
    if op == "&&":
        return sure(F.arrays_overlap(*(plain or (tokens(a), tokens(b)))))
    if plain is None:
        return sure(tokens(a, "") == tokens(b))
    return sure((plain[0] == plain[1]) & F.forall(plain[0], lambda x: x.isNotNull()))


def _same_family(a: E, b: E) -> bool:
    x, y = (E(e.col, e.type.elementType).family for e in (a, b))
    return x == y and x not in ("null", "variant")


def _pairs(op: str, a: E, b: E) -> Column:
    """For elements that have no set of their own: nested ones, decimals and times of different types. One by one."""
    inside = lambda haystack, needles, v: sure(F.exists(haystack.col, lambda x: _equal(haystack, needles, x, v)))
    if op == "@>":
        return sure(F.forall(b.col, lambda v: inside(a, b, v))) & a.col.isNotNull() & b.col.isNotNull()
    if op == "&&":
        return sure(F.exists(a.col, lambda v: inside(b, a, v)))
    return sure((F.size(a.col) == F.size(b.col)) & F.forall(F.zip_with(a.col, b.col, lambda x, y: _equal(a, b, x, y)), lambda ok: ok))
