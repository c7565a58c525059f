"""Columns with a static type, and the families by which the dialect compares values.

Values of different families are never equal, and are ordered by the rank of their family; the families are known when a
query is compiled, so such comparisons become constants. Only a VARIANT column (values of several types, from JSON or
from a CASE whose results differ in family) is compared by a key at run time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestquery.errors import ExecutionError

#: Order of the families.
RANK = {"null": 0, "boolean": 1, "number": 2, "string": 3, "date": 4, "datetime": 5}
BIGINT, DOUBLE, STRING, BOOLEAN, DATE, DATETIME, NULL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.DateType(), T.TimestampNTZType(), T.NullType()
VARIANT = T.VariantType()


@dataclass(frozen=True)
class E:
    """A column and its type. ``whole``: a JSON sink prints whole values without a fraction."""

    col: Column
    type: T.DataType
    whole: bool = False
    #: The value of a literal, which some functions need when the query is compiled.
    value: object = None
    #: The elements of an array that the query lists.
    items: tuple[E, ...] | None = None

    @property
    def family(self) -> str:
        return family(self.type)

    @property
    def scalar(self) -> bool:
        return self.family in RANK or self.family == "variant"


def family(kind: T.DataType) -> str:
    if isinstance(kind, T.NullType):
        return "null"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, T.StructType):
        return "struct"
    if isinstance(kind, T.VariantType):
        return "variant"
    return "other"


def null(kind: T.DataType = NULL) -> E:
    return E(F.lit(None).cast(kind), kind)


def text(e: E) -> E:
    """As a string: booleans in lower case, a datetime with ``T`` and without seconds that are zero."""
    if e.family == "string":
        return e
    if e.family == "datetime":
        ts = e.col
        fraction = F.rtrim(F.lit("0"), F.date_format(ts, ".SSSSSS"))
        seconds = F.when(F.date_format(ts, "ssSSSSSS") == "00000000", F.lit("")).otherwise(F.concat(F.date_format(ts, ":ss"), F.when(fraction == ".", F.lit("")).otherwise(fraction)))
        return E(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm"), seconds), STRING)
    if e.family == "variant":
        return E(F.try_variant_get(scalars(e.col), "$", "string"), STRING)
    if not e.scalar:
        return null(STRING)
    return E(e.col.cast("string"), STRING)


def number(e: E) -> E:
    """The number that a value is; NULL for one of another family."""
    if e.family == "number":
        return e
    if e.family == "variant":
        return E(F.when(rank(e.col) == RANK["number"], F.try_variant_get(e.col, "$", "double")), DOUBLE)
    return null(DOUBLE)


def double(e: E) -> Column:
    return number(e).col.cast("double")


def integer(e: E) -> Column:
    return number(e).col.cast("int")


def date_or_time(e: E, whole_days: bool = False) -> E:
    """A date or datetime, from ISO text too; NULL for what is neither."""
    if e.family in ("date", "datetime"):
        return E(e.col.cast("date"), DATE) if whole_days else e
    if e.family in ("string", "variant"):
        s = text(e).col
        iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"), s)
        return E(iso.try_cast("date"), DATE) if whole_days else E(iso.try_cast("timestamp_ntz"), DATETIME)
    return null(DATETIME)


def schema_name(v: Column) -> Column:
    return F.schema_of_variant(v)


def scalars(v: Column) -> Column:
    """The variant where it is a scalar, else NULL."""
    return F.when(~schema_name(v).rlike("^(ARRAY|OBJECT)"), v)


def rank(v: Column) -> Column:
    """The rank of a variant's value."""
    name = schema_name(v)
    return F.when(v.isNull() | F.is_variant_null(v) | name.rlike("^(ARRAY|OBJECT)"), 0).when(name == "BOOLEAN", 1).when(name == "STRING", 3).when(name == "DATE", 4).when(name.startswith("TIMESTAMP"), 5).otherwise(2)


def _days(d: Column) -> Column:
    return F.unix_date(d).cast("double")


def _micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts).cast("double")


def key(e: E) -> E:
    """What a value is grouped, ordered and compared by."""
    if e.family != "variant":
        return e
    r = rank(e.col)
    fields = [r.alias("rank"), F.when(r == 1, F.try_variant_get(e.col, "$", "boolean")).alias("b"), F.when(r == 2, F.try_variant_get(e.col, "$", "double")).when(r == 4, _days(F.try_variant_get(e.col, "$", "date"))).when(r == 5, _micros(F.try_variant_get(e.col, "$", "timestamp_ntz"))).alias("n"), F.when(r == 3, F.try_variant_get(e.col, "$", "string")).alias("s")]
    kind = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("b", BOOLEAN), T.StructField("n", DOUBLE), T.StructField("s", STRING)])
    return E(F.when(r > 0, F.struct(*fields)), kind)


def variant_key(e: E) -> Column:
    """The same of a scalar of a static type, to compare it with a variant."""
    pick = lambda f, kind: (e.col if e.family == f else F.lit(None)).cast(kind)
    n = _days(e.col.cast("date")) if e.family == "date" else _micros(e.col.cast("timestamp_ntz")) if e.family == "datetime" else pick("number", "double")
    return F.when(e.col.isNotNull(), F.struct(F.lit(RANK[e.family]).alias("rank"), pick("boolean", "boolean").alias("b"), n.alias("n"), pick("string", "string").alias("s")))


def _token(e: E) -> Column:
    """A text that a scalar of a static type shares with its equals alone, of any family; NULL for NULL and nested values."""
    if e.family not in RANK or e.family == "null":
        return F.lit(None).cast("string")
    n = {"number": lambda: e.col.cast("double"), "date": lambda: _days(e.col), "datetime": lambda: _micros(e.col.cast("timestamp_ntz"))}.get(e.family)
    s = e.col.cast("string") if n is None else (n() + F.lit(0.0)).cast("string")  # -0.0 is 0.0
    return F.concat(F.lit(str(RANK[e.family])), s)


def _variant_tokens(c: Column) -> Column:
    """The same of the elements of an array of variants. The schema of each is made once."""

    def one(v: Column) -> Column:
        name, get = v["name"], lambda kind: F.try_variant_get(v["value"], "$", kind.simpleString())
        nested = (name == "VOID") | name.startswith("ARRAY") | name.startswith("OBJECT")
        pick = lambda kind: _token(E(get(kind), kind))
        return F.when(name == "STRING", pick(STRING)).when(name == "BOOLEAN", pick(BOOLEAN)).when(name == "DATE", pick(DATE)).when(name.startswith("TIMESTAMP"), pick(DATETIME)).when(~nested, F.coalesce(pick(DOUBLE), F.concat(F.lit("9"), F.to_json(v["value"]))))  # binary is no number

    return F.transform(F.transform(c, lambda v: F.struct(schema_name(v).alias("name"), v.alias("value"))), one)


def token(e: E) -> Column:
    return F.get(_variant_tokens(F.array(e.col)), F.lit(0)) if e.family == "variant" else _token(e)


def tokens(e: E, missing: str | None = None) -> Column:
    """The tokens of an array's elements; ``missing`` stands for NULL. Literals are folded into a constant."""
    filled = lambda c: c if missing is None else F.coalesce(c, F.lit(missing))
    kind = e.type.elementType
    if e.items is not None:
        return F.array(*[filled(token(i)) for i in e.items]).cast("array<string>")
    if isinstance(kind, T.VariantType):
        all_of = _variant_tokens(e.col)
        return all_of if missing is None else F.transform(all_of, filled)
    return F.transform(e.col, lambda v: filled(_token(E(v, kind))))


def holds_variant(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return holds_variant(kind.elementType)
    if isinstance(kind, T.MapType):
        return holds_variant(kind.keyType) or holds_variant(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(holds_variant(f.dataType) for f in kind.fields)
    return isinstance(kind, T.VariantType)


def identity(e: E) -> Column:
    """What rows are told apart by: the key, and for nested values of several types their JSON."""
    if e.family == "variant":
        nested = F.when(e.col.isNotNull() & ~F.is_variant_null(e.col) & schema_name(e.col).rlike("^(ARRAY|OBJECT)"), F.to_json(e.col))
        return F.struct(key(e).col.alias("k"), nested.alias("j"))
    return F.to_json(F.struct(e.col.alias("v"))) if holds_variant(e.type) else e.col


def as_variant(e: E) -> E:
    if e.family == "variant":
        return e
    if e.family == "null":
        return null(VARIANT)
    return E(e.col.cast("variant") if e.scalar else F.to_variant_object(e.col), VARIANT)


def unify(items: list[E]) -> tuple[list[E], T.DataType]:
    """Values for one column: of one family as they are, of several as VARIANT, where each keeps its type."""
    some = [e for e in items if e.family != "null"]
    if not some:
        return items, NULL
    families = {e.family for e in some}
    if families == {"date", "datetime"}:
        some_type: T.DataType = DATETIME
    elif len(families) > 1:
        if "other" in families:
            raise ExecutionError("values of these types cannot share a column")
        return [as_variant(e) for e in items], VARIANT
    elif families == {"number"}:
        kinds = {type(e.type) for e in some}
        if len(kinds) == 1:
            some_type = some[0].type
        else:
            some_type = DOUBLE if kinds & {T.DoubleType, T.FloatType} else T.DecimalType(38, 0) if T.DecimalType in kinds else BIGINT
    elif len({e.type.simpleString() for e in some}) > 1 and families & {"array", "struct"}:
        return [as_variant(e) for e in items], VARIANT
    else:
        some_type = some[0].type
    return [E(e.col.cast(some_type), some_type, e.whole) for e in items], some_type
