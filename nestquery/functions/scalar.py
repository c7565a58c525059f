"""The scalar functions: how many arguments each takes, and its column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestquery.errors import ExecutionError

from .conditions import compare
from .types import BIGINT, BOOLEAN, DATE, DATETIME, DOUBLE, NULL, STRING, E, date_or_time, double, integer, null, number, text, unify

#: Least and greatest number of arguments.
ARITY: dict[str, tuple[int, int | None]] = {
    "LOWER": (1, 2), "UPPER": (1, 2), "CONCAT": (1, None), "SUBSTRING": (2, 3), "TRIM": (1, 1), "LENGTH": (1, 1), "REPLACE": (3, 3), "LEFT": (2, 2), "RIGHT": (2, 2), "LPAD": (3, 3), "RPAD": (3, 3), "REVERSE": (1, 1), "POSITION": (2, 2),
    "ABS": (1, 1), "ROUND": (1, 2), "CEIL": (1, 1), "FLOOR": (1, 1), "MOD": (2, 2), "POWER": (2, 2), "SQRT": (1, 1), "SIGN": (1, 1),
    "YEAR": (1, 1), "MONTH": (1, 1), "DAY": (1, 1), "HOUR": (1, 1), "MINUTE": (1, 1), "SECOND": (1, 1), "DATE_ADD": (3, 3), "DATE_DIFF": (3, 3), "TO_DATE": (1, 2), "NOW": (0, 0),
    "NULLIF": (2, 2), "COALESCE": (1, None),
}
UNITS = ("YEAR", "MONTH", "WEEK", "DAY", "HOUR", "MINUTE", "SECOND")
#: Units that are so many of another; a nanosecond is a thousandth of the smallest that a datetime holds.
MULTIPLES = {"DECADE": (10, "YEAR"), "CENTURIE": (100, "YEAR"), "CENTURY": (100, "YEAR"), "MILLENNIA": (1000, "YEAR"), "MILLENNIUM": (1000, "YEAR"), "HALF_DAY": (12, "HOUR"), "MILLI": (1000, "MICROSECOND"), "MILLISECOND": (1000, "MICROSECOND"), "MICRO": (1, "MICROSECOND"), "MICROSECOND": (1, "MICROSECOND"), "NANO": (0, "MICROSECOND"), "NANOSECOND": (0, "MICROSECOND")}
#: Languages whose dotted and dotless i are two letters.
_TURKIC = ("tr", "az")

Builder = Callable[..., E]
_BUILD: dict[str, Builder] = {}


def _as(name: str) -> Callable[[Builder], Builder]:
    def put(f: Builder) -> Builder:
        _BUILD[name] = f
        return f

    return put


def build(name: str, args: list[E]) -> E:
    return _BUILD[name](*args)


def _constant(e: E, what: str) -> object:
    if e.value is None:
        raise ExecutionError(f"{what} has to be a constant")
    return e.value


def _language(locale: E | None) -> str:
    return "" if locale is None else str(_constant(locale, "a locale")).replace("_", "-").split("-")[0].lower()


@_as("LOWER")
def _lower(s: E, locale: E | None = None) -> E:
    c = text(s).col
    return E(F.lower(F.translate(c, "Iİ", "ıi") if _language(locale) in _TURKIC else c), STRING)


@_as("UPPER")
def _upper(s: E, locale: E | None = None) -> E:
    c = text(s).col
    return E(F.upper(F.translate(c, "iı", "İI") if _language(locale) in _TURKIC else c), STRING)


@_as("CONCAT")
def _concat(*items: E) -> E:
    return E(F.concat(*[text(e).col for e in items]), STRING)


@_as("SUBSTRING")
def _substring(s: E, start: E, length: E | None = None) -> E:
    """A start before 1 shortens the length."""
    c, a = text(s).col, integer(start)
    if length is None:
        return E(F.substring(c, F.greatest(a, F.lit(1)), F.lit(2**31 - 1)), STRING)
    n = integer(length) + F.least(a - 1, F.lit(0))
    return E(F.substring(c, F.greatest(a, F.lit(1)), F.greatest(n, F.lit(0))), STRING)


@_as("TRIM")
def _trim(s: E) -> E:
    return E(F.regexp_replace(text(s).col, r"(?U)^\s+|(?U)\s+$", ""), STRING)


@_as("LENGTH")
def _length(s: E) -> E:
    return E(F.length(text(s).col).cast("bigint"), BIGINT)


@_as("REPLACE")
def _replace(s: E, old: E, new: E) -> E:
    return E(F.replace(text(s).col, text(old).col, text(new).col), STRING)


@_as("LEFT")
def _left(s: E, n: E) -> E:
    return E(F.left(text(s).col, integer(n)), STRING)


@_as("RIGHT")
def _right(s: E, n: E) -> E:
    return E(F.right(text(s).col, integer(n)), STRING)


@_as("LPAD")
def _lpad(s: E, n: E, pad: E) -> E:
    return E(F.call_function("lpad", text(s).col, integer(n), text(pad).col), STRING)


@_as("RPAD")
def _rpad(s: E, n: E, pad: E) -> E:
    return E(F.call_function("rpad", text(s).col, integer(n), text(pad).col), STRING)


@_as("REVERSE")
def _reverse(s: E) -> E:
    return E(F.reverse(text(s).col), STRING)


@_as("POSITION")
def _position(part: E, s: E) -> E:
    return E(F.position(text(part).col, text(s).col).cast("bigint"), BIGINT)


def _whole_number(e: E) -> bool:
    return isinstance(e.type, T.IntegralType)


@_as("ABS")
def _abs(n: E) -> E:
    e = number(n)
    return E(F.abs(e.col), e.type, True)


@_as("ROUND")
def _round(n: E, digits: E | None = None) -> E:
    e = number(n)
    if digits is None:
        return E(F.round(e.col), e.type, True) if not isinstance(e.type, T.DecimalType) else E(F.round(e.col.cast("double")), DOUBLE, True)
    d = digits.value if isinstance(digits.value, int) else None
    if d is None:
        power = F.pow(F.lit(10.0), double(digits))
        return E(F.round(double(n) * power) / power, DOUBLE, True)
    return E(F.round(e.col.cast("double") if isinstance(e.type, T.DecimalType) else e.col, d), DOUBLE if isinstance(e.type, T.DecimalType) else e.type, True)


@_as("CEIL")
def _ceil(n: E) -> E:
    return E(F.ceil(number(n).col).cast("bigint"), BIGINT)


@_as("FLOOR")
def _floor(n: E) -> E:
    return E(F.floor(number(n).col).cast("bigint"), BIGINT)


@_as("MOD")
def _mod(a: E, b: E) -> E:
    x, y = number(a), number(b)
    if _whole_number(x) and _whole_number(y):
        return E(F.try_mod(x.col.cast("bigint"), y.col.cast("bigint")), BIGINT)
    return E(F.try_mod(x.col.cast("double"), y.col.cast("double")), DOUBLE, True)


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


@_as("POWER")
def _power(a: E, b: E) -> E:
    return E(_finite(F.pow(double(a), double(b))), DOUBLE, True)


@_as("SQRT")
def _sqrt(n: E) -> E:
    c = double(n)
    return E(F.when(c >= 0, F.sqrt(c)), DOUBLE, True)


@_as("SIGN")
def _sign(n: E) -> E:
    return E(F.signum(double(n)).cast("bigint"), BIGINT)


def _part(name: str, f: Callable[[Column], Column], days: bool) -> None:
    _BUILD[name] = lambda d: E(f(date_or_time(d, whole_days=days).col.cast("date" if days else "timestamp_ntz")).cast("bigint"), BIGINT)


for _name, _f in (("YEAR", F.year), ("MONTH", F.month), ("DAY", F.dayofmonth)):
    _part(_name, _f, True)
for _name, _f in (("HOUR", F.hour), ("MINUTE", F.minute), ("SECOND", F.second)):
    _part(_name, _f, False)


def _unit(e: E) -> str:
    unit = str(_constant(e, "a unit of time")).upper()
    unit = unit[:-1] if unit.endswith("S") else unit
    if unit not in UNITS and unit not in MULTIPLES:
        raise ExecutionError(f"{e.value!r} is no unit of time")
    return unit


@_as("DATE_ADD")
def _date_add(d: E, n: E, unit: E) -> E:
    at, name = date_or_time(d), _unit(unit)
    many, base = MULTIPLES.get(name, (1, name))
    amount = integer(n).cast("bigint") * many if many else F.floor(integer(n) / 1000)
    moved = F.timestamp_add(base, amount, at.col.cast("timestamp_ntz"))
    name = base
    if at.family == "date" and name in ("YEAR", "MONTH", "WEEK", "DAY"):
        return E(moved.cast("date"), DATE)
    return E(moved, DATETIME)


@_as("DATE_DIFF")
def _date_diff(a: E, b: E, unit: E) -> E:
    name = _unit(unit)
    many, base = MULTIPLES.get(name, (1, name))
    n = F.timestamp_diff(base, date_or_time(b).col.cast("timestamp_ntz"), date_or_time(a).col.cast("timestamp_ntz"))
    whole = F.when(n < 0, -F.floor(-n / many)).otherwise(F.floor(n / many)) if many > 1 else n * 1000 if not many else n
    return E(whole.cast("bigint"), BIGINT)


@_as("TO_DATE")
def _to_date(s: E, pattern: E | None = None) -> E:
    """Dates and datetimes pass. By a pattern with letters of time it is a datetime, by another a date. Without a pattern a
    constant decides by its shape; any other text gives a datetime. Text that is no date is an error."""
    if s.family in ("date", "datetime", "null"):
        return s if s.family != "null" else null(DATE)
    c = text(s).col
    if pattern is not None:
        p = str(_constant(pattern, "a date pattern"))
        timed = any(x in "HhKkmsSaAnN" for x in "".join(p.split("'")[::2]))
        p = p.replace("uuuu", "yyyy")
        return E(F.to_timestamp_ntz(c, F.lit(p)), DATETIME) if timed else E(F.to_timestamp_ntz(c, F.lit(p)).cast("date"), DATE)
    if isinstance(s.value, str) and "T" not in s.value and " " not in s.value.strip():
        return E(c.cast("date"), DATE)
    return E(c.cast("timestamp_ntz"), DATETIME)


@_as("NOW")
def _now() -> E:
    return E(F.localtimestamp(), DATETIME)


@_as("NULLIF")
def _nullif(a: E, b: E) -> E:
    return E(F.when(~compare("=", a, b), a.col), a.type, a.whole) if a.family != "null" else a


@_as("COALESCE")
def _coalesce(*items: E) -> E:
    some = [E(F.when(~F.is_variant_null(e.col), e.col), e.type) if e.family == "variant" else e for e in items]
    same, kind = unify(some)
    return E(F.coalesce(*[e.col for e in same]), kind, all(e.whole for e in same)) if kind != NULL else null()


def cast(e: E, to: str) -> E:
    f, c = e.family, e.col
    if f == "null":
        return null({"STRING": STRING, "NUMBER": DOUBLE, "DECIMAL": DOUBLE, "INTEGER": BIGINT, "BOOLEAN": BOOLEAN, "DATE": DATE, "DATETIME": DATETIME}[to])
    if f == "variant":
        if to in ("NUMBER", "DECIMAL", "INTEGER"):
            e = E(F.try_variant_get(c, "$", "double"), DOUBLE)
        else:
            e = text(e)
        f, c = e.family, e.col
    if to == "STRING":
        return text(e)
    if to in ("NUMBER", "DECIMAL"):
        if f == "number":
            return E(c, e.type, True)
        if f == "date":
            return E(F.unix_date(c).cast("double"), DOUBLE, True)
        if f == "datetime":
            return E(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz")).cast("double"), DOUBLE, True)
        if f in ("string", "boolean"):
            return E(c.cast("double"), DOUBLE, True)
    if to == "INTEGER":
        if f in ("string", "boolean"):
            return E(c.cast("double").cast("bigint"), BIGINT)
        if f == "number":
            return E(c.cast("bigint"), BIGINT)
    if to == "BOOLEAN":
        if f == "boolean":
            return e
        if f == "string":
            return E(F.lower(c) == "true", BOOLEAN)
        if f == "number":
            return E(c.cast("double") != 0, BOOLEAN)
    if to == "DATE" and f in ("date", "datetime", "string"):
        return E(c.cast("date"), DATE)
    if to == "DATETIME" and f in ("date", "datetime", "string"):
        return E(c.cast("timestamp_ntz"), DATETIME)
    raise ExecutionError(f"a {f} cannot be cast to {to}")
