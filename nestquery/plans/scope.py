"""Names of a query's rows and the columns they stand for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestquery.functions.types import E


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Field:
    alias: str | None
    name: str
    #: Its name in the DataFrame.
    column: str
    type: T.DataType
    whole: bool = False


@dataclass(frozen=True)
class Scope:
    fields: tuple[Field, ...]

    @staticmethod
    def of(df: DataFrame, alias: str | None = None, prefix: str = "") -> Scope:
        return Scope(tuple(Field(alias, f.name, prefix + f.name, f.dataType, bool((f.metadata or {}).get("whole"))) for f in df.schema.fields))

    def find(self, path: tuple[str, ...]) -> E | None:
        """The column of a path: first by alias and name, then by a name that only one source has. Names may hold dots;
        what is left of the path leads into structs, where a missing field is NULL as well."""
        by_alias = [f for f in self.fields if f.alias is not None and f.alias == path[0]]
        if by_alias and len(path) > 1:
            hit = self._in(by_alias, path[1:])
            if hit is not None:
                return hit
        hits = {f.alias for f in self.fields if any(f.name == ".".join(path[:n]) for n in range(1, len(path) + 1))}
        if len(hits) == 1:
            return self._in([f for f in self.fields if f.alias in hits], path)
        return None

    @staticmethod
    def _in(fields: list[Field], path: tuple[str, ...]) -> E | None:
        names = {f.name: f for f in fields}
        for n in range(len(path), 0, -1):
            f = names.get(".".join(path[:n]))
            if f is not None:
                return _into(E(F.col(quoted(f.column)), f.type, f.whole), path[n:])
        return None

    def ambiguous(self, path: tuple[str, ...]) -> bool:
        return len({f.alias for f in self.fields if f.name == path[0]}) > 1


def _into(e: E, path: tuple[str, ...]) -> E | None:
    for step in path:
        if isinstance(e.type, T.StructType):
            kinds = {f.name: f.dataType for f in e.type.fields}
            if step not in kinds:
                return None
            e = E(e.col.getField(step), kinds[step])
        elif isinstance(e.type, T.MapType) and isinstance(e.type.keyType, T.StringType):
            e = E(e.col.getItem(step), e.type.valueType)
        elif isinstance(e.type, T.VariantType):
            e = E(F.try_variant_get(e.col, f"$['{step}']", "variant"), e.type)
        else:
            return None
    return e


def tree(items: list[tuple[tuple[str, ...], Column, dict | None]]) -> list[Column]:
    """Output columns; those whose names have several parts are put together as structs. Of equal names the last counts."""
    root: dict[str, object] = {}
    for path, col, meta in items:
        at = root
        for step in path[:-1]:
            if not isinstance(at.get(step), dict):
                at[step] = {}
            at = at[step]
        at[path[-1]] = (col, meta)

    def column(name: str, value: object) -> Column:
        if isinstance(value, dict):
            return F.struct(*[column(k, v) for k, v in value.items()]).alias(name)
        col, meta = value
        return col.alias(name, metadata=meta) if meta else col.alias(name)

    return [column(k, v) for k, v in root.items()]
