"""Dotted paths into nested columns.

A top-level field whose literal name holds the separator wins over descent. A
step into a struct takes a field, into a map an entry, into an array either one
element (an integer step; out of bounds is an error) or that step of every
element, one level flattened and without duplicates. What the schema lacks is
null, never an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESERVED = ("_id", "_revision", "_source", "_modified")


@dataclass(frozen=True)
class Field:
    """A resolved path: its column and type; `known` is false if the schema lacks it."""

    column: Column
    type: T.DataType
    known: bool = True



def missing() -> Field:
    return Field(F.lit(None), T.NullType(), False)


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def resolve(schema: T.StructType, path: str, base: Column | None = None, separator: str = ".") -> Field:
    """The field at `path` of a row of `schema`, or of `base` if given."""
    if not path or not path.strip():
        raise ValueError("a field name must not be empty")
    top = lambda name: quoted(name) if base is None else base.getField(name)
    if path in schema.names:
        return Field(top(path), schema[path].dataType)
    first, *rest = path.split(separator)
    if first not in schema.names:
        return missing()
    return _descend(top(first), schema[first].dataType, rest)


def _descend(column: Column, kind: T.DataType, steps: list[str]) -> Field:
    if not steps:
        return Field(column, kind)
    if isinstance(kind, T.VariantType):
        inner = "".join(f"[{x}]" if x.isdigit() else "['" + x.replace("'", "\\'") + "']" for x in steps)
        return Field(F.try_variant_get(column, f"${inner}", "variant"), kind)
    step, *rest = steps
    if isinstance(kind, T.StructType):
        if step not in kind.names:
            return missing()
        return _descend(column.getField(step), kind[step].dataType, rest)
    if isinstance(kind, T.MapType):
        return _descend(column.getItem(step), kind.valueType, rest)
    if isinstance(kind, T.ArrayType):
        if step.lstrip("-").isdigit():
            if int(step) < 0:
                raise ValueError(f"negative array index {step}")
            return _descend(column[int(step)], kind.elementType, rest)
        found = _descend(F.lit(None), kind.elementType, steps)
        if not found.known:
            return missing()
        each = F.transform(column, lambda x: _descend(x, kind.elementType, steps).column)
        out: T.DataType = T.ArrayType(found.type)
        if isinstance(found.type, T.ArrayType):
            each, out = F.flatten(F.filter(each, lambda x: x.isNotNull())), found.type
        return Field(F.array_distinct(each), out)
    return missing()


def leaves(schema: T.StructType, prefix: str = "", separator: str = ".") -> list[str]:
    """Paths of the fields that aren't structs, without the reserved ones."""
    out = []
    for f in schema.fields:
        if not prefix and f.name in RESERVED:
            continue
        name = f"{prefix}{f.name}"
        out += leaves(f.dataType, f"{name}{separator}", separator) if isinstance(f.dataType, T.StructType) else [name]
    return out
