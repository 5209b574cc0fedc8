"""Types of documents: what new ones need, what old and new ones share, and columns of values of several kinds.

A field holds values of one kind as long as it can. Integers of several widths
become the widest, and so do floats; a field that was null so far takes any kind;
inner documents merge field by field. A field with values of different kinds, or
of integers and floats, which are never equal, becomes a VARIANT column, in which
each value keeps its kind.
"""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import type_kind

VARIANT = T.VariantType()
_WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 3, T.LongType: 4, T.FloatType: 1, T.DoubleType: 2}
_PYTHON = (
    (bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType()), ((bytes, bytearray), T.BinaryType()),
    (dt.datetime, T.TimestampType()), (dt.date, T.DateType()),
)


def merge(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type of a field that holds values of both."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merge_rows(a, b)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        element = merge(a.elementType, b.elementType)
        return VARIANT if _holds_variant(element) else T.ArrayType(element)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType) and a.keyType == b.keyType:
        return T.MapType(a.keyType, merge(a.valueType, b.valueType))
    kind = type_kind(a)
    if kind == type_kind(b) and kind in ("int", "float"):
        if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
            return a if isinstance(a, T.DecimalType) else b
        return a if _WIDTH[type(a)] >= _WIDTH[type(b)] else b
    return VARIANT


def merge_rows(a: T.StructType, b: T.StructType) -> T.StructType:
    out = [T.StructField(f.name, merge(f.dataType, b[f.name].dataType) if f.name in b.names else f.dataType) for f in a.fields]
    return T.StructType([*out, *[T.StructField(f.name, f.dataType) for f in b.fields if f.name not in a.names]])


def _holds_variant(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_variant(f.dataType) for f in kind.fields)
    return isinstance(kind, T.VariantType) or isinstance(kind, T.ArrayType) and _holds_variant(kind.elementType)


def type_of(values: list[Any]) -> T.DataType:
    """The type of Python values; void if all are null."""
    out: T.DataType = T.NullType()
    for v in values:
        if v is not None:
            out = merge(out, _one(v))
    return VARIANT if _holds_variant(out) else out


def _one(v: Any) -> T.DataType:
    if isinstance(v, dict):
        return T.StructType([T.StructField(k, type_of([x])) for k, x in v.items()]) if v else T.NullType()
    if isinstance(v, (list, tuple)):
        return T.ArrayType(type_of(list(v)))
    if isinstance(v, Decimal):
        return T.DecimalType(38, max(0, -int(v.as_tuple().exponent)))
    for cls, kind in _PYTHON:
        if isinstance(v, cls):
            return kind
    raise TypeError(f"no column type for {type(v).__name__}")


def frame(spark: SparkSession, rows: list[dict[str, Any]], names: list[str]) -> DataFrame:
    """Documents as rows of their own types."""
    kinds = {n: T.ArrayType(T.StringType()) if n == "_fields" else type_of([r.get(n) for r in rows]) for n in names}
    mixed = [n for n, k in kinds.items() if isinstance(k, T.VariantType)]
    held = T.StructType([T.StructField(n, _KINDS if n in mixed else k) for n, k in kinds.items()])
    made = spark.createDataFrame([tuple(_by_kind(r.get(n)) if n in mixed else _plain(r.get(n), kinds[n]) for n in names) for r in rows], held)
    return made.select(*[_variant(F.col(f"`{n}`")).alias(n) if n in mixed else F.col(f"`{n}`") for n in names])


#: One field for each kind of value; others are JSON.
_KINDS = T.StructType([*[T.StructField(f"k{i}", kind) for i, (_, kind) in enumerate(_PYTHON)], T.StructField("json", T.StringType())])


def _by_kind(v: Any) -> tuple | None:
    if v is None:
        return None
    out: list[Any] = [None] * len(_KINDS)
    for i, (cls, _) in enumerate(_PYTHON):
        if isinstance(v, cls):
            out[i] = bytes(v) if isinstance(v, bytearray) else v
            return tuple(out)
    out[-1] = json.dumps(v, default=str)
    return tuple(out)


def _plain(v: Any, kind: T.DataType) -> Any:
    """A value as its column's type wants it."""
    if v is None or v == {} and isinstance(kind, T.NullType):
        return None
    if isinstance(kind, T.StructType):
        return tuple(_plain(v.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_plain(x, kind.elementType) for x in v]
    if isinstance(kind, T.DecimalType) and isinstance(v, int):
        return Decimal(v)
    return v


def _variant(c: Column) -> Column:
    cast = [c[f.name].cast(VARIANT) for f in _KINDS.fields[:-1]]
    return F.coalesce(*cast, F.parse_json(c["json"]))


def literal(value: Any) -> Column:
    """A Python value as a variant."""
    if value is None:
        return F.lit(None).cast(VARIANT)
    if isinstance(value, (dict, list, tuple)):
        return F.parse_json(F.lit(json.dumps(value, default=str)))
    return F.lit(value).cast(VARIANT)


def as_type(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """A column of one type as one that `merge` made of it."""
    if have == want:
        return c
    if isinstance(want, T.VariantType):
        return F.to_variant_object(c) if isinstance(have, (T.StructType, T.ArrayType, T.MapType)) else c.cast(want)
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        inner = [as_type(c.getField(f.name), have[f.name].dataType, f.dataType) if f.name in have.names else F.lit(None).cast(f.dataType) for f in want.fields]
        return F.when(c.isNotNull(), F.struct(*[x.alias(f.name) for x, f in zip(inner, want.fields, strict=True)]))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType) and isinstance(have.elementType, T.StructType) and isinstance(want.elementType, T.StructType):
        return F.transform(c, lambda x: as_type(x, have.elementType, want.elementType))
    return c.cast(want)


def aligned(df: DataFrame, want: T.StructType) -> DataFrame:
    """`df` with the columns and types of a schema that holds its own."""
    if df.schema == want:
        return df
    have = df.schema
    return df.select(*[
        (as_type(F.col(f"`{f.name}`"), have[f.name].dataType, f.dataType) if f.name in have.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields
    ])


def readable_as(stored: T.DataType, want: T.DataType) -> bool:
    """Whether Parquet of one type can be read as another: the same but for fields that are missing."""
    if isinstance(stored, T.StructType) and isinstance(want, T.StructType):
        return all(f.name in want.names and readable_as(f.dataType, want[f.name].dataType) for f in stored.fields)
    if isinstance(stored, T.ArrayType) and isinstance(want, T.ArrayType):
        return readable_as(stored.elementType, want.elementType)
    return type(stored) is type(want) and (not isinstance(stored, T.DecimalType) or stored == want)
