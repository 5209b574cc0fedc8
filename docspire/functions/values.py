"""Typed comparison of a column with a literal.

Integers of any width compare by value and so do floats, but an integer never
equals a float: in order, the integer of a tie comes first. NaN equals NaN and is
greatest. Values of other kinds never match each other. Null is a value for
equality and matches no range.
"""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import Field


def variant_kind(x: Column) -> Column:
    """BIGINT, DOUBLE, STRING and so on: the kind of a value in a VARIANT column; integers of all widths are BIGINT."""
    return F.schema_of_variant(x)


def is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


_VARIANT_OF = {"bool": ("BOOLEAN", "boolean"), "string": ("STRING", "string"), "binary": ("BINARY", "binary"), "time": ("TIMESTAMP", "timestamp"), "date": ("DATE", "date")}


def _variant_equal(x: Column, value: Any) -> Column:
    kind, lit = variant_kind(x), literal_kind(value)
    if lit == "int":
        out = (kind == "BIGINT") & (F.try_variant_get(x, "$", "decimal(38,0)") == F.lit(Decimal(value)))
    elif lit == "float":
        out = (kind != "BIGINT") & is_number(kind) & F.try_variant_get(x, "$", "double").eqNullSafe(F.lit(float(value)))
    elif lit == "array":
        out = kind.startswith("ARRAY") & (F.to_json(x) == F.to_json(F.parse_json(F.lit(json.dumps(list(value), default=str)))))
    else:
        name, type_ = _VARIANT_OF[lit]
        out = (kind == name) & (F.try_variant_get(x, "$", type_) == literal(value, T.NullType()))
    return F.coalesce(out, no())


def _variant_ordered(x: Column, sign: str, value: Any) -> Column:
    """Numbers by size, values of the literal's kind by value, others by their JSON texts."""
    kind, lit = variant_kind(x), literal_kind(value)
    test = lambda a, b, s: {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[s]
    shown = test(F.to_json(x), F.lit(json.dumps(value, default=str)), sign)
    if lit in ("int", "float"):
        whole, broken = (sign, _SWAP.get((sign, "float"), sign)) if lit == "int" else (_SWAP.get((sign, "int"), sign), sign)
        exact = test(F.try_variant_get(x, "$", "decimal(38,0)"), F.lit(Decimal(value)), sign) if lit == "int" else test(F.try_variant_get(x, "$", "double"), F.lit(float(value)), whole)
        same = F.when(kind == "BIGINT", exact).when(is_number(kind), test(F.try_variant_get(x, "$", "double"), F.lit(float(value)), broken))
        out = F.when(is_number(kind), same).otherwise(shown)
    elif lit in _VARIANT_OF:
        name, type_ = _VARIANT_OF[lit]
        out = F.when(kind == name, test(F.try_variant_get(x, "$", type_), literal(value, T.NullType()), sign)).otherwise(shown)
    else:
        out = shown
    return F.when(x.isNotNull() & (kind != "VOID"), out)


def no() -> Column:
    return F.lit(False)


def literal_kind(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, Decimal):
        return "int" if value == value.to_integral_value() and value.as_tuple().exponent >= 0 else "float"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (bytes, bytearray)):
        return "binary"
    if isinstance(value, dt.datetime):
        return "time"
    if isinstance(value, dt.date):
        return "date"
    if isinstance(value, (list, tuple)):
        return "array"
    raise TypeError(f"no literal of type {type(value).__name__}")


def type_kind(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or isinstance(kind, T.DecimalType) and kind.scale == 0:
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    for cls, name in ((T.BooleanType, "bool"), (T.StringType, "string"), (T.BinaryType, "binary"), (T.TimestampType, "time"), (T.TimestampNTZType, "time"), (T.DateType, "date"), (T.ArrayType, "array")):
        if isinstance(kind, cls):
            return name
    return "other"


def literal(value: Any, kind: T.DataType) -> Column:
    if isinstance(value, (list, tuple)):
        element = kind.elementType if isinstance(kind, T.ArrayType) else T.StringType()
        return F.array(*[literal(v, element) for v in value]).cast(T.ArrayType(element))
    return F.lit(bytes(value) if isinstance(value, bytearray) else value)


def same_kind(value: Any, kind: T.DataType) -> bool:
    """Whether a value of this type can equal the literal."""
    lit = literal_kind(value)
    if lit == "array":
        return isinstance(kind, T.ArrayType) and all(v is None or same_kind(v, kind.elementType) for v in value)
    return lit == type_kind(kind)


def whole_equal(field: Field, value: Any) -> Column:
    """The whole value equals the literal; never null."""
    if value is None:
        if isinstance(field.type, T.VariantType):
            return field.column.isNull() | F.coalesce(F.is_variant_null(field.column), no())
        return field.column.isNull() if field.known else F.lit(True)
    if isinstance(field.type, T.VariantType):
        return _variant_equal(field.column, value)
    if not field.known or not same_kind(value, field.type):
        return no()
    return field.column.eqNullSafe(literal(value, field.type))


def equal(field: Field, value: Any) -> Column:
    """`whole_equal`, or the field is an array with an element that equals the literal."""
    out = whole_equal(field, value)
    if isinstance(field.type, T.ArrayType) and value is not None:
        element = field.type.elementType
        if same_kind(value, element):
            holds = F.exists(field.column, lambda x: x.eqNullSafe(literal(value, element)))
            out = out | F.coalesce(holds, no())
    if isinstance(field.type, T.VariantType) and value is not None and literal_kind(value) != "array":
        inside = F.exists(F.try_variant_get(field.column, "$", "array<variant>"), lambda x: _variant_equal(x, value))
        out = out | F.coalesce(variant_kind(field.column).startswith("ARRAY") & inside, no())
    return out


_SWAP = {(">=", "int"): ">", ("<", "int"): "<=", (">", "float"): ">=", ("<=", "float"): "<"}


def ordered(field: Field, sign: str, value: Any) -> Column:
    """`field sign value` for one of < <= > >=; null where the field is null."""
    if value is None or not field.known:
        return no()
    if isinstance(field.type, T.VariantType):
        return _variant_ordered(field.column, sign, value)
    kind, lit = type_kind(field.type), literal_kind(value)
    if lit == "array":
        if not same_kind(value, field.type):
            return no()
    elif {kind, lit} == {"int", "float"}:
        # At a tie the integer is less.
        sign = _SWAP.get((sign, kind), sign)
    elif kind != lit:
        return no()
    x, v = field.column, literal(value, field.type)
    return {"<": x < v, "<=": x <= v, ">": x > v, ">=": x >= v}[sign]
