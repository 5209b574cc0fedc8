"""Mutations as new frames: what a table holds after a write."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import resolve
from ..plans.filters import All, Filter, Scope
from ..sources import schema


class ConstraintError(ValueError):
    """A write that a unique index or an id forbids."""


def now_ms() -> int:
    return time.time_ns() // 1_000_000


def matching(df: DataFrame, node: Filter, present: str | None = None) -> Column:
    """The two-valued predicate of a filter."""
    return F.coalesce(node.column(Scope(df.schema, present=present)), F.lit(False))


def _literal(value: Any, kind: T.DataType | None) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(kind, T.VariantType):
        return schema.literal(value)
    if isinstance(value, (list, tuple)):
        out = F.array(*[_literal(v, kind.elementType if isinstance(kind, T.ArrayType) else None) for v in value])
    elif isinstance(value, dict):
        out = F.struct(*[_literal(v, kind[k].dataType if isinstance(kind, T.StructType) and k in kind.names else None).alias(k) for k, v in value.items()])
    else:
        out = F.lit(value)
    return out.cast(kind) if kind is not None and not isinstance(kind, T.StructType) else out


def _merge(column: Column, kind: T.StructType, changes: dict[str, Any]) -> Column:
    """A struct with nested changes; other fields keep their values."""
    out = []
    for f in kind.fields:
        old = column.getField(f.name)
        if f.name not in changes:
            out.append(old.alias(f.name))
        elif isinstance(changes[f.name], dict) and isinstance(f.dataType, T.StructType):
            out.append(_merge(old, f.dataType, changes[f.name]).alias(f.name))
        else:
            out.append(_literal(changes[f.name], f.dataType).alias(f.name))
    out += [_literal(v, None).alias(k) for k, v in changes.items() if k not in kind.names]
    return F.struct(*out)


def merged(df: DataFrame, node: Filter, changes: dict[str, Any], just_once: bool = False, key: str = "_id", present: str | None = None) -> DataFrame:
    """Matching rows deeply merged with `changes`: documents field by field, arrays whole.

    The id is never changed; the revision grows by one and the time of change is
    set where the table has them. `just_once` changes the first match by key.
    """
    changes = {k: v for k, v in changes.items() if k not in ("_id", "_revision", "_modified", "_source")}
    if not changes:
        return df
    hit = matching(df, node, present)
    if just_once:
        first = df.filter(hit).agg(F.min(key).alias("_first"))
        df = df.crossJoin(F.broadcast(first))  # one row
        hit = F.col(key).eqNullSafe(F.col("_first")) & F.col("_first").isNotNull()
    out = df.withColumn("_hit", hit)
    new: dict[str, Column] = {}
    for name, value in changes.items():
        if name in df.columns:
            kind = df.schema[name].dataType
            if isinstance(value, dict) and isinstance(kind, T.StructType):
                full = T.StructType([*kind.fields, *[f for f in _new_fields(kind, value)]])
                change = _merge(F.col(f"`{name}`"), kind, value)
                old = _merge(F.col(f"`{name}`"), kind, {f.name: None for f in full.fields if f.name not in kind.names})
                new[name] = F.when(F.col("_hit"), change).otherwise(F.when(F.col(f"`{name}`").isNull(), F.lit(None)).otherwise(old))
            else:
                new[name] = F.when(F.col("_hit"), _literal(value, kind)).otherwise(F.col(f"`{name}`"))
        else:
            new[name] = F.when(F.col("_hit"), _literal(value, None))
    if "_revision" in df.columns:
        new["_revision"] = F.col("_revision") + F.col("_hit").cast("int")
    if "_modified" in df.columns:
        new["_modified"] = F.when(F.col("_hit"), F.lit(now_ms())).otherwise(F.col("_modified"))
    if present and present in df.columns:
        added = F.array(*[F.lit(p) for p in leaf_paths(changes)])
        new[present] = F.when(F.col("_hit"), F.array_union(present, added)).otherwise(F.col(present))
    return out.withColumns(new).drop("_hit", "_first")


def _new_fields(kind: T.StructType, value: dict[str, Any]) -> list[T.StructField]:
    return [T.StructField(k, T.NullType()) for k in value if k not in kind.names]


def leaf_paths(document: dict[str, Any], prefix: str = "", separator: str = ".") -> list[str]:
    """The keys of a document that are present: top-level ones and leaves."""
    out = []
    for k, v in document.items():
        path = f"{prefix}{k}"
        if isinstance(v, dict):
            out += ([path] if not prefix else []) + leaf_paths(v, f"{path}{separator}", separator)
        else:
            out.append(path)
    return out


def upserted(df: DataFrame, rows: DataFrame, key: str = "_id") -> DataFrame:
    """`rows` in place of those of equal key, or beside them."""
    kept = df.join(rows.select(F.col(key).alias("_new")), F.col(key).eqNullSafe(F.col("_new")), "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


def removed(df: DataFrame, node: Filter, just_once: bool = False, key: str = "_id") -> DataFrame:
    """The rows that don't match; with `just_once` all but the first match by key."""
    if just_once and isinstance(node, All):
        raise ConstraintError("removing one of all rows is not defined")
    hit = matching(df, node)
    if not just_once:
        return df.filter(~hit)
    first = df.filter(hit).agg(F.min(key).alias("_first"))
    return df.crossJoin(F.broadcast(first)).filter(~(F.col(key).eqNullSafe(F.col("_first")) & F.col("_first").isNotNull())).drop("_first")


def index_keys(df: DataFrame, fields: list[str]) -> DataFrame:
    """(k, _id): an entry for each row, for an array in the first field one for each element; null is a value."""
    found = [resolve(df.schema, f) for f in fields]
    for f in found[1:]:
        if isinstance(f.type, T.ArrayType):
            raise ConstraintError("only the first field of a compound index may be an array")
    # A variant has no equality of its own: its kind and text stand for it.
    keyed = lambda f: F.when(f.column.isNotNull(), F.concat_ws(":", F.schema_of_variant(f.column), F.to_json(f.column))) if isinstance(f.type, T.VariantType) else f.column
    head = keyed(found[0])
    rest = [keyed(f).alias(n) for f, n in zip(found[1:], fields[1:], strict=True)]
    if isinstance(found[0].type, T.ArrayType):
        head = F.explode_outer(head)
    named = df.select(head.alias("_head"), F.struct(F.lit(0).alias("_"), *rest).alias("_rest"), *([F.col("_id")] if "_id" in df.columns else [F.lit(None).alias("_id")]))
    return named.select(F.struct(F.col("_head").alias(fields[0]), *[F.col("_rest")[n].alias(n) for n in fields[1:]]).alias("k"), "_id")


def violations(df: DataFrame, fields: list[str]) -> DataFrame:
    """(k, n): index entries that occur more than once, also within one row."""
    return index_keys(df, fields).groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
