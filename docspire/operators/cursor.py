"""What a cursor does with found rows: project, join, count, first."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields, is_dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import resolve
from ..functions.values import type_kind


def project(df: DataFrame, template: dict[str, Any] | list[str] | type, separator: str = ".") -> DataFrame:
    """Exactly the template's leaf fields, nested as there; what a row lacks is null.

    A template is a nested dict whose leaves' values don't matter, a list of
    paths, or a dataclass. Reserved fields are left out.
    """
    if is_dataclass(template):
        template = {f.name: None for f in fields(template)}
    if isinstance(template, list):
        nested: dict[str, Any] = {}
        for path in template:
            at = nested
            *outer, last = path.split(separator)
            for step in outer:
                at = at.setdefault(step, {})
            at[last] = None
        template = nested

    def build(part: dict[str, Any], prefix: str) -> list[Column]:
        out = []
        for name, value in part.items():
            if not prefix and name.startswith("_") and name in ("_id", "_revision", "_source", "_modified"):
                continue
            path = f"{prefix}{name}"
            column = F.struct(*build(value, f"{path}{separator}")) if isinstance(value, dict) and value else resolve(df.schema, path, separator=separator).column
            out.append(column.alias(name))
        return out

    return df.select(*build(template, ""))


def lookup_join(left: DataFrame, right: DataFrame, local: str, foreign: str, target: str, order: str | None = "_id") -> DataFrame:
    """Each left row with the array `target` of all right rows of equal key, in the order of `order`.

    Null equals null and missing. Keys of different kinds never meet. A row
    without partners keeps what `target` held before, or null. The right side is
    grouped by key first, so a left row joins one row; for keys of more rows than
    one array should hold, `lookup_rows` gives a row for each pair.
    """
    lf, rf = resolve(left.schema, local), resolve(right.schema, foreign)
    item = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    ordered = F.struct((F.col(order) if order and order in right.columns else F.lit(0)).alias("_o"), item.alias("_v"))
    key_type = rf.type if rf.known else T.NullType()
    kinds_meet = not (lf.known and rf.known) or type_kind(lf.type) == type_kind(key_type)
    grouped = right.groupBy(rf.column.alias("_key")).agg(F.transform(F.array_sort(F.collect_list(ordered)), lambda x: x["_v"]).alias("_found"))
    grouped = grouped.withColumn("_hit", F.lit(True))
    if kinds_meet:
        on = lf.column.eqNullSafe(F.col("_key"))
    else:
        on = lf.column.isNull() & F.col("_key").isNull()
        grouped = grouped.filter(F.col("_key").isNull())
    joined = left.join(grouped, on, "left")
    kind = joined.schema["_found"].dataType
    old = F.col(f"`{target}`").cast(kind) if target in left.columns and left.schema[target].dataType == kind else F.lit(None).cast(kind)
    return joined.select(*[F.col(f"`{c}`") for c in left.columns if c != target], F.when(F.col("_hit"), F.col("_found")).otherwise(old).alias(target))


def lookup_rows(left: DataFrame, right: DataFrame, local: str, foreign: str, target: str) -> DataFrame:
    """The same pairs, a row for each, with one right row in `target`; a left row without partners has null there. No key gathers in one task: Spark splits hot ones."""
    lf, rf = resolve(left.schema, local), resolve(right.schema, foreign)
    other = right.select(rf.column.alias("_key"), F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("_found"), F.lit(True).alias("_hit"))
    meet = not (lf.known and rf.known) or type_kind(lf.type) == type_kind(rf.type)
    on = lf.column.eqNullSafe(F.col("_key")) if meet else lf.column.isNull() & F.col("_key").isNull()
    return left.join(other, on, "left").select(*[F.col(f"`{c}`") for c in left.columns if c != target], F.col("_found").alias(target))


def iter_with_id(df: DataFrame, key: str = "_id") -> Iterator[tuple[Any, Row]]:
    """(id, row) one after another; of rows without a key, their numbers."""
    for i, row in enumerate(df.toLocalIterator()):
        yield (row[key] if key in df.columns else i), row


def count(df: DataFrame) -> int:
    return df.count()


size = count


def first(df: DataFrame, key: str | None = "_id") -> Row | None:
    """The first row in order of the key."""
    if key and key in df.columns:
        df = df.orderBy(F.col(key).asc())
    return df.first()


def union_distinct(parts: list[DataFrame], key: str = "_id") -> DataFrame:
    """Rows of all parts, one for each key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.dropDuplicates([key])
