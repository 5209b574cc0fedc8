"""The filter language: a tree of plain values that compiles to one Column.

Predicates have two values. A compiled node may be null only where a filter
drops the row all the same, so plain comparisons reach the Parquet scan; `not_`
makes its operand two-valued first. Nodes that rank rows (nearest neighbours,
full-text scores) have no column: `find` takes them out of the tree.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as text_functions
from ..functions import values as V
from ..functions.paths import Field, leaves, missing, resolve
from ..functions.spatial import Geometry, Stored


class FilterError(ValueError):
    """A filter that can't be evaluated."""


@dataclass(frozen=True)
class Scope:
    """What names mean: the row's schema, or an array element's."""

    schema: T.DataType
    base: Column | None = None
    separator: str = "."
    #: Fields with a full-text index; None: text filters need none.
    text_indexes: frozenset[str] | None = None
    negated: bool = False
    #: Name of the column with the paths present in a row, for `exists`.
    present: str | None = None

    def field(self, path: str) -> Field:
        if path == "$" and self.base is not None:
            return Field(self.base, self.schema)
        if not isinstance(self.schema, T.StructType):
            return missing()
        return resolve(self.schema, path, self.base, self.separator)


class Filter:
    """A node; build with `field`, `and_`, `or_`, `not_`, `all_`, `by_id`."""

    def column(self, scope: Scope) -> Column:
        raise NotImplementedError

    def and_(self, other: Filter) -> Filter:
        return And((self, other))

    def or_(self, other: Filter) -> Filter:
        return Or((self, other))

    def not_(self) -> Filter:
        return Not(self)

    __and__, __or__ = and_, or_

    def __invert__(self) -> Filter:
        return Not(self)


@dataclass(frozen=True)
class All(Filter):
    def column(self, scope: Scope) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Equal(Filter):
    path: str
    value: Any

    def column(self, scope: Scope) -> Column:
        return V.equal(scope.field(self.path), self.value)


@dataclass(frozen=True)
class NotEqual(Filter):
    """The whole value differs; null and missing do from any other value."""

    path: str
    value: Any

    def column(self, scope: Scope) -> Column:
        return ~V.whole_equal(scope.field(self.path), self.value)


@dataclass(frozen=True)
class Exists(Filter):
    """The key is present, null or not; the path of an inner document or an array element isn't one."""

    path: str

    def column(self, scope: Scope) -> Column:
        if scope.present is not None:
            found = F.array_contains(F.col(scope.present), self.path)
            return F.coalesce(found, F.lit(False))
        if isinstance(scope.schema, T.StructType):
            if self.path in scope.schema.names:
                return F.lit(True)
            if self.path in leaves(scope.schema, separator=scope.separator):
                # A key of an inner document is present where that document is.
                parent = scope.field(self.path.rpartition(scope.separator)[0])
                return parent.column.isNotNull()
        return F.lit(False)


@dataclass(frozen=True)
class Range(Filter):
    path: str
    sign: str
    value: Any

    def column(self, scope: Scope) -> Column:
        return V.ordered(scope.field(self.path), self.sign, self.value)


@dataclass(frozen=True)
class In(Filter):
    path: str
    values: tuple

    def column(self, scope: Scope) -> Column:
        f = scope.field(self.path)
        if isinstance(f.type, (T.ArrayType, T.VariantType)):
            out = F.lit(False)
            for v in self.values:
                out = out | V.equal(f, v)
            return out
        return _member(f, self.values)


@dataclass(frozen=True)
class NotIn(Filter):
    path: str
    values: tuple

    def column(self, scope: Scope) -> Column:
        f = scope.field(self.path)
        if isinstance(f.type, (T.ArrayType, T.VariantType)):
            out = F.lit(False)
            for v in self.values:
                out = out | V.whole_equal(f, v)
            return ~out
        return ~F.coalesce(_member(f, self.values), F.lit(False))


def _member(f: Field, values: tuple) -> Column:
    """One of the values, by whole value."""
    out = V.whole_equal(f, None) if None in values else None
    fit = [v for v in values if v is not None and f.known and V.same_kind(v, f.type)]
    if fit:
        inside = f.column.isin(*[v if not isinstance(v, (list, tuple)) else V.literal(v, f.type) for v in fit])
        out = inside if out is None else out | inside
    return F.lit(False) if out is None else out


#: What the pattern dialect lacks: look-around and back-references.
_NO_REGEX = re.compile(r"\(\?<?[=!]|(?<!\\)(?:\\\\)*\\[1-9]|\\k<")


@dataclass(frozen=True)
class Regex(Filter):
    """The pattern is found anywhere in a string."""

    path: str
    pattern: str

    def column(self, scope: Scope) -> Column:
        if _NO_REGEX.search(self.pattern):
            raise FilterError(f"look-around and back-references are not supported: {self.pattern}")
        f = scope.field(self.path)
        if isinstance(f.type, T.VariantType):
            text = F.when(V.variant_kind(f.column) == "STRING", F.try_variant_get(f.column, "$", "string"))
            return F.coalesce(text.rlike(self.pattern), F.lit(False))
        return f.column.rlike(self.pattern) if isinstance(f.type, T.StringType) else F.lit(False)


@dataclass(frozen=True)
class Text(Filter):
    """A token search with wildcards; below `not_` a substring test, which needs no index."""

    path: str
    query: str
    case_sensitive: bool = True

    def column(self, scope: Scope) -> Column:
        f = scope.field(self.path)
        if scope.negated:
            if not isinstance(f.type, T.StringType):
                return F.lit(False)
            return F.contains(f.column, F.lit(self.query)) if self.case_sensitive else F.contains(F.lower(f.column), F.lit(self.query.lower()))
        if scope.base is not None:
            raise FilterError("text filters have no place in an element filter")
        if scope.text_indexes is not None and self.path not in scope.text_indexes:
            raise FilterError(f"{self.path} is not indexed with a full-text index")
        if not isinstance(f.type, (T.StringType, T.ArrayType)):
            return F.lit(False)
        try:
            return text_functions.term_match(f.column, isinstance(f.type, T.ArrayType), self.query, self.case_sensitive)
        except ValueError as e:
            raise FilterError(str(e)) from e


@dataclass(frozen=True)
class ElementMatch(Filter):
    """An element of the array satisfies the whole inner filter; `$` is the element itself."""

    path: str
    inner: Filter

    def column(self, scope: Scope) -> Column:
        for node in walk(self.inner):
            if isinstance(node, (ElementMatch, Text)):
                raise FilterError("element filters can't hold element or text filters")
        f = scope.field(self.path)
        if not f.known or isinstance(f.type, T.NullType):
            return F.lit(False)
        if not isinstance(f.type, T.ArrayType):
            raise FilterError(f"{self.path} is not an array")
        element = f.type.elementType
        test = lambda x: F.coalesce(self.inner.column(replace(scope, schema=element, base=x, present=None)), F.lit(False))
        return F.coalesce(F.exists(f.column, test), F.lit(False))


@dataclass(frozen=True)
class And(Filter):
    parts: tuple[Filter, ...]

    def column(self, scope: Scope) -> Column:
        out = self.parts[0].column(scope)
        for p in self.parts[1:]:
            out = out & p.column(scope)
        return out


@dataclass(frozen=True)
class Or(Filter):
    parts: tuple[Filter, ...]

    def column(self, scope: Scope) -> Column:
        out = self.parts[0].column(scope)
        for p in self.parts[1:]:
            out = out | p.column(scope)
        return out


@dataclass(frozen=True)
class Not(Filter):
    part: Filter

    def column(self, scope: Scope) -> Column:
        inner = replace(scope, negated=True)
        if isinstance(self.part, Range):
            # The complement of a range and null, which the scan can use.
            f = scope.field(self.part.path)
            if f.known and not isinstance(f.type, (T.ArrayType, T.VariantType)) and self.part.value is not None:
                return f.column.isNull() | ~self.part.column(inner)
        return ~F.coalesce(self.part.column(inner), F.lit(False))


@dataclass(frozen=True)
class Custom(Filter):
    """A predicate of the caller: a function from a path resolver to a boolean Column, a pandas UDF's included."""

    build: Callable[[Callable[[str], Column]], Column]

    def column(self, scope: Scope) -> Column:
        return self.build(lambda path: scope.field(path).column)


@dataclass(frozen=True)
class Spatial(Filter):
    """A relation of the stored geometry to a given one; rows without geometry never match."""

    path: str
    relation: str  # intersects, within, near, geo_near
    geometry: Geometry

    def column(self, scope: Scope) -> Column:
        f = scope.field(self.path)
        stored = Stored.of(f.column, f.type) if f.known else None
        if stored is None:
            return F.lit(False)
        return F.coalesce(getattr(stored, self.relation)(self.geometry), F.lit(False))


@dataclass(frozen=True)
class Ranked(Filter):
    """A node that scores and orders rows: `find` runs it first and keeps its best rows."""

    path: str
    kind: str  # nearest, knearest, geo_knearest, matches, phrase
    query: Any
    options: dict = field(default_factory=dict, hash=False)

    def column(self, scope: Scope) -> Column:
        raise FilterError(f"{self.kind} ranks rows: it stands alone or below and_")


def walk(node: Filter):
    yield node
    for child in getattr(node, "parts", ()) or ():
        yield from walk(child)
    for name in ("part", "inner"):
        if isinstance(getattr(node, name, None), Filter):
            yield from walk(getattr(node, name))


class FieldBuilder:
    """`field(path)`: the filters on one field."""

    def __init__(self, path: str):
        self.path = path

    def eq(self, v: Any) -> Filter:
        return Equal(self.path, v)

    def ne(self, v: Any) -> Filter:
        return NotEqual(self.path, v)

    def exists(self) -> Filter:
        return Exists(self.path)

    def gt(self, v: Any) -> Filter:
        return Range(self.path, ">", v)

    def gte(self, v: Any) -> Filter:
        return Range(self.path, ">=", v)

    def lt(self, v: Any) -> Filter:
        return Range(self.path, "<", v)

    def lte(self, v: Any) -> Filter:
        return Range(self.path, "<=", v)

    def between_optional_inclusive(self, lo: Any, hi: Any) -> Filter:
        return self.between(lo, hi, True, True)

    def between_inclusive(self, lo: Any, hi: Any, inclusive: bool) -> Filter:
        return self.between(lo, hi, inclusive, inclusive)

    def between(self, lo: Any, hi: Any, lo_inclusive: bool, hi_inclusive: bool) -> Filter:
        return And((Range(self.path, ">=" if lo_inclusive else ">", lo), Range(self.path, "<=" if hi_inclusive else "<", hi)))

    def in_array(self, values: list) -> Filter:
        return In(self.path, tuple(values))

    def not_in_array(self, values: list) -> Filter:
        return NotIn(self.path, tuple(values))

    def text(self, query: str) -> Filter:
        return Text(self.path, query)

    def text_case_insensitive(self, query: str) -> Filter:
        return Text(self.path, query, False)

    def text_regex(self, pattern: str) -> Filter:
        return Regex(self.path, pattern)

    def elem_match(self, inner: Filter) -> Filter:
        return ElementMatch(self.path, inner)

    # Places.
    def intersects(self, g: Geometry) -> Filter:
        return Spatial(self.path, "intersects", g)

    def within(self, g: Geometry) -> Filter:
        return Spatial(self.path, "within", g)

    def near(self, x: float, y: float, distance: float) -> Filter:
        return Spatial(self.path, "near", Geometry.circle(x, y, distance))

    def geo_near(self, lat: float, lon: float, meters: float) -> Filter:
        return Spatial(self.path, "geo_near", Geometry.geo(lat, lon, meters))

    def knearest(self, x: float, y: float, k: int, max_distance: float | None = None) -> Filter:
        return self._k(k, Ranked(self.path, "knearest", (x, y), {"k": k, "max": max_distance}))

    def geo_knearest(self, lat: float, lon: float, k: int, max_meters: float | None = None) -> Filter:
        """By distance in degrees, as the limit is too: 111 km to one."""
        return self._k(k, Ranked(self.path, "knearest", (lon, lat), {"k": k, "max": None if max_meters is None else max_meters / 111_000.0}))

    # Ranked text and vectors.
    def matches(self, query: str, limit: int | None = None) -> Filter:
        """All rows that match, or the `limit` best."""
        return Ranked(self.path, "matches", query, {"k": limit})

    contains = matches

    def phrase(self, phrase: str, limit: int | None = None) -> Filter:
        return Ranked(self.path, "phrase", phrase, {"k": limit})

    def nearest(self, query: list[float], k: int, metric: str = "cosine", min_score: float | None = None) -> Filter:
        return self._k(k, Ranked(self.path, "nearest", tuple(query), {"k": k, "metric": metric, "min_score": min_score}))

    @staticmethod
    def _k(k: int, node: Filter) -> Filter:
        if k < 1:
            raise FilterError("k must be 1 or more")
        return node


def field_(path: str) -> FieldBuilder:
    return FieldBuilder(path)


def all_() -> Filter:
    return All()


def by_id(id_: int) -> Filter:
    return Equal("_id", id_)


def and_(*parts: Filter) -> Filter:
    if not parts:
        raise FilterError("and needs a filter")
    return And(tuple(parts))


def or_(*parts: Filter) -> Filter:
    if not parts:
        raise FilterError("or needs a filter")
    return Or(tuple(parts))


def not_(part: Filter) -> Filter:
    return Not(part)


def where(build: Callable[[Callable[[str], Column]], Column]) -> Filter:
    return Custom(build)
