"""`find`: a filter and options over a DataFrame, as one lazy plan.

Order of stages: ranked nodes (their top rows), then the rest of the filter,
sort, skip, limit. A row's identity is its key, `_id` unless named, which breaks
every tie, so results have one order whatever the partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..functions.paths import resolve
from . import ranked, textquery
from .filters import All, And, Filter, FilterError, Ranked, Scope, Text, walk

#: Rows of a ranked node that are joined by broadcast.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class FindOptions:
    """Sort keys (field, ascending), rows to skip and to return, and the collation of strings."""

    sort: tuple[tuple[str, bool], ...] = ()
    skip_rows: int | None = None
    limit_rows: int | None = None
    #: A collation as Spark names it: UNICODE is the root locale; fr, de_CI and so on.
    collation: str = "UNICODE"

    def sort_by(self, path: str, order: str = "asc") -> FindOptions:
        if order not in ("asc", "desc"):
            raise ValueError("order: asc or desc")
        return replace(self, sort=(*self.sort, (path, order == "asc")))

    def skip(self, n: int) -> FindOptions:
        return replace(self, skip_rows=_count(n))

    def limit(self, n: int) -> FindOptions:
        return replace(self, limit_rows=_count(n))


def _count(n: int) -> int:
    if n < 0:
        raise ValueError("a number of rows is 0 or more")
    return n


def order_by(path: str, order: str = "asc") -> FindOptions:
    return FindOptions().sort_by(path, order)


def skip_by(n: int) -> FindOptions:
    return FindOptions().skip(n)


def limit_to(n: int) -> FindOptions:
    return FindOptions().limit(n)


@dataclass(frozen=True)
class Context:
    """What `find` knows of a table beside its rows."""

    key: str | None = "_id"
    separator: str = "."
    text_indexes: frozenset[str] | None = None
    present: str | None = None
    vector_metrics: dict[str, str] = field(default_factory=dict)
    #: Text indexes and vector indexes by path, whose tables queries read in place of the rows; keys are the table's.
    text_tables: dict[str, Any] = field(default_factory=dict)
    vector_tables: dict[str, Any] = field(default_factory=dict)


def _split(node: Filter) -> tuple[list[Ranked], list[Filter]]:
    """Ranked nodes that stand alone or below `and`, and the rest."""
    if isinstance(node, Ranked):
        return [node], []
    if isinstance(node, And):
        tops, rest = [], []
        for p in node.parts:
            t, r = _split(p)
            tops += t
            rest += r
        return tops, rest
    if any(isinstance(x, Ranked) for x in walk(node)):
        raise FilterError("a filter that ranks rows stands alone or below and")
    return [], [node]


def _by_index(df: DataFrame, node: Ranked, context: Context, key: str) -> DataFrame | None:
    """The rows that a ranked node finds, by its index; None if there is none that can tell."""
    scores = None
    if node.kind in ("matches", "phrase") and node.path in context.text_tables:
        parsed = textquery.phrase(node.query) if node.kind == "phrase" else textquery.parse(node.query)
        scores = context.text_tables[node.path].matches(parsed, node.options["k"])
    elif node.kind == "nearest" and node.path in context.vector_tables:
        scores = context.vector_tables[node.path].nearest(node.query, node.options["k"], node.options["min_score"])
    if scores is None:
        return None
    found = scores.withColumnRenamed("key", "_found")
    # The k best are few; all matches may not be, and Spark chooses the join.
    found = F.broadcast(found) if node.options["k"] and node.options["k"] <= BROADCAST_ROWS else found
    return df.join(found, F.col(key) == F.col("_found")).drop("_found")


def sort_columns(df: DataFrame, options: FindOptions, key: str | None, separator: str = ".") -> list[Column]:
    """Nulls come first ascending and last descending; ties by key ascending."""
    out = []
    for path, ascending in options.sort:
        f = resolve(df.schema, path, separator=separator)
        if not f.known:
            continue
        if isinstance(f.type, T.VariantType):
            # Numbers by size, an integer before an equal float; then all else by its text.
            kind, number = V.variant_kind(f.column), F.try_variant_get(f.column, "$", "double")
            plain = V.is_number(kind)
            c = F.when(f.column.isNotNull() & (kind != "VOID"), F.struct((~plain).alias("a"), F.when(plain, number).alias("b"), (plain & (kind != "BIGINT")).alias("c"), F.when(~plain, F.to_json(f.column)).alias("d")))
        else:
            c = F.collate(f.column, options.collation) if isinstance(f.type, T.StringType) else f.column
        out.append(c.asc_nulls_first() if ascending else c.desc_nulls_last())
    return [*out, F.col(key).asc()] if key and key in df.columns else out


def find(df: DataFrame, filter_: Filter | None = None, options: FindOptions | None = None, context: Context | None = None, ordered: bool = False) -> DataFrame:
    """The rows that match. They are sorted if a sort, skip, limit or `ordered` asks for it."""
    options, context = options or FindOptions(), context or Context()
    tops, rest = _split(filter_ or All())
    out, key = df, context.key if context.key in df.columns else None
    for n, node in enumerate(tops):
        o = dict(node.options)
        # An index knows all rows of the table, so only the first ranked node can use it.
        if n == 0 and key and (indexed := _by_index(out, node, context, key)) is not None:
            out = indexed
        elif node.kind == "nearest":
            o["metric"] = context.vector_metrics.get(node.path, o["metric"])
            out = ranked.nearest(out, node.path, node.query, o["k"], o["metric"], o["min_score"], key)
        elif node.kind == "knearest":
            out = ranked.knearest(out, node.path, node.query, o["k"], o["max"], key)
        elif n < len(tops) - 1 and o["k"] is None:
            # The last ranked node scores; those before it only choose rows.
            out = ranked.holding(out, node.path, node.query, node.kind == "phrase")
        else:
            out = ranked.matches(out, node.path, node.query, o["k"], key, node.kind == "phrase")
        if n < len(tops) - 1:
            out = out.drop("_score", "_distance")
    scope = Scope(df.schema, separator=context.separator, text_indexes=context.text_indexes, present=context.present)
    rest = [r for r in rest if not isinstance(r, All)]
    for r in [r for r in rest if key and isinstance(r, Text) and r.path in context.text_tables]:
        rest.remove(r)
        try:
            found = context.text_tables[r.path].term(r.query, r.case_sensitive)
        except ValueError as e:
            raise FilterError(str(e)) from e
        out = out.join(found.withColumnRenamed("key", "_found"), F.col(key) == F.col("_found"), "left_semi")
    if rest:
        out = out.filter(And(tuple(rest)).column(scope))
    if options.sort:
        out = out.orderBy(*sort_columns(out, options, key, context.separator))
    elif tops:
        # The rank is the order; a filter keeps it but a reader needn't.
        best = F.col("_score").desc() if "_score" in out.columns else F.col("_distance").asc()
        out = out.orderBy(best, *([F.col(key)] if key else []))
    elif key and (ordered or options.skip_rows is not None or options.limit_rows is not None):
        out = out.orderBy(F.col(key).asc())
    if options.skip_rows:
        out = out.offset(options.skip_rows)
    return out if options.limit_rows is None else out.limit(options.limit_rows)
