"""Shared pieces: whole-text helpers, keys of rows and size checks; the shared folder is the engine's."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import shared
from ..sources.shared import scratch

#: Word separators of every contract: space and the controls 09-0D.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
__all__ = ["blocks_of", "buckets_for", "cut", "fit_broadcast", "fresh_name", "ids_repeat", "input_bytes", "keyed", "let", "run_hashes", "running", "scratch", "text_batches", "with_keys", "words"]


#: Rows in a batch of the Parquet reader and of Arrow at most: batches are counted in rows, and texts may be long.
TEXT_BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": 512, "spark.sql.execution.arrow.maxRecordsPerBatch": 1000}


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, jobs of the session read texts in small batches, so that a few long ones fit an executor's memory."""
    before = {k: spark.conf.get(k) for k in TEXT_BATCHES}
    for k, most in TEXT_BATCHES.items():
        if not 0 < int(before[k]) <= most:
            spark.conf.set(k, str(most))
    try:
        yield
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder, by small batches, and read it back, which ends its lineage."""
    with text_batches(df.sparkSession):
        return shared.cut(df)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once a row, whatever the optimizer inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements that `running` adds one by one; blocks of them are summed first.
_RUN = 64


def blocks_of(xs: Column) -> Column:
    """An array cut into arrays of `_RUN`."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _RUN).cast("int")), lambda b: F.slice(xs, b * _RUN + 1, _RUN))


def running(xs: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each member of a non-empty array of int the members up to it, added; by blocks, so long arrays cost little more than short ones."""
    zero = F.lit(0)
    none = F.array().cast("array<int>")

    def by_block(blocks: Column) -> Column:
        step = lambda a, b: F.struct(add(a["at"], F.aggregate(b, zero, add)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        heads = F.aggregate(blocks, F.struct(zero.alias("at"), none.alias("out")), step, lambda a: a["out"])
        inner = lambda b, head: F.transform(b, lambda x, i: F.aggregate(F.slice(b, 1, i + 1), head, add))
        return let(heads, lambda hs: F.flatten(F.zip_with(blocks, hs, inner)))

    return let(blocks_of(xs), by_block)


def with_keys(df: DataFrame) -> tuple[DataFrame, str]:
    """`df` and the name of a key of its rows, an integer: the id if each row has one of its own, else a new column."""
    return (df, "doc_id") if isinstance(df.schema["doc_id"].dataType, T.IntegralType) and not ids_repeat(df) else keyed(df)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def run_hashes(ws: Column, length: int) -> Column:
    """The hash of every `length` neighbours of a list of words, in order, from the words' own hashes; none if there are fewer."""

    def made(hs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hs) - length), lambda i: F.xxhash64(*[F.get(hs, i + j) for j in range(length)]))

    none = F.array().cast("array<bigint>")
    return F.when(F.size(ws) < length, none).otherwise(let(F.transform(ws, lambda w: F.xxhash64(w)), made))


def input_bytes(df: DataFrame) -> int:
    """The planner's estimate of the size of `df`; reads no data."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, per_bucket: int = 8 << 20) -> int:
    """How many hash buckets keep each one's share of `df` near `per_bucket` bytes."""
    return max(48, -(-input_bytes(df) // per_bucket))


def ids_repeat(df: DataFrame) -> bool:
    """Whether rows share an id or lack one; shuffles ids alone."""
    return not df.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty()


def fresh_name(df: DataFrame, name: str) -> str:
    """`name`, made longer until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(df: DataFrame, name: str = "_row") -> tuple[DataFrame, str]:
    """`df` with a key of each row, and the key's name; written once, so a repeated task finds the same keys."""
    key = fresh_name(df, name)
    return cut(df.withColumn(key, F.monotonically_increasing_id())), key


def fit_broadcast(df: DataFrame, max_rows: int, members: Column | None = None, max_members: int = 4_000_000) -> DataFrame:
    """`df` with a broadcast hint if it has at most `max_rows` rows, and at most `max_members` members in arrays whose sizes `members` tells; else as it is."""
    small = df.limit(max_rows + 1).count() <= max_rows
    if small and members is not None:
        small = (df.agg(F.sum(members)).first()[0] or 0) <= max_members
    return F.broadcast(df) if small else df
