"""Stages that score rows and keep the best: vectors, places and full text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as text_functions
from ..functions import vector
from ..functions.paths import resolve
from ..functions.spatial import Stored
from . import textquery

K1, B = 1.2, 0.75


def _key(df: DataFrame, key: str | None) -> list[Column]:
    return [F.col(key).asc()] if key else []


def nearest(df: DataFrame, path: str, query: tuple[float, ...], k: int, metric: str = "cosine", min_score: float | None = None, key: str | None = "_id") -> DataFrame:
    """The k rows nearest to a vector, with `_score`; exact, so at least as good as any index."""
    f = resolve(df.schema, path)
    if not f.known:
        return df.withColumn("_score", F.lit(None).cast("double")).limit(0)
    dist = vector.distance(f.column, list(query), metric)
    scored = df.withColumn("_distance", dist).filter(F.col("_distance").isNotNull())
    scored = scored.withColumn("_score", vector.score(F.col("_distance"), metric))
    if min_score is not None:
        scored = scored.filter(F.col("_score") >= min_score)
    return scored.orderBy(F.col("_distance").asc(), *_key(df, key)).limit(k).drop("_distance")


def knearest(df: DataFrame, path: str, at: tuple[float, float], k: int, max_distance: float | None = None, key: str | None = "_id") -> DataFrame:
    """The k rows whose boxes are nearest to a point, with `_distance`."""
    f = resolve(df.schema, path)
    stored = Stored.of(f.column, f.type) if f.known else None
    if stored is None:
        return df.withColumn("_distance", F.lit(None).cast("double")).limit(0)
    out = df.withColumn("_distance", stored.box_distance(*at)).filter(F.col("_distance").isNotNull())
    if max_distance is not None:
        out = out.filter(F.col("_distance") <= max_distance)
    return out.orderBy(F.col("_distance").asc(), *_key(df, key)).limit(k)


def flat_text(column: Column, kind: T.DataType) -> Column:
    """All strings in a value: of documents and arrays those inside, joined; of others none."""
    if isinstance(kind, T.StringType):
        return column
    if isinstance(kind, T.StructType):
        return F.concat_ws(" ", *[flat_text(column.getField(f.name), f.dataType) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return F.concat_ws(" ", F.transform(column, lambda x: flat_text(x, kind.elementType)))
    return F.lit("")


def bm25(counts: list[Column], held: list[Column], rows: Column, size: Column, mean: Column) -> Column:
    """The score of a row of `size` tokens with so many of each term, of which so many rows hold one."""
    total = F.lit(0.0)
    for tf, df in zip(counts, held, strict=True):
        total = total + F.log(1.0 + (rows - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
    return total


def matches(df: DataFrame, path: str, query: str, k: int | None = None, key: str | None = "_id", phrase: bool = False) -> DataFrame:
    """The rows that match, or the k best of them, by BM25, with `_score`.

    Statistics are of all rows with a text: their number, mean length, and the
    rows that hold each query term, in one aggregate. Words are looked for in the
    texts as they are, which are parted only for their lengths: those of all rows
    once, and again those of the rows that match.
    """
    f = resolve(df.schema, path)
    parsed = textquery.phrase(query) if phrase else textquery.parse(query)
    terms = sorted(parsed.scored())
    if not f.known or not terms:
        return df.withColumn("_score", F.lit(None).cast("double")).limit(0)
    low = F.lower(flat_text(f.column, f.type))
    patterns = [F.lit(text_functions.run_pattern((term,))) for term in terms]
    # A row keeps what is said of its text, so that is made once.
    told = lambda of: F.get(F.transform(F.array(low), lambda s: F.struct(F.size(text_functions.tokens(s)).alias("n"), F.array(*[of(s, p) for p in patterns]).alias("of"))), F.lit(0))
    # No filter on what is told, which would be pushed below and made twice.
    n = F.when(F.col("_c.n") > 0, F.col("_c.n"))
    stats = df.select(told(F.rlike).alias("_c")).agg(
        F.count(n).alias("rows"), F.avg(n).alias("mean"),
        F.array(*[F.count(F.when(F.get(F.col("_c.of"), F.lit(i)), 1)) for i in range(len(terms))]).alias("df"),
    )
    found = holding(df, path, query, phrase).withColumn("_c", told(F.regexp_count))
    joined = found.crossJoin(F.broadcast(stats))  # one row of statistics
    tf = [F.get(F.col("_c.of"), F.lit(i)).cast("double") for i in range(len(terms))]
    total = bm25(tf, [F.get(F.col("df"), F.lit(i)) for i in range(len(terms))], F.col("rows"), F.col("_c.n"), F.col("mean"))
    ranked = joined.withColumn("_score", total).orderBy(F.col("_score").desc(), *_key(df, key))
    return (ranked if k is None else ranked.limit(k)).drop("_c", "rows", "mean", "df")


def holding(df: DataFrame, path: str, query: str, phrase: bool = False) -> DataFrame:
    """All rows that `matches` finds, without their scores."""
    f = resolve(df.schema, path)
    parsed = textquery.phrase(query) if phrase else textquery.parse(query)
    if not f.known or not parsed.scored():
        return df.limit(0)
    low = F.lower(flat_text(f.column, f.type))
    found = df.filter(parsed.in_text(low))
    return found.filter(F.size(text_functions.tokens(low)) > 0) if parsed.without_words() else found
