"""Inverted text indexes: tables of postings that text queries read in place of the texts.

A posting is a term in its own case, its lower case, the key of a row, the places
of the term among the row's tokens and the number of these. Each task writes the
postings of its own rows, as runs sorted by term of `RUN_TOKENS` tokens at most, so
nothing is shuffled or spilled, no word is too frequent for a task, and a query
reads the pages that may hold its words, which Parquet's statistics tell. A posting
without a term stands for each row with a token. Beside the postings lie the
dictionary of terms, which searches with wildcards read first, and one row with the
number of rows and tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.paths import resolve
from ..plans import ranked, textquery

#: Tokens that a task sorts at a time, about 60 bytes each; a longer row is a run of its own.
RUN_TOKENS = 2_000_000
#: Terms that a search with wildcards looks up; with more it reads the terms of all postings.
LISTED_TERMS = 1_000
#: Postings in a batch that a task hands on.
RUN_ROWS = 20_000
POSTING = "term string, key bigint, n int, at array<int>"
SCHEMA = f"low string, {POSTING}"
TERMS = "low string, term string"
STATS = "rows bigint, tokens bigint"
_ARROW = pa.schema([("term", pa.string()), ("key", pa.int64()), ("n", pa.int32()), ("at", pa.list_(pa.int32()))])
Tokenizer = Callable[[Column], Column]
#: Tokenizers by name, from a string column to an array of strings; add others here.
TOKENIZERS: dict[str, Tokenizer] = {"words": text.tokens}


def _runs(run_tokens: int, run_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (key, ts) to their postings, sorted by term within each run; self-contained, so executors need no package."""

    def postings(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.concat_arrays([b.column("ts") for b in batches])
        keys = pa.concat_arrays([b.column("key") for b in batches])
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int32)
        flat = lists.flatten().dictionary_encode()
        if not len(flat):
            return
        row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        place = np.arange(len(row), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
        told = pa.table({"low": pc.utf8_lower(flat.dictionary), "term": flat.dictionary})
        order = pc.sort_indices(told, sort_keys=[("low", "ascending"), ("term", "ascending")])
        terms = flat.dictionary.take(order)
        rank = np.empty(len(terms) + 1, np.int64)
        rank[order.to_numpy()] = np.arange(len(terms))
        rank[-1] = -1  # of tokens that are null, which no query finds
        of = rank[pc.fill_null(flat.indices, len(terms)).to_numpy()]
        # Tokens come row by row and place by place, so their number settles what is of one term.
        at = np.sort(of << 32 | np.arange(len(of)))
        at = at[np.searchsorted(at, 0) :]
        of, at = (at >> 32).astype(np.int32), (at & 0xFFFFFFFF).astype(np.int32)
        row, place = row[at], place[at]
        first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (row[1:] != row[:-1])]) if len(of) else np.empty(0, np.int64)
        filled = np.flatnonzero(lengths)
        yield pa.record_batch([pa.nulls(len(filled), pa.string()), keys.take(pa.array(filled)), pa.array(lengths[filled]), pa.nulls(len(filled), pa.list_(pa.int32()))], schema=_ARROW)
        bounds = np.append(first, len(of)).astype(np.int32)
        for i in range(0, len(first), run_rows):
            some = first[i : i + run_rows]
            ends = bounds[i : i + len(some) + 1]
            places = pa.ListArray.from_arrays(pa.array(ends - ends[0]), pa.array(place[ends[0] : ends[-1]]))
            yield pa.record_batch([terms.take(pa.array(of[some])), keys.take(pa.array(row[some])), pa.array(lengths[row[some]]), places], schema=_ARROW)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        tokens = 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("ts")), 0).to_numpy())
            start = 0
            while start < batch.num_rows:
                before = int(ends[start - 1]) if start else 0
                end = int(np.searchsorted(ends, before + run_tokens - tokens, "right"))
                if end <= start and not held:
                    end = start + 1
                if end > start:
                    held.append(batch.slice(start, end - start))
                    tokens += int(ends[end - 1]) - before
                    start = end
                if start < batch.num_rows or tokens >= run_tokens:
                    yield from postings(held)
                    held, tokens = [], 0
        if held:
            yield from postings(held)

    return runs


class TextIndex:
    def __init__(self, spark: SparkSession, paths: list[str], stop_words: frozenset[str] = frozenset(), tokenizer: str | None = None):
        self.spark, self.paths, self.stop_words, self.tokenizer = spark, paths, stop_words, tokenizer

    @staticmethod
    def build(rows: DataFrame, path: str, key: str, folder: str, tokenizer: str | None = None) -> None:
        """Write the index of a column; a column that the rows lack has no tokens."""
        f = resolve(rows.schema, path)
        value = ranked.flat_text(f.column, f.type) if f.known else F.lit(None).cast("string")
        told = rows.select(F.col(key).cast("bigint").alias("key"), TOKENIZERS[tokenizer or "words"](value).alias("ts"))
        made = told.mapInArrow(_runs(RUN_TOKENS, RUN_ROWS), POSTING).select(F.lower("term").alias("low"), "term", "key", "n", "at")
        # Small row groups: each task holds one in memory.
        made.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(f"{folder}/postings")
        written = rows.sparkSession.read.schema(SCHEMA).parquet(f"{folder}/postings")
        written.filter(F.col("term").isNotNull()).select("low", "term").distinct().write.option("compression", "zstd").parquet(f"{folder}/terms")
        held = written.filter(F.col("term").isNull())
        held.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).write.parquet(f"{folder}/stats")

    def postings(self) -> DataFrame:
        # Each folder by itself: older ones are parted by a column of their own, found below them.
        parts = [self.spark.read.schema(SCHEMA).option("basePath", f"{p}/postings").parquet(f"{p}/postings").select("low", "term", "key", "n", "at") for p in self.paths]
        return (reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], SCHEMA)).filter(F.col("term").isNotNull())

    def stats(self) -> DataFrame:
        """One row: `rows` with a token, and their `mean` number of tokens."""
        all_ = self.spark.read.schema(STATS).parquet(*[f"{p}/stats" for p in self.paths]) if self.paths else self.spark.createDataFrame([], STATS)
        return all_.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), (F.sum("tokens") / F.sum("rows")).alias("mean"))

    def of(self, words: list[str]) -> DataFrame:
        """The postings of lower-cased words."""
        return self.postings().filter(F.col("low").isin(words))

    def term(self, query: str, case_sensitive: bool = True) -> DataFrame:
        """(key) of the rows with a token that the query finds, once each."""
        word, start, end = text.term_query(query)
        if word is None or not (start or end) and word in self.stop_words:
            return self.spark.createDataFrame([], "key bigint")
        test = text.token_test(word, start, end, case_sensitive)(F.col("term"))
        if self.stop_words:
            test = test & ~F.col("term").isin(sorted(self.stop_words))
        if not start and not end:
            return self.of([word.lower()]).filter(test).select("key").distinct()
        # The postings pass the same test, so nothing is joined; the dictionary only tells which to read.
        terms = self.spark.read.schema(TERMS).parquet(*[f"{p}/terms" for p in self.paths]) if self.paths else self.spark.createDataFrame([], TERMS)
        found = [r["low"] for r in terms.filter(test).select("low").distinct().limit(LISTED_TERMS + 1).collect()]
        rows = self.postings() if len(found) > LISTED_TERMS else self.of(found)
        return rows.filter(test).select("key").distinct()

    def matches(self, parsed: textquery.Node, k: int | None = None) -> DataFrame | None:
        """(key, _score) of the rows that match, or the k best, by BM25; None if rows with none of the words may match."""
        words, scored = sorted(parsed.words_in()), sorted(parsed.scored())
        if not scored:
            return self.spark.createDataFrame([], "key bigint, _score double")
        if parsed.without_words():
            return None
        # For each row the places of each word, whatever their case.
        places = [F.sort_array(F.flatten(F.collect_list(F.when(F.col("low") == w, F.col("at"))))).alias(f"p{i}") for i, w in enumerate(words)]
        held = self.of(words).groupBy("key").agg(F.first("n").alias("n"), *places)
        at = {w: F.col(f"p{i}") for i, w in enumerate(words)}
        tf = [F.size(at[w]).cast("double") for w in scored]
        # Rows that hold a word are told by keys alone, without the places.
        told = self.of(scored).select("low", "key").distinct()
        stats = self.stats().crossJoin(told.agg(F.array(*[F.count(F.when(F.col("low") == w, 1)) for w in scored]).alias("df")))
        joined = held.filter(parsed.by_places(at)).crossJoin(F.broadcast(stats))  # one row of statistics
        score = ranked.bm25(tf, [F.get("df", F.lit(i)) for i in range(len(tf))], F.col("rows"), F.col("n"), F.col("mean"))
        out = joined.select("key", score.alias("_score"))
        return out if k is None else out.orderBy(F.col("_score").desc(), "key").limit(k)
