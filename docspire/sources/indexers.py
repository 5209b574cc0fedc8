"""Kinds of index that have tables beside each part, by name; add others with `register`.

An indexer writes the tables of one part and opens those of all parts as an object
that `find` asks: for slot ``text`` one with `term` and `matches`, for slot
``vector`` one with `nearest`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stopwords import STOP_WORDS
from .textindex import TextIndex
from .vectorindex import VectorIndex


@dataclass(frozen=True)
class Indexer:
    slot: str
    #: (rows, path, key column, folder, options of the index)
    build: Callable[[DataFrame, str, str, str, dict[str, Any]], None]
    #: (session, folders of the parts, options)
    open: Callable[[SparkSession, list[str], dict[str, Any]], Any]


INDEXERS: dict[str, Indexer] = {}


def register(kind: str, indexer: Indexer) -> None:
    if kind in INDEXERS:
        raise ValueError(f"an indexer of kind {kind} exists")
    INDEXERS[kind] = indexer


class Vectors:
    """The vector indexes of several parts as one."""

    def __init__(self, spark: SparkSession, folders: list[str], options: dict[str, Any]):
        self.parts = [VectorIndex(spark, f, options.get("metric", "cosine"), options.get("probes")) for f in folders]

    def nearest(self, query: tuple[float, ...], k: int, min_score: float | None = None) -> DataFrame:
        found = reduce(DataFrame.unionByName, [p.nearest(query, k, min_score) for p in self.parts])
        return found.orderBy(F.col("_score").desc(), "key").limit(k)


def _build_text(rows: DataFrame, path: str, key: str, folder: str, options: dict[str, Any]) -> None:
    TextIndex.build(rows, path, key, folder, options.get("tokenizer"))


def _build_vectors(rows: DataFrame, path: str, key: str, folder: str, options: dict[str, Any]) -> None:
    VectorIndex.build(rows, path, key, folder, options.get("metric", "cosine"), options.get("cells"))


def _stop_words(options: dict[str, Any]) -> frozenset[str]:
    """Of a language, or the words given."""
    return frozenset(options.get("stop_words") or STOP_WORDS[options.get("language", "english")])


register("full_text", Indexer("text", _build_text, lambda spark, folders, o: TextIndex(spark, folders, _stop_words(o), o.get("tokenizer"))))
register("fts", Indexer("text", _build_text, lambda spark, folders, o: TextIndex(spark, folders, frozenset(), o.get("tokenizer"))))
register("vector_cells", Indexer("vector", _build_vectors, Vectors))
