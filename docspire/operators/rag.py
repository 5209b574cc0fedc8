"""A store of texts with embeddings for retrieval: filter first, then nearest."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame

from ..plans.filters import Filter
from ..plans.find import Context, find
from ..plans.ranked import nearest


@dataclass(frozen=True)
class Search:
    """A search; `run` gives the k best rows with `_score`."""

    rows: DataFrame
    query: tuple[float, ...]
    k: int
    metric: str = "cosine"
    where: Filter | None = None
    least: float | None = None
    key: str = "_id"

    def filter(self, node: Filter) -> Search:
        return replace(self, where=node)

    def min_score(self, least: float) -> Search:
        return replace(self, least=least)

    def ef(self, _: int) -> Search:
        """Search is exact, so there is no effort to set."""
        return self

    def oversample(self, _: int) -> Search:
        """The filter comes first, so no surplus is needed."""
        return self

    def run(self) -> DataFrame:
        rows = find(self.rows, self.where, context=Context(key=self.key)) if self.where else self.rows
        return nearest(rows, "embedding", self.query, self.k, self.metric, self.least, self.key)


class RagStore:
    """A collection of documents with `text`, `embedding` and metadata."""

    def __init__(self, collection: Any, dimensions: int, metric: str = "cosine"):
        self.collection, self.dimensions, self.metric = collection, dimensions, metric

    def add(self, text: str, embedding: list[float], metadata: dict[str, Any] | None = None) -> int:
        return self.add_many([(text, embedding, metadata or {})])[0]

    def add_many(self, chunks: list[tuple[str, list[float], dict[str, Any]]]) -> list[int]:
        for _, embedding, _ in chunks:
            if len(embedding) != self.dimensions:
                raise ValueError(f"an embedding has {self.dimensions} numbers, not {len(embedding)}")
        return self.collection.insert([{**meta, "text": text, "embedding": [float(x) for x in e]} for text, e, meta in chunks])

    def get(self, id_: int) -> Any:
        return self.collection.get_by_id(id_)

    def delete(self, id_: int) -> int:
        from ..plans.filters import by_id

        return self.collection.remove(by_id(id_))

    def __len__(self) -> int:
        return self.collection.size()

    def is_empty(self) -> bool:
        return len(self) == 0

    def search(self, query: list[float], k: int) -> Search:
        return Search(self.collection.frame(), tuple(query), k, self.metric)
