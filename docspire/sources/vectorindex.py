"""Inverted-file vector indexes: cells around centres, of which a search reads the nearest few.

Centres are fitted by k-means on a sample of at most about `SAMPLE_ROWS` rows,
chosen by a hash of their keys; every row is then assigned to its nearest centre
and written in order of cells, so that a search's cells are a few row groups. The
rows that it reads are compared exactly. A search reads as many cells, its probes,
as held `FOUND` of the nearest rows of some of the sample's rows, so data without
clusters are searched more widely. With as many probes as cells the result is that
of the exact search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import ranked

SAMPLE_ROWS, ROUNDS = 50_000, 10
#: Cells at most: the driver holds the centres.
MOST_CELLS = 4096
#: Share of the nearest rows that the fitted number of probes must find, of how many rows' how many nearest.
FOUND, QUERIES, NEAREST = 0.96, 300, 10


def _unit(v: np.ndarray, metric: str) -> np.ndarray:
    """Vectors in the space in which cells are near: for the cosine their directions."""
    if metric != "cosine":
        return v
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size == 0, 1, size)


def _nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * v @ centres.T, 1)


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    centres = sample[np.sort(rng.choice(len(sample), min(cells, len(sample)), replace=False))]
    for _ in range(ROUNDS):
        own = _nearest(sample, centres)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        centres = np.where(count[:, None] > 0, total / np.maximum(1, count)[:, None], centres)
    return centres


def _order(centres: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Cells from the nearest on, for each query."""
    far = -(q @ centres.T) if metric == "dot" else (centres * centres).sum(1) - 2 * q @ centres.T
    return np.argsort(far, 1, kind="stable")


def _probes(sample: np.ndarray, centres: np.ndarray, metric: str) -> int:
    """How many cells hold `FOUND` of the nearest rows, on average over some queries."""
    q = sample[:: max(1, len(sample) // QUERIES)][:QUERIES]
    own, rank = _nearest(sample, centres), np.argsort(_order(centres, q, metric), 1)
    size = 0 if metric == "dot" else (sample * sample).sum(1)
    near = np.argsort(size - (1 if metric == "dot" else 2) * q @ sample.T, 1)[:, :NEAREST]
    ranks = np.sort(np.take_along_axis(rank, own[near], 1).ravel())
    return int(ranks[min(len(ranks) - 1, math.ceil(FOUND * len(ranks)) - 1)]) + 1


class VectorIndex:
    def __init__(self, spark: SparkSession, folder: str, metric: str = "cosine", probes: int | None = None):
        self.spark, self.folder, self.metric = spark, folder, metric
        found = spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()  # at most MOST_CELLS
        self.centres = np.array([r["centre"] for r in found]) if found else np.zeros((0, 1))
        self.probes = probes or (found[0]["probes"] if found else 1)

    @staticmethod
    def build(rows: DataFrame, column: str, key: str, folder: str, metric: str = "cosine", cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> None:
        """Write the index of a column of vectors of one length; rows without a vector have no place in it."""
        spark = rows.sparkSession
        told = rows.select(F.col(key).cast("bigint").alias("key"), F.col(column).cast("array<double>").alias("vector")).filter("vector IS NOT NULL")
        n = told.count()
        cells = min(MOST_CELLS, cells or max(1, round(math.sqrt(n))))
        picked = told if n <= sample_rows else told.filter(F.xxhash64("key").cast("double") < -(2.0**63) + 2.0**64 * sample_rows / n)
        sample = picked.select("vector").toArrow().column("vector").combine_chunks()  # bounded by sample_rows
        points = _unit(np.asarray(sample.flatten()).reshape(len(sample), -1), metric) if n else np.zeros((0, 1))
        centres = _centres(points, cells) if len(points) else points
        probes = _probes(points, centres, metric) if len(points) else 1
        spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centres)], "cell int, centre array<double>, probes int").write.parquet(f"{folder}/centres")

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
                own = _nearest(_unit(v, metric), centres) if len(v) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype("i4"))], ["key", "vector", "cell"])

        placed = told.mapInArrow(assign, "key bigint, vector array<double>, cell int")
        # Ranges of cell and key: a cell of very many rows spreads over several files.
        placed.repartitionByRange("cell", "key").sortWithinPartitions("cell").write.parquet(f"{folder}/rows")

    def nearest(self, query: tuple[float, ...], k: int, min_score: float | None = None, probes: int | None = None) -> DataFrame:
        """(key, _score) of the k best rows of the nearest cells."""
        rows = self.spark.read.schema("key bigint, vector array<double>, cell int").parquet(f"{self.folder}/rows")
        if not len(self.centres):
            return rows.select("key", F.lit(None).cast("double").alias("_score")).limit(0)
        cells = _order(self.centres, _unit(np.array([query], float), self.metric), self.metric)[0][: probes or self.probes].tolist()
        return ranked.nearest(rows.filter(F.col("cell").isin(cells)), "vector", query, k, self.metric, min_score, "key").select("key", "_score")

    def recall(self, rows: DataFrame, column: str, key: str, queries: list[tuple[float, ...]], k: int) -> float:
        """Share of the exact search's rows that this one finds, over some queries."""
        hit = 0
        for q in queries:
            want = {r[0] for r in ranked.nearest(rows, column, q, k, self.metric, None, key).select(key).collect()}
            hit += len(want & {r["key"] for r in self.nearest(q, k).collect()}) / max(1, len(want))
        return hit / max(1, len(queries))
