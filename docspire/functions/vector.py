"""Distances and scores of vector columns, and lossy codecs.

Distances: cosine ``1 - dot`` of unit vectors (a zero vector stays zero, so its
distance is 1), squared Euclidean, and the negative dot product. Scores grow with
nearness: ``1 - d``, ``1 / (1 + sqrt(d))`` and ``-d``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "dot")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def distance(vector: Column, query: list[float], metric: str = "cosine") -> Column:
    """In double precision; null for null vectors and such of another length."""
    if metric not in METRICS:
        raise ValueError(f"no metric {metric}")
    v = vector.cast("array<double>")
    norm = math.sqrt(sum(q * q for q in query)) if metric == "cosine" else 1.0
    q = F.array(*[F.lit(float(x) / norm if norm else 0.0) for x in query])
    if metric == "euclidean":
        out = _sum(F.zip_with(v, q, lambda a, b: (a - b) * (a - b)))
    else:
        dot = _sum(F.zip_with(v, q, lambda a, b: a * b))
        if metric == "dot":
            out = -dot
        else:
            # One pass for both sums.
            size = F.sqrt(_sum(F.transform(v, lambda a: a * a)))
            out = 1.0 - F.when(size == 0, F.lit(0.0)).otherwise(dot / size)
    return F.when(F.size(v) == len(query), out)


def score(dist: Column, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return 1.0 - dist
    return 1.0 / (1.0 + F.sqrt(dist)) if metric == "euclidean" else -dist


def encode_f16(vector: Column) -> Column:
    """Rounded to the 11 bits of a half-precision significand."""

    def half(x: Column) -> Column:
        e = F.floor(F.log2(F.abs(x)))
        step = F.pow(F.lit(2.0), F.greatest(e, F.lit(-14)) - 10)
        return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x / step) * step)

    return F.transform(vector.cast("array<double>"), half)


def encode_i8(vector: Column) -> Column:
    """``{low, scale, codes}``: each number as one of 256 steps from the least."""
    v = vector.cast("array<double>")
    low, high = F.array_min(v), F.array_max(v)
    scale = F.when(high > low, (high - low) / 255).otherwise(F.lit(1.0))
    return F.struct(low.alias("low"), scale.alias("scale"), F.transform(v, lambda x: F.rint((x - low) / scale).cast("smallint")).alias("codes"))


def decode_i8(coded: Column) -> Column:
    return F.transform(coded["codes"], lambda c: coded["low"] + c * coded["scale"])
