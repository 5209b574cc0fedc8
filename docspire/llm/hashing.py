"""Hashes of words, runs of words and runs of bytes of many texts at once.

Texts come as the one buffer of an Arrow column. A running sum of byte codes
times powers of an odd number gives the hash of any slice in two look-ups, so a
pass costs a few array operations whatever the slices are.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20_240_607)
#: A random code for each byte, two odd bases and their inverses modulo 2**64.
CODES = _RNG.integers(1, 2**63, 256, dtype=U)
BASES = [int(x) | 1 for x in _RNG.integers(1, 2**63, 2)]
ODD = _RNG.integers(1, 2**63, 512, dtype=U) | U(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes of text that are hashed at once.
CHUNK = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of `h` over all others; one to one."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i up to n; the tables are kept up to the chunk size."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        size = max(n, 2 * CHUNK) + 1
        made = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, U)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > 2 * CHUNK + 1:
            return made[0], made[1]
        _POWERS[base] = (made[0], made[1])
    return _POWERS[base]


def release() -> None:
    """Give memory that this worker holds unused back to the system: it may wait long for its next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def chunks(batch: pa.RecordBatch, column: int, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `size` bytes; null texts are empty."""
    text = batch.column(column)
    if not pa.types.is_large_string(text.type):
        text = text.cast(pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    n = len(text)
    if not n:
        return
    bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + size, "right")) - 1))
        yield lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def prefix(data: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """What `slices` needs of the bytes."""
    power, inverse = _powers(BASES[which], len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(CODES[data] * power[: len(data)], out=sums[1:])
    return sums, inverse


def prefix_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What `slices` needs of a sequence of hashes."""
    power, inverse = _powers(BASES[0], len(h))
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(h * power[: len(h)], out=sums[1:])
    return sums, inverse


def slices(table: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the slices of bytes."""
    sums, inverse = table
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each text with the count at the end."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~space
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = word.copy()
    starts[1:] &= space[:-1] | first[1:-1]
    ends = word.copy()
    ends[:-1] &= space[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def runs(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of every `length` neighbours of `h`, as many as there are; the caller leaves out those over a border."""
    n = max(0, len(h) - length + 1)
    out = np.full(n, U(length * 0xD1B54A32D192ED03 % 2**64), U)
    for j in range(length):
        out += h[j : j + n] * ODD[j]
    return mix(out)
