"""Substring dedup by words: level-wise doubling.

A word is removed if it lies in a window of `window` words whose words also
start earlier, in a document of smaller id or before in the same one. Levels:

1. Windows of half that length, chosen by content: of the half windows in each
   window the one of least hash, so equal windows choose equal ones and about one
   in six positions is sent.
2. Windows of the whole length whose half repeats; 128-bit hashes find the first
   place of each, and all others are removed.
3. From there windows repeated at one length alone are extended to twice that
   length, 40, 80, 160 words, until no candidate survives. Each level takes the
   starts of least half-window hash among those of twice its length, so levels
   are nested and the work falls by half with each. They change no word of the
   result: they tell how long the longest repeat is. `repeat_level` is the
   greatest level at which a window of the document repeats, so its longest
   repeated run has that many words or more, and fewer than four times as many.

Defined results: a null text has no words; texts shorter than a window lose
nothing; rows that share an id count as one document but each is judged by its
own text, so equal places of two such rows remove nothing; a row without id is
compared with none; an empty table gives an empty one; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from . import repeats as R
from .common import buckets_for, cut

WINDOW = 20
#: Bytes sent of the keys at each kind of level; with the bucket, the first holds 45 bits and more.
HALF, WHOLE, LONGER = (5,), (5, 8), (8,)


def _windows(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Word hashes, starts of whole windows, the chosen half of each, first words of the texts and the text of each window."""
    starts, ends, first = H.words(data, offsets)
    h = H.slices(H.prefix(data), starts, ends)
    at, owner = _starts(first, window)
    half = H.runs(h, window // 2)
    chosen = R.least_of(half, window - window // 2 + 1)[at] if len(at) else np.zeros(0, np.int64)
    return h, at, chosen, half, first, owner


def _starts(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of `length` words that lie in one text, and the text of each."""
    n = np.maximum(0, np.diff(first) - length + 1)
    owner = np.repeat(np.arange(len(n)), n)
    return np.repeat(first[:-1], n) + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n), owner


def _first_level(window: int, buckets: int, own: bool):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[R.Entries]:
        for batch in batches:
            batch, ids, rows = R.identified(batch, own)
            for lo, _, data, offsets in H.chunks(batch, 2):
                _, _, chosen, half, first, owner = _windows(data, offsets, window)
                new = np.flatnonzero(np.diff(chosen, prepend=-1))  # the chosen one never moves back
                at, text = chosen[new], owner[new]
                h = half[at]
                yield R.Entries([h], ids[lo + text], (at - first[text]).astype("i4"), np.ones(len(h), "u1"), R.bucket_of(h, buckets), rows[lo + text] if own else None)

    return lambda batches: R.send(parts(batches), R.repeated, HALF, buckets)


def _second_level(window: int, buckets: int, own: bool):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[R.Entries]:
        for batch in batches:
            batch, ids, rows = R.identified(batch.filter(batch.column(3).is_valid()), own)
            for lo, hi, data, offsets in H.chunks(batch, 2):
                h, at, chosen, _, first, owner = _windows(data, offsets, window)
                kept = np.zeros(len(h) + 1, bool)
                for row, marks in enumerate(batch.column(3).slice(lo, hi - lo).to_pylist()):
                    kept[first[row] + R.unpack(marks)[0]] = True
                go = kept[chosen]
                at, text = at[go], owner[go]
                g = H.mix(h ^ H.ODD[400])
                one, two = np.zeros(len(at), H.U), np.zeros(len(at), H.U)
                for j in range(window):
                    one += h[at + j] * H.ODD[j]
                    two += g[at + j] * H.ODD[256 + j]
                one = H.mix(one)
                yield R.Entries([one, H.mix(two)], ids[lo + text], (at - first[text]).astype("i4"), np.ones(len(at), "u1"), R.bucket_of(one, buckets), rows[lo + text] if own else None)

    return lambda batches: R.send(parts(batches), R.later_place, WHOLE, buckets)


def _longer(h: np.ndarray, half: np.ndarray, first: np.ndarray, window: int, known: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, text, start in it, hash) of the chosen windows of each longer level whose first `window` words repeat."""
    length, table = 2 * window, None
    while 2 * length <= int(np.diff(first).max(initial=0)):
        at, owner = _starts(first, 2 * length)
        # Of the starts of windows in a run of twice the length, the one of least half window.
        chosen = R.least_of(half, length + 1)[at]
        new = np.flatnonzero((np.diff(chosen, prepend=-1) != 0) & known[chosen])
        table = table or H.prefix_of(H.mix(h ^ H.ODD[401]))
        start, text = chosen[new], owner[new]
        if len(start):
            yield length, text, start - first[text], H.slices(table, start, start + length)
        length *= 2


def _remove(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi, data, offsets in H.chunks(whole, 2):
                batch = whole.slice(lo, hi - lo)
                marks = [R.unpack(m) if m else None for m in batch.column(3).to_pylist()]
                counts, removed, hashes, texts = [], [], [], []
                raw = data.tobytes()
                for k, mark in enumerate(marks):
                    # Splits bytes at the six separators of the contract.
                    ws = raw[offsets[k] : offsets[k + 1]].split()
                    counts.append(len(ws))
                    if mark:
                        pos = mark[0][mark[2]]
                        edge = np.zeros(len(ws) + 1, np.int64)
                        np.add.at(edge, pos, 1)
                        np.add.at(edge, pos + window, -1)
                        ws = list(compress(ws, (np.cumsum(edge[:-1]) == 0).tolist()))
                    removed.append(counts[-1] - len(ws))
                    texts.append(b" ".join(ws))
                    hashes.append(hashlib.sha256(texts[-1]).hexdigest())
                levels: list[list[dict]] = [[] for _ in marks]
                if any(m and len(m[0]) for m, n in zip(marks, counts, strict=True) if n >= 4 * window):
                    h, _, _, half, first, _ = _windows(data, offsets, window)
                    known = np.zeros(len(h) + 1, bool)
                    for k, mark in enumerate(marks):
                        if mark:
                            known[first[k] + mark[0]] = True
                    for length, text, pos, key in _longer(h, half, first, window, known):
                        cuts = np.flatnonzero(np.diff(text, prepend=-1))
                        for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True):
                            levels[text[a]].append({"level": length, "pos": pos[a:b].astype("<i4").tobytes(), "hash": key[a:b].tobytes()})
                cols = [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes, pa.string())]
                cols += [pa.array([bool(m and len(m[0])) for m in marks]), pa.array(levels, pa.list_(pa.struct([("level", pa.int32()), ("pos", pa.binary()), ("hash", pa.binary())])))]
                names = ["key", "doc_id", "n_words", "n_removed", "kept_sha256", "repeats", "levels"]
                if keep_text:
                    cols.append(pa.array(texts, pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _next_level(buckets: int, own: bool):
    """Entries of rows (key, doc_id, pos, hash, marks): the starts that repeated at half the length, all if marks are null."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[R.Entries]:
        for batch in batches:
            batch, ids, rows = R.identified(batch, own)
            for k, (pos, key, marks) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                at, h = np.frombuffer(pos, "<i4"), np.frombuffer(key, H.U)
                if marks is not None:
                    go = np.isin(at, R.unpack(marks)[0])
                    at, h = at[go], h[go]
                yield R.Entries([h], np.full(len(h), ids[k]), at, np.ones(len(h), "u1"), R.bucket_of(h, buckets), np.full(len(h), rows[k]) if own else None)

    return lambda batches: R.send(parts(batches), R.repeated, LONGER, buckets)


def _extended(made: DataFrame, window: int, buckets: int, own: bool) -> DataFrame:
    """(key, repeat_level) of the rows with a repeated window longer than `window`."""
    states = made.select("key", "doc_id", F.explode("levels").alias("x")).select("key", "doc_id", "x.*")
    survived, levels, length = None, None, 2 * window
    while True:
        state = states.filter(F.col("level") == length).select("key", "doc_id", "pos", "hash")
        if survived is None:
            state = state.withColumn("marks", F.lit(None).cast("array<struct<body:binary,whole:boolean>>"))
        else:
            marks = survived.select(F.col("key").alias("_key"), F.struct("body", "whole").alias("mark")).groupBy("_key").agg(F.collect_list("mark").alias("marks"))
            state = state.join(marks, F.col("key") == F.col("_key")).select("key", "doc_id", "pos", "hash", "marks")
        survived = cut(R.replies(state.mapInArrow(_next_level(buckets, own), R.ENTRY), R.repeated, LONGER))
        if survived.isEmpty():
            break
        found = survived.select("key").distinct().withColumn("level", F.lit(length))
        levels = found if levels is None else levels.unionByName(found)
        length *= 2
    if levels is None:
        return made.sparkSession.createDataFrame([], "key bigint, level int")
    return levels.groupBy("key").agg(F.max("level").alias("level"))


def dedup(docs: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, repeat_level, kept); `kept` is the UTF-8 text that is left, if asked for."""
    if window % 2 or not 2 <= window <= 255:
        raise ValueError("window: an even number up to 254")
    texts, own = R.rows_to_compare(docs)
    buckets = buckets_for(docs)
    halves = R.replies(texts.mapInArrow(_first_level(window, buckets, own), R.ENTRY), R.repeated, HALF)
    marked = R.only_marked(R.by_row(texts, halves))
    later = R.replies(marked.mapInArrow(_second_level(window, buckets, own), R.ENTRY), R.later_place, WHOLE)
    schema = "key bigint, doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, repeats boolean, levels array<struct<level:int,pos:binary,hash:binary>>"
    made = cut(R.by_row(texts, later).mapInArrow(_remove(window, keep_text), schema + (", kept binary" if keep_text else "")))
    longer = _extended(made, window, buckets, own).withColumnsRenamed({"key": "_key", "level": "_level"})
    level = F.coalesce("_level", F.when(F.col("repeats"), window).otherwise(0)).cast("int").alias("repeat_level")
    out = made.join(longer, F.col("key") == F.col("_key"), "left")
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", level, *(["kept"] if keep_text else []))
