"""Substring dedup by bytes: a sparse suffix array over sampled suffixes.

A byte is removed if it lies in a string of `length` bytes that also starts in a
document of smaller id. Not every suffix is sorted, only those that start at an
anchor: of the places in each string with `8 * TOKENS` bytes of the string after
them, the one whose leading token, 8 bytes, has the least hash. Equal strings
have equal anchors, and one position in fourteen is one.

Suffixes are dealt by range of their first token, a big-endian number whose order
is that of the bytes, and where that is equal of a hash of the `TOKENS` leading
ones, their name. The splitters are quantiles of the anchors of a sample of
documents. They lie between different names, so equal suffixes share a range and
neighbours across a boundary differ in their leading tokens: there is nothing left
to compare there but a name that fills several ranges of the sample, see below.
Beyond `MOST_RANGES` ranges each is split further by the name, so the driver holds
a bounded number of splitters whatever the input. Buckets sort by multikey
quicksort, by the first token and only runs of equals by the name, and compare
neighbours. Three rounds:

1. the leading tokens of anchors alone: those of one document go no further;
2. for each anchor left, the whole stretch of strings that share it: a stretch
   also found in an earlier document goes as a whole;
3. only where one anchor has different stretches, their bytes, of which the
   bucket compares the single strings.

Names that fill several ranges of the sample (a passage that a third of all
documents hold, each after other words) would gather in one task: in round 2
their strings are dealt one by one, by the strings' own hashes, over all buckets,
and compared there. Stretches and strings count as equal if 109 bits or more of
their hashes are.

Defined results: a null text is empty; texts shorter than `length` lose nothing;
rows that share an id count as one document but each is judged by its own text;
a row without id is compared with none; an empty table gives an empty one; a cut
may split a character, so `kept` is binary; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from . import repeats as R
from .common import buckets_for, cut, input_bytes

LENGTH = 50
#: Tokens of 8 bytes by which suffixes are dealt and first sorted.
TOKENS = 3
#: Ranges of leading tokens at most, and sampled suffixes for each: so many, and 16 at least where that makes over `MOST_SAMPLES` in all.
MOST_RANGES, SAMPLES, MOST_SAMPLES = 1 << 16, 64, 1 << 20
#: Bytes of text, as its table is stored, for each bucket.
PER_BUCKET = 4 << 20
#: Bytes sent of the keys of each round; in the first, two suffixes taken for equal cost an entry of the second.
LEADING, STRETCH = (8, 3), (5, 8)


def _tokens(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a big-endian number."""
    n = max(0, len(data) - 7)
    return np.ndarray(n, ">u8", np.ascontiguousarray(data), strides=(1,)).astype(H.U) if n else np.zeros(0, H.U)


def _stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Tokens of every place; of each run of strings with one anchor the anchor, first start, number of starts and text."""
    width = 8 * TOKENS
    token = _tokens(data)
    chosen = R.least_of(H.mix(token[: max(0, len(data) - width + 1)]), length - width + 1)  # for every start, also those over a border
    whole = np.zeros(len(data) + 1, np.int64)  # starts whose string lies in one text
    size = np.diff(offsets)
    fits = size >= length
    np.add.at(whole, offsets[:-1][fits], 1)
    np.add.at(whole, offsets[1:][fits] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(whole)[: len(chosen)])
    anchor = chosen[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    owner = np.searchsorted(offsets, at[first], "right") - 1
    return token, anchor[first], at[first], count, owner


def _leading(token: np.ndarray, anchor: np.ndarray) -> list[np.ndarray]:
    """The first token of each anchor and the name of the leading ones."""
    first = token[anchor]
    name = first * H.ODD[0]
    for j in range(1, TOKENS):
        name = H.mix(name) ^ token[anchor + 8 * j] * H.ODD[j]
    return [first, H.mix(name)]


class Ranges:
    """Splitters between leading tokens: (first token, name) pairs in order."""

    def __init__(self, sample: list[np.ndarray], buckets: int):
        """`sample`: first tokens and names, in no order."""
        ranges = min(buckets, MOST_RANGES)
        self.split = -(-buckets // ranges)
        self.buckets = ranges * self.split
        order, _ = R.multikey(sample)
        at = np.unique(np.arange(1, ranges) * len(order) // ranges) if len(order) else np.zeros(0, np.int64)
        first, name = (k[order[at]] for k in sample)
        again = np.zeros(len(at), bool)
        again[1:] = (first[1:] == first[:-1]) & (name[1:] == name[:-1])
        self.hot = np.unique(name[again])
        self.first, self.both = first[~again], self._pairs(first[~again], name[~again])

    @staticmethod
    def _pairs(first: np.ndarray, name: np.ndarray) -> np.ndarray:
        """Strings of 16 bytes, which compare as the pairs do."""
        return np.stack([first, name], 1).astype(">u8").view("S16").reshape(-1)

    def of(self, first: np.ndarray, name: np.ndarray) -> np.ndarray:
        """The bucket of each suffix."""
        low, high = np.searchsorted(self.first, first, "left"), np.searchsorted(self.first, first, "right")
        tie = np.flatnonzero(low != high)
        low[tie] = np.searchsorted(self.both, self._pairs(first[tie], name[tie]), "right")
        sub = R.bucket_of(name, self.split) if self.split > 1 else 0
        return (low * self.split + sub).astype("i4")


def _sample(texts: DataFrame, length: int, buckets: int, size: int) -> list[np.ndarray]:
    """First tokens and names of about `SAMPLES` anchors for each range: of documents chosen by their keys, anchors chosen by their places."""
    ranges = min(buckets, MOST_RANGES)
    rate = min(1.0, max(16, min(SAMPLES, MOST_SAMPLES // ranges)) * ranges * 14 / max(1, size))
    of_rows = min(1.0, 16 * rate)
    every = max(1, round(of_rows / rate))
    rows = texts.filter(F.xxhash64("key").cast("double") < -(2.0**63) + 2.0**64 * of_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in H.chunks(batch, 1):
                token, anchor, start, _, owner = _stretches(data, offsets, length)
                go = (H.mix((start - offsets[owner]).astype(H.U) + (owner + lo).astype(H.U) * H.ODD[5]) % H.U(every)) == 0
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)) for k in _leading(token, anchor[go])], ["first", "name"])

    found = rows.select("key", "text").mapInArrow(run, "first bigint, name bigint").toArrow()  # bounded by SAMPLES and MOST_RANGES
    return [found.column(c).to_numpy().astype(np.int64).view(H.U) for c in ("first", "name")]


def _entries(keys, ids, pos, n, to, rows, text) -> R.Entries:
    return R.Entries(keys, ids[text], pos.astype("i4"), n, to, None if rows is None else rows[text])


def _anchors(length: int, ranges: Ranges, own: bool):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[R.Entries]:
        for batch in batches:
            batch, ids, rows = R.identified(batch, own)
            for lo, _, data, offsets in H.chunks(batch, 2):
                token, anchor, start, _, owner = _stretches(data, offsets, length)
                keys = _leading(token, anchor)
                yield _entries(keys, ids, start - offsets[owner], np.zeros(len(anchor), "u1"), ranges.of(*keys), rows, lo + owner)

    return lambda batches: R.send(parts(batches), R.in_other_document, LEADING, ranges.buckets)


def _marked(batches: Iterator[pa.RecordBatch], own: bool):
    """Of marked texts: ids, row keys, bytes, offsets, stretches with a mark, and which of these marks are whole."""
    for batch in batches:
        batch, ids, keys = R.identified(batch.filter(batch.column(3).is_valid()), own)
        for lo, hi, data, offsets in H.chunks(batch, 2):
            rows = [R.unpack(m) for m in batch.column(3).slice(lo, hi - lo).to_pylist()]
            at = np.concatenate([offsets[k] + r[0] for k, r in enumerate(rows)])
            n = np.concatenate([r[1] for r in rows])
            whole = np.concatenate([r[2] for r in rows])
            owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
            yield ids[lo:hi], keys[lo:hi] if own else None, data, offsets, at, n, whole, owner


def _whole_stretches(length: int, ranges: Ranges, own: bool):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[R.Entries]:
        for ids, rows, data, offsets, at, _, _, _ in _marked(batches, own):
            token, anchor, start, count, owner = _stretches(data, offsets, length)
            kept = np.zeros(len(data) + 1, bool)
            kept[at] = True
            go = kept[start]
            anchor, start, count, owner = anchor[go], start[go], count[go], owner[go]
            one, two = H.prefix(data), H.prefix(data, 1)
            lead, name = _leading(token, anchor)
            hot = np.isin(name, ranges.hot)
            if hot.any():
                at, text = _each(start[hot], count[hot]), np.repeat(owner[hot], count[hot])
                h = H.slices(one, at, at + length)
                yield _entries([h, H.slices(two, at, at + length)], ids, at - offsets[text], np.ones(len(at), "u1"), R.bucket_of(h, ranges.buckets), rows, text)
                cold = ~hot
                anchor, start, count, owner, lead, name = anchor[cold], start[cold], count[cold], owner[cold], lead[cold], name[cold]
            end = start + count - 1 + length
            # The anchor's place in the stretch is part of what must be equal.
            g = H.mix(H.slices(two, start, end) ^ (anchor - start).astype(H.U) * H.ODD[7])
            yield _entries([name, g], ids, start - offsets[owner], count.astype("u1"), ranges.of(lead, name), rows, owner)

    return lambda batches: R.send(parts(batches), R.later_document_or_kind, STRETCH, ranges.buckets)


def _each(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Starts of all strings of the stretches."""
    return np.repeat(start, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _kinds(length: int, ranges: Ranges, own: bool):
    """Sends finished stretches on as they are, and of the others the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[R.Entries] = []
        raws: list[bytes] = []
        done: list[R.Entries] = []

        def flush() -> Iterator[pa.RecordBatch]:
            e = R.Entries.join(held)
            rows = [R.packed(e.take(at), bucket, STRETCH[:1], raw=b"".join([raws[i] for i in at.tolist()])) for bucket, at in R.by_bucket(e)]
            rows += R.done_rows(done, ranges.buckets)
            for x in (held, raws, done):
                x.clear()
            if rows:
                yield R.rows_of(rows)

        size = 0
        for ids, keys, data, offsets, at, n, whole, row in _marked(batches, own):
            none = np.zeros(int(whole.sum()), "i4")
            done.append(_entries([], ids, at[whole] - offsets[row[whole]], n[whole], none, keys, row[whole]))
            at, count, text = at[~whole], n[~whole].astype(np.int64), row[~whole]
            if len(at):
                token, anchor, start, _, _ = _stretches(data, offsets, length)
                # Marks start where stretches do, but for single strings of hot anchors.
                lead, name = _leading(token, anchor[np.searchsorted(start, at, "right") - 1])
                held.append(_entries([name], ids, at - offsets[text], count.astype("u1"), ranges.of(lead, name), keys, text))
                flat = data.tobytes()
                raws.extend([flat[lo:hi] for lo, hi in zip(at.tolist(), (at + count - 1 + length).tolist(), strict=True)])
            size += len(whole)
            if size >= R.FLUSH:
                yield from flush()
                size = 0
        yield from flush()

    return run


def _strings(length: int, most: int):
    """The strings of a bucket's stretches, about `most` at a time, those of one anchor together."""

    def run(rows: list[dict]) -> Iterator[R.Entries]:
        if not rows:
            return
        e = R.Entries.join([R.unpacked(r, STRETCH[:1]) for r in rows])
        data = np.frombuffer(b"".join(R.expand(r["raw"], r["size"]) for r in rows), np.uint8)
        size = e.n.astype(np.int64) + length - 1
        start = np.cumsum(size) - size
        order = np.argsort(e.keys[0], kind="stable")
        new = np.flatnonzero(np.diff(e.keys[0][order], prepend=H.U(0)))
        total = np.cumsum(e.n[order].astype(np.int64))
        lo = 0
        while lo < len(order):
            # Whole anchors, up to `most` strings.
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right"))
            ends = new[new > lo]
            near = int(np.searchsorted(ends, hi, "right"))
            hi = len(order) if hi >= len(order) else int(ends[max(0, near - 1)]) if len(ends) else len(order)
            part = order[lo:hi]
            lo = hi
            count = e.n[part].astype(np.int64)
            held = data[_each(start[part], size[part])]
            begin = np.cumsum(size[part]) - size[part]
            at = _each(begin, count)
            text = np.repeat(part, count)
            pos = e.pos[text] + (at - np.repeat(begin, count)).astype("i4")
            one, two = H.slices(H.prefix(held), at, at + length), H.slices(H.prefix(held, 1), at, at + length)
            yield R.Entries([one, two], e.ids[text], pos, np.ones(len(at), "u1"), e.to[text], None if e.rows is None else e.rows[text])

    return run


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                out = []
                for text, marks in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    kept, spans = raw, 0
                    if marks:
                        pos, n, _ = R.unpack(marks)
                        edge = np.zeros(len(raw) + 1, np.int64)
                        np.add.at(edge, pos, 1)
                        np.add.at(edge, pos + n.astype(np.int64) - 1 + length, -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        spans = int((np.diff(gone.view(np.int8), prepend=0) == 1).sum())
                        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    out.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                cols = [batch.column(1), *[pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)]]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)."""
    if not 8 * TOKENS <= length <= 254:
        raise ValueError(f"length: from {8 * TOKENS} to 254")
    texts, own = R.rows_to_compare(docs)
    buckets = buckets_for(docs, PER_BUCKET)
    ranges = Ranges(_sample(texts, length, buckets, input_bytes(docs)), buckets)
    first = R.replies(texts.mapInArrow(_anchors(length, ranges, own), R.ENTRY), R.in_other_document, LEADING)
    marked = R.only_marked(R.by_row(texts, first))
    second = R.replies(marked.mapInArrow(_whole_stretches(length, ranges, own), R.ENTRY), R.later_document_or_kind, STRETCH)
    marked = R.only_marked(R.by_row(texts, second))
    third = R.replies(marked.mapInArrow(_kinds(length, ranges, own), R.ENTRY), R.later_document, STRETCH[:1], _strings(length, R.FLUSH))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return R.by_row(texts, third).mapInArrow(_remove(length), schema)
