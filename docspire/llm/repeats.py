"""Repeated runs of words or bytes over all texts: what operators 3 and 4 share.

Finding repeats takes rounds of one kind. Workers send entries (keys, document,
position) to buckets, packed into one row for each bucket and worker batch; a
bucket compares its entries and replies with positions, which go back to their
rows. A worker first compares the entries it has itself and sends one document's
of each key, so a key that is everywhere reaches its bucket once a worker batch
and not once a document. The number of buckets follows the input, so each stays
of bounded size.

Entries are ordered by multikey quicksort over their keys: all by the first, and
only runs of equals by the next.

Texts are shuffled once: every round joins the same exchange, by a key of each
row. That key is the id if no id repeats; else rows have keys of their own, which
travel beside the ids that are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import ids_repeat, keyed

#: Entries that a worker compares and packs at once: so many, or `PER_BUCKET` for each bucket up to `FLUSH_MOST`.
FLUSH, PER_BUCKET, FLUSH_MOST = 300_000, 32, 2_000_000
#: k entries packed in `body`, and in `rows` the keys of their rows where these aren't the ids; `raw` holds `size` bytes more where a round sends bytes.
ENTRY = "bucket int, done boolean, k int, body binary, rows binary, size int, raw binary"
REPLY = "key bigint, body binary, whole boolean"
_REPLY_FIELDS = [pa.int64(), pa.binary(), pa.bool_()]
_ZSTD = pa.Codec("zstd", 1)


def _planes(x: np.ndarray, most: int = 8) -> bytes:
    """Bytes of equal weight together, which compresses well; the lowest `most` of them."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize)[:, :most].T).tobytes()


def _unplanes(raw: bytes, k: int, size: int, dtype: str) -> np.ndarray:
    out = np.zeros((k, np.dtype(dtype).itemsize), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8, k * size).reshape(size, k).T
    return out.reshape(-1).view(dtype)


def squeeze(raw: bytes) -> bytes:
    return _ZSTD.compress(raw, asbytes=True)


def expand(raw: bytes, size: int) -> bytes:
    return _ZSTD.decompress(raw, decompressed_size=size, asbytes=True) if size else b""


class Entries:
    """Columns of entries: keys, document, position, a number, bucket, and the key of the row if that isn't the document."""

    def __init__(self, keys, ids, pos, n, to, rows=None):
        self.keys, self.ids, self.pos, self.n, self.to, self.rows = keys, ids, pos, n, to, rows

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, at) -> Entries:
        return Entries([k[at] for k in self.keys], self.ids[at], self.pos[at], self.n[at], self.to[at], None if self.rows is None else self.rows[at])

    @staticmethod
    def join(parts: list[Entries]) -> Entries:
        parts = [p for p in parts if len(p)]
        if not parts:
            return Entries([np.zeros(0, H.U)], np.zeros(0, "i8"), np.zeros(0, "i4"), np.zeros(0, "u1"), np.zeros(0, "i4"))
        if len(parts) == 1:
            return parts[0]
        of = lambda c: np.concatenate([getattr(p, c) for p in parts])
        keys = [np.concatenate(ks) for ks in zip(*(p.keys for p in parts), strict=True)]
        return Entries(keys, of("ids"), of("pos"), of("n"), of("to"), None if parts[0].rows is None else of("rows"))

    def places(self) -> Entries:
        """The entries without keys, as finished ones travel."""
        return Entries([], self.ids, self.pos, self.n, self.to, self.rows)


#: Compares entries: returns those to send on (from a worker) or nothing (from a bucket), and replies as (entries, whole) pairs.
Rule = Callable[[Entries], tuple[Entries, list[tuple[Entries, bool]]]]


def _tied(new: np.ndarray) -> np.ndarray:
    """Where a run of two or more stands; `new` marks the first of each run."""
    tied = ~new
    tied[:-1] |= ~new[1:]
    return np.flatnonzero(tied)


def multikey(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of entries by all keys, and which of them in that order start a run of equals."""
    order = np.argsort(keys[0])
    new = np.ones(len(order), bool)
    first = keys[0][order]
    new[1:] = first[1:] != first[:-1]
    for key in keys[1:]:
        at = _tied(new)
        if not len(at):
            break
        sub = order[at]
        value = key[sub]
        by = np.lexsort((value, np.cumsum(new)[at]))
        order[at], value = sub[by], value[by]
        new[at[1:][value[1:] != value[:-1]]] = True
    return order, new


def _groups(e: Entries) -> tuple[Entries, np.ndarray]:
    """Entries in order of keys, document and position, and the first of each group of equal keys."""
    order, new = multikey(e.keys)
    at = _tied(new)
    if len(at):
        sub = order[at]
        order[at] = sub[np.lexsort((e.pos[sub], e.ids[sub], np.cumsum(new)[at]))]
    return e.take(order), new


def _of(new: np.ndarray) -> np.ndarray:
    """The group of each entry."""
    return np.cumsum(new) - 1


def _elsewhere(e: Entries, lead: np.ndarray) -> np.ndarray:
    return (e.ids != e.ids[lead]) | (e.pos != e.pos[lead])


def repeated(e: Entries) -> tuple[Entries, list[tuple[Entries, bool]]]:
    """All entries whose keys occur at two places or more; sends the first."""
    if not len(e):
        return e, []
    e, new = _groups(e)
    first, group = np.flatnonzero(new), _of(new)
    many = np.zeros(len(first), bool)
    many[group[_elsewhere(e, first[group])]] = True
    return e.take(first), [(e.take(many[group]), True)]


def in_other_document(e: Entries) -> tuple[Entries, list[tuple[Entries, bool]]]:
    """All entries whose keys occur in two documents or more; sends the first of these, and all entries of keys of one document."""
    if not len(e):
        return e, []
    e, new = _groups(e)
    first, group = np.flatnonzero(new), _of(new)
    ends = np.append(first[1:], len(e))
    many = e.ids[ends - 1] != e.ids[first]
    sent = ~many[group]
    sent[first] = True
    return e.take(sent), [(e.take(many[group]), True)]


def later_place(e: Entries) -> tuple[Entries, list[tuple[Entries, bool]]]:
    """All entries but the first place of each group, as whole, and the first places that have others, as not whole.

    Sends the first place, with number 2 if it has others.
    """
    if not len(e):
        return e, []
    e, new = _groups(e)
    first, group = np.flatnonzero(new), _of(new)
    lead = first[group]
    later = _elsewhere(e, lead)
    many = np.zeros(len(first), bool)
    many[group[later]] = True
    known = e.n[first] == 2
    n = e.n.copy()
    n[first[many]] = 2
    sent = Entries(e.keys, e.ids, e.pos, n, e.to, e.rows).take(first)
    return sent, [(e.take(later), True), (e.take(first[many | known]), False)]


def later_document(e: Entries) -> tuple[Entries, list[tuple[Entries, bool]]]:
    """All entries beyond the first document of each group; sends that document's."""
    if not len(e):
        return e, []
    e, new = _groups(e)
    first = np.flatnonzero(new)
    later = e.ids != e.ids[first[_of(new)]]
    return e.take(~later), [(e.take(later), True)]


def later_document_or_kind(e: Entries) -> tuple[Entries, list[tuple[Entries, bool]]]:
    """As `later_document`; also those of the first documents, as not whole, where one first key has several second ones."""
    sent, replies = later_document(e)
    if not len(sent):
        return sent, replies
    # `sent` is in order of its keys.
    h, g = sent.keys
    new_h = np.ones(len(sent), bool)
    new_h[1:] = h[1:] != h[:-1]
    kind = np.ones(len(sent), bool)
    kind[1:] = new_h[1:] | (g[1:] != g[:-1])
    of_h = _of(new_h)
    several = np.bincount(of_h[kind], minlength=of_h[-1] + 1) > 1
    return sent, [*replies, (sent.take(several[of_h]), False)]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash. Chosen hashes are the least of many: mixed again, they spread evenly."""
    return ((H.mix(h) >> H.U(32)) * H.U(buckets) >> H.U(32)).astype("i4")


def packed(e: Entries, bucket: int, widths: tuple[int, ...], done: bool = False, raw: bytes | None = None) -> tuple:
    """One row of ENTRY; `widths`: bytes sent of each key. Of finished entries only the places."""
    body = _planes(np.diff(e.ids, prepend=0)) + _planes(np.diff(e.pos, prepend=np.int32(0))) + e.n.tobytes()
    if not done:
        body += b"".join(_planes(k, w) for k, w in zip(e.keys, widths, strict=True))
    rows = b"" if e.rows is None else squeeze(_planes(np.diff(e.rows, prepend=0)))
    return bucket, done, len(e), squeeze(body), rows, len(raw or b""), squeeze(raw) if raw else b""


def unpacked(row: dict, widths: tuple[int, ...]) -> Entries:
    k, done = row["k"], row["done"]
    body = expand(row["body"], k * (13 if done else 13 + sum(widths)))
    ids = np.cumsum(_unplanes(body, k, 8, "i8"))
    pos = np.cumsum(_unplanes(body[8 * k :], k, 4, "i4"), dtype="i4")
    n = np.frombuffer(body[12 * k : 13 * k], np.uint8)
    rows = np.cumsum(_unplanes(expand(row["rows"], 8 * k), k, 8, "i8")) if row["rows"] else None
    keys, at = [], 13 * k
    for w in () if done else widths:
        keys.append(_unplanes(body[at:], k, w, "u8"))
        at += w * k
    return Entries(keys, ids, pos, n, np.full(k, row["bucket"], "i4"), rows)


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
    names = [c.split()[0] for c in ENTRY.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def by_bucket(out: Entries) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices of its entries in order of document and position)."""
    order = np.lexsort((out.pos, out.ids, out.to))
    to = out.to[order]
    cuts = np.flatnonzero(np.diff(to, prepend=-1))
    for lo, hi in zip(cuts, [*cuts[1:], len(to)], strict=False):
        yield int(to[lo]), order[lo:hi]


def done_rows(found: list[Entries], buckets: int) -> list[tuple]:
    """Finished replies travel as a row of any bucket."""
    done = Entries.join([r.places() for r in found])
    if not len(done):
        return []
    done = done.take(np.lexsort((done.pos, done.ids)))
    return [packed(done, int(done.ids[0] * 31 + len(done)) % buckets, (), True)]


def flush_at(buckets: int) -> int:
    return max(FLUSH, min(FLUSH_MOST, PER_BUCKET * buckets))


def send(parts: Iterator[Entries], rule: Rule, widths: tuple[int, ...], buckets: int) -> Iterator[pa.RecordBatch]:
    """Exchange rows of a worker's entries, which it compares by `rule` first; replies that aren't whole are left to the bucket."""
    held: list[Entries] = []

    def flush() -> Iterator[pa.RecordBatch]:
        out, found = rule(Entries.join(held))
        held.clear()
        rows = [packed(out.take(at), bucket, widths) for bucket, at in by_bucket(out)]
        rows += done_rows([r for r, whole in found if whole], buckets)
        if rows:
            yield rows_of(rows)

    size, most = 0, flush_at(buckets)
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= most:
            yield from flush()
            size = 0
    yield from flush()


def _replied(e: Entries, whole: bool) -> pa.Table:
    """A row for each row of the texts."""
    key = e.ids if e.rows is None else e.rows
    order = np.lexsort((e.pos, key))
    key, pos, n = key[order], e.pos[order], e.n[order]
    cuts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    body = [_planes(pos[lo:hi]) + n[lo:hi].tobytes() for lo, hi in zip(cuts, [*cuts[1:], len(key)], strict=True)]
    return pa.table([pa.array(key[cuts]), pa.array(body, pa.binary()), pa.array([whole] * len(cuts))], names=["key", "body", "whole"])


def replies(sent: DataFrame, rule: Rule, widths: tuple[int, ...], parts: Callable[[list[dict]], Iterator[Entries]] | None = None) -> DataFrame:
    """What the buckets reply: for each row the positions and numbers, packed. `parts` cuts a bucket's rows into entries that may be compared apart."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [_replied(unpacked(r, widths), True) for r in rows if r["done"]]
        rows = [r for r in rows if not r["done"]]
        for e in parts(rows) if parts else [Entries.join([unpacked(r, widths) for r in rows])]:
            out += [_replied(x, whole) for x, whole in rule(e)[1] if len(x)]
        empty = pa.table([pa.array([], t) for t in _REPLY_FIELDS], names=["key", "body", "whole"])
        return pa.concat_tables(out) if out else empty

    return sent.groupBy("bucket").applyInArrow(run, REPLY)


def rows_to_compare(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(key, doc_id, text), and whether keys are of rows and not ids."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if ids_repeat(texts):
        made, key = keyed(texts)
        return made.select(F.col(key).alias("key"), "doc_id", "text"), True
    return texts.select(F.col("doc_id").alias("key"), "doc_id", "text"), False


def identified(batch: pa.RecordBatch, own: bool) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray | None]:
    """Rows that have an id, their ids, and their keys if these are others."""
    batch = batch.filter(batch.column(1).is_valid()) if batch.column(1).null_count else batch
    return batch, np.asarray(batch.column(1)).astype("i8"), np.asarray(batch.column(0)).astype("i8") if own else None


def by_row(texts: DataFrame, replied: DataFrame) -> DataFrame:
    """(key, doc_id, text, marks): every row of `texts` with the replies to it, null if it got none."""
    marks = replied.select(F.col("key").alias("_key"), F.struct("body", "whole").alias("mark")).groupBy("_key").agg(F.collect_list("mark").alias("marks"))
    return texts.join(marks.hint("shuffle_hash"), F.col("key") == F.col("_key"), "left").select("key", "doc_id", "text", "marks")


def only_marked(joined: DataFrame) -> DataFrame:
    return joined.select("key", "doc_id", F.when(F.col("marks").isNotNull(), F.col("text")).alias("text"), "marks")


def unpack(marks: list[dict] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, numbers and whole flags of a row's marks."""
    if not marks:
        return np.zeros(0, "i4"), np.zeros(0, "u1"), np.zeros(0, bool)
    sizes = [len(m["body"]) // 5 for m in marks]
    pos = np.concatenate([_unplanes(m["body"], k, 4, "i4") for m, k in zip(marks, sizes, strict=True)])
    n = np.frombuffer(b"".join(m["body"][4 * k :] for m, k in zip(marks, sizes, strict=True)), np.uint8)
    return pos, n, np.repeat([m["whole"] for m in marks], sizes)


#: Neighbours among which `least_of` looks at once; a position must fit 24 bits.
_LEAST_AT_ONCE = 1 << 23


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` neighbours of `h` the index of the least, the first one of equals in the leading 64 - 24 bits."""
    if len(h) > _LEAST_AT_ONCE + width:
        step = _LEAST_AT_ONCE
        return np.concatenate([lo + least_of(h[lo : lo + step + width - 1], width) for lo in range(0, len(h) - width + 1, step)])
    v = (h >> H.U(24) << H.U(24)) | np.arange(len(h), dtype=H.U)
    n, step = max(0, len(h) - width + 1), 1
    while 2 * step <= width:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    low = v[:n]
    if step < width:
        low = np.minimum(low, v[width - step : width - step + n])
    return (low & H.U((1 << 24) - 1)).astype(np.int64)
