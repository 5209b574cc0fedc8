"""Language ID: scripts narrow the languages, Viterbi labels the words.

A letter n-gram model gives each word a log score under each language. The
Unicode script of a word leaves only the languages that are written in it, and a
Viterbi pass over the words with a penalty for each switch labels spans of one
language. A document's language is the one with most letters; its score is the
share of letters with that label. Ties go to the first language by name.

The model is fitted on at most about `sample_rows` labelled rows, chosen by a
hash of the id, and has `2 * BUCKETS` numbers for each language.

Defined results: a text that is null or has no letters is `und` with score 0, as
is every text if no row is labelled; repeated rows are judged row by row; a row
without id is held out of nothing known, so `held_out` is null, it is not learnt
from, and it is predicted like any other; an empty table gives an empty one;
language, source and id never enter a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
SAMPLE_ROWS = 30_000
SWITCH = 8.0
#: First code points of Unicode ranges and their scripts.
SCRIPTS = [
    (0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"),
    (0x900, "devanagari"), (0x980, "other"), (0xE00, "thai"), (0xE80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
]
NAMES = sorted({name for _, name in SCRIPTS})
#: A language is written in a script that has this share of its letters.
WRITTEN = 0.02
_TABLES: dict = {}


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def _letters():
    """Which code points are letters."""
    import numpy as np

    if "letters" not in _TABLES:
        _TABLES["letters"] = np.array([chr(c).isalpha() for c in range(0x110000)])
        _TABLES["bounds"] = np.array([lo for lo, _ in SCRIPTS])
        _TABLES["scripts"] = np.array([NAMES.index(name) for _, name in SCRIPTS])
    return _TABLES["letters"]


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _runs(texts: list[str | None]):
    """Of texts joined: text starts, word starts and ends, the text of each word, two buckets a letter, the script of each word."""
    import numpy as np

    low = [_lower(t) if t else "" for t in texts]
    code = np.frombuffer(("\n" + "".join(t + "\n" for t in low)).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 1 for t in low], np.int64)
    begin = 1 + np.cumsum(sizes) - sizes
    is_letter = _letters()[code]
    edge = np.flatnonzero(np.diff(is_letter.view(np.int8)))
    starts, ends = edge[::2] + 1, edge[1::2] + 1
    owner = np.searchsorted(begin, starts, "right") - 1
    c = np.where(is_letter, code, 0).astype(np.uint64)
    at = np.flatnonzero(is_letter)
    two = c[at - 1] * np.uint64(0x9E3779B1) + c[at] * np.uint64(0x85EBCA77)
    three = two + c[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F)
    mix = lambda h: ((h ^ (h >> np.uint64(17))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(50)).astype(np.int64)  # noqa: E731  14 bits
    script = _TABLES["scripts"][np.searchsorted(_TABLES["bounds"], code[starts], "right") - 1]
    return begin, starts, ends, owner, mix(two), mix(three), script


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language and bucket; buckets from 2 * BUCKETS on are scripts."""
    import numpy as np

    for batch in batches:
        langs, which = np.unique(np.array(batch.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
        texts = batch.column(1).to_pylist()
        width = 2 * BUCKETS + len(NAMES)
        total = np.zeros((len(langs), width), np.int64)
        for lo in range(0, len(texts), 500):
            _, starts, ends, owner, two, three, script = _runs(texts[lo : lo + 500])
            if not len(starts):
                continue
            size = ends - starts
            lang = which[lo : lo + 500][owner]
            each = np.repeat(lang, size) * width
            total += np.bincount(np.concatenate([each + two, each + BUCKETS + three]), minlength=total.size).reshape(total.shape)
            np.add.at(total, (lang, 2 * BUCKETS + script), size)
        row, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(langs[row].tolist(), pa.string()), pa.array(bucket, pa.int32()), pa.array(total[row, bucket], pa.int64())], ["lang", "bucket", "n"])


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """A model from rows of (doc_id, text, lang); languages, log scores and scripts."""
    import numpy as np

    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    total = rows.count()
    if total > sample_rows:
        # Rows with the smallest hashes, about `sample_rows` of them.
        rows = rows.filter(F.xxhash64("doc_id").cast("double") < -(2.0**63) + 2.0**64 * sample_rows / total)
    counts = rows.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # at most 2 * BUCKETS + len(NAMES) rows for each language
    langs = sorted(found["lang"].unique())
    table = np.zeros((len(langs), 2 * BUCKETS + len(NAMES)))
    table[[langs.index(x) for x in found["lang"]], found["bucket"]] = found["n"]
    logs = []
    for lo in (0, BUCKETS):
        part = table[:, lo : lo + BUCKETS] + 0.5
        logs.append(np.log(part / part.sum(1, keepdims=True)).T.astype("f4"))
    script = table[:, 2 * BUCKETS :]
    written = script >= WRITTEN * np.maximum(1, script.sum(1, keepdims=True))
    written[:, ~written.any(0)] = True  # a script of no language narrows nothing
    return {"langs": langs, "two": logs[0], "three": logs[1], "written": written.T}


def _viterbi(scores, counts, switch: float):
    """The best label of each word; `counts` are the words of each text, in order."""
    import numpy as np

    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    first = (np.cumsum(counts) - counts)[order]
    steps = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(steps), "left")  # texts of more than t words
    stay = np.ones(scores.shape, bool)
    best = np.zeros(len(scores), np.int64)
    value = np.zeros((len(sizes), scores.shape[1]), np.float32)
    last = np.zeros(len(sizes), np.int64)
    for t in range(steps):
        n = live[t]
        at = first[:n] + t
        v = value[:n]
        if t:
            top = v.argmax(1)
            moved = v[np.arange(n), top][:, None] - np.float32(switch)
            keep = v >= moved
            stay[at], best[at] = keep, top
            v = np.where(keep, v, moved)
        v = v + scores[at]
        value[:n] = v - v.max(1, keepdims=True)
        done = live[t + 1] if t + 1 < steps else 0
        last[done:n] = value[done:n].argmax(1)
    labels = np.zeros(len(scores), np.int64)
    state = last
    for t in range(steps - 1, -1, -1):
        n = live[t]
        at = first[:n] + t
        s = state[:n]
        labels[at] = s
        state[:n] = np.where(stay[at, s], s, best[at])
    return labels


def predict(docs: DataFrame, model: dict, switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of (doc_id, text); spans are of code points, end exclusive."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 * BUCKETS numbers a language
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        m = held.value
        langs = m["langs"]
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                pred, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
                offsets = np.zeros(batch.num_rows + 1, np.int32)
                pieces = [np.zeros(0, np.int32), np.zeros(0, np.int32), []]
                begin, starts, ends, owner, two, three, script = _runs(batch.column(1).to_pylist())
                if langs and len(starts):
                    size = ends - starts
                    edge = np.cumsum(size) - size
                    scores = np.empty((len(starts), len(langs)), np.float32)
                    for k in range(len(langs)):  # a column at a time keeps memory small
                        scores[:, k] = np.add.reduceat(m["two"][two, k] + m["three"][three, k], edge)
                    scores[~m["written"][script]] -= 1e4
                    counts = np.bincount(owner, minlength=batch.num_rows)
                    labels = _viterbi(scores, counts, switch)
                    mass = np.bincount(owner * len(langs) + labels, weights=size, minlength=batch.num_rows * len(langs)).reshape(-1, len(langs))
                    has = counts > 0
                    top = mass.argmax(1)
                    score[has] = mass[has, top[has]] / mass[has].sum(1)
                    pred = [langs[k] if h else "und" for k, h in zip(top, has, strict=True)]
                    new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
                    stop = np.append(new[1:], len(owner)) - 1
                    base = begin[owner[new]]
                    pieces = [(starts[new] - base).astype("i4"), (ends[stop] - base).astype("i4"), [langs[k] for k in labels[new]]]
                    offsets[1:] = np.cumsum(np.bincount(owner[new], minlength=batch.num_rows))
                spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(pieces[0], pa.int32()), pa.array(pieces[1], pa.int32()), pa.array(pieces[2], pa.string())], fields=list(span)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), spans], ["doc_id", "lang_pred", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def language_id(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The contract's rows: fitted on the rows that aren't held out, predicted for all."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), sample_rows)
    found = predict(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
