"""BPE encoding and decoding by an index of pair occurrences.

The distinct pieces that a worker has not met yet are encoded together: their
symbols form one linked list, each mergeable pair has the list of all its
positions, and a heap holds the active ranks. Ranks are applied in ascending
order, each at all its positions from left to right, and a merge only updates
the lists of its two neighbours. As every merge makes a token of its own, a new
pair never ranks before the one that made it, so one ascending pass is exact.

The file names the vocabulary, merges and normalizer; normalizing, and splitting
of texts with unusual characters, is the library's, merging and joining is ours.

Defined results: a null text is an empty one and has no tokens; repeated rows
are encoded row by row; an empty table gives an empty one. A worker keeps at
most `CACHE` pieces, which bounds its memory whatever the texts.
"""

from __future__ import annotations

import array
import functools
import hashlib
import heapq
import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import hashing as H
from .common import cut

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CACHE = 250_000
#: Characters of text that share one index, and texts that are taken out of a batch at once.
GROUP, SLICE = 2_000_000, 500
#: Texts of other characters than these are split by the library, as regex engines differ there.
UNUSUAL = "[^\\t\\n\\r -~\\u00a1-\\u024f]"


class PairIndexBPE:
    """A tokenizer of the given JSON file's text."""

    def __init__(self, config: str):
        import numpy as np
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(config)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = [self.vocab[a + b] for a, b in merges]
        self.left = [self.vocab[a] for a, _ in merges]
        self.right = [self.vocab[b] for _, b in merges]
        if len(set(self.made)) != len(self.made):
            raise ValueError("two merges make one token: ranks can't be applied in one ascending pass")
        library = Tokenizer.from_str(config)
        self.normalize, self.split_slow = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if split["pattern"]["Regex"] != SPLIT:
            raise ValueError("another splitting pattern")
        kinds = {k: "".join(c for c in map(chr, range(0x250)) if regex.match(f"\\p{{{k}}}", c)) for k in "LN"}
        # The same matches as SPLIT's in lower-case text of usual characters, the frequent case first.
        self.split = re.compile(f"[{kinds['L']}]+|[{kinds['N']}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{kinds['L']}{kinds['N']}]+").findall
        self.unusual = re.compile(UNUSUAL).search
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
        self.bytes = {c: b for b, c in self.letters.items()}
        key = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in merges])
        self.order = np.argsort(key)
        self.keys = key[self.order]
        self.inner = np.array([self.vocab[self.letters[b]] for b in range(256)])
        self.last = np.array([self.vocab[self.letters[b] + self.suffix] for b in range(256)])
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}

    def learn(self, pieces: list[str]) -> None:
        """Encode distinct pieces and keep the results."""
        import numpy as np

        if not pieces:
            return
        raw = [p.encode() for p in pieces]
        sizes = np.array([len(r) for r in raw])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        total = int(ends[-1])
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = np.full(total + 1, -1, np.int64)  # the last one stands for none
        symbols[:total] = self.inner[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        after = np.arange(1, total + 2)
        after[ends - 1] = -1
        before = np.arange(-1, total)
        before[starts] = -1
        places: dict[int, list] = {}
        active: list[int] = []

        def put(at, left, right) -> None:
            """Add the pairs at these positions to the lists of their ranks."""
            key = left << 32 | right
            near = np.searchsorted(self.keys, key)
            near[near == len(self.keys)] = 0
            known = self.keys[near] == key
            rank, at = self.order[near[known]], at[known]
            by = np.argsort(rank, kind="stable")
            rank, at = rank[by], at[by]
            cuts = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, found in zip(rank[cuts].tolist(), np.split(at, cuts[1:]), strict=False):
                if r in places:
                    places[r].append(found)
                else:
                    places[r] = [found]
                    heapq.heappush(active, r)

        first = np.flatnonzero(after[:total] >= 0)
        put(first, symbols[first], symbols[first + 1])
        while active:
            rank = heapq.heappop(active)
            a, b, new = self.left[rank], self.right[rank], self.made[rank]
            lists = places.pop(rank)
            i = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            j = after[i]
            held = (symbols[i] == a) & (symbols[j] == b)
            i, j = i[held], j[held]
            if a == b:  # in a run of one symbol every second pair goes, from the left
                taken, keep = set(), []
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if x not in taken:
                        taken.add(y)
                        keep.append(x)
                i = np.array(keep, np.int64)
                j = after[i]
            if not len(i):
                continue
            symbols[i], symbols[j] = new, -1
            k = after[j]
            after[i] = k
            inside = k >= 0
            before[k[inside]] = i[inside]
            h = before[i]
            left, right = h >= 0, inside
            at = np.concatenate([i[right], h[left]])
            put(at, symbols[at], symbols[after[at]])
        alive = symbols[:total] >= 0
        ids = symbols[:total][alive]
        upto = np.cumsum(alive)[ends - 1].tolist()
        packed, tokens = ids.astype("<u4").tobytes(), [self.tokens[i] for i in ids.tolist()]
        lo = 0
        for piece, hi in zip(pieces, upto, strict=True):
            self.ids[piece] = packed[4 * lo : 4 * hi]
            self.shown[piece] = " ".join(tokens[lo:hi])
            lo = hi

    def keep(self, piece: str, found: list[int], tokens: dict[int, str]) -> None:
        packed = array.array("I", found)
        if sys.byteorder == "big":
            packed.byteswap()
        self.ids[piece] = packed.tobytes()
        self.shown[piece] = " ".join([tokens[i] for i in found])

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text; special tokens are pieces that start with NUL, which no piece of text does."""
        out: list[str] = []
        for n, part in enumerate(self.specials(text) if self.specials else [text]):
            if n % 2:
                out.append("\0" + part)
            elif self.unusual(part):
                # The library shows a piece as one letter for each byte.
                out += [" \0" + bytes([self.bytes[c] for c in shown]).decode() for shown, _ in self.split_slow(self.normalize(part))]
            else:
                out += self.split(part.lower())  # these characters are normal; white space only separates
        return out

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """Little-endian ids and decoded text of each text."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and size < GROUP:
                size += len(texts[hi] or "")
                hi += 1
            group = [self.pieces(t) if t else [] for t in texts[lo:hi]]
            lo = hi
            if len(self.ids) > CACHE:
                self.ids.clear()
                self.shown.clear()
            fresh = set().union(*group).difference(self.ids)
            slow = [p for p in fresh if p[0] == "\0" or p[:2] == " \0"]
            fresh.difference_update(slow)
            fresh.update(p[2:] for p in slow if p[0] == " " and p[2:] not in self.ids)
            self.learn(list(fresh))
            for p in slow:
                if p[0] == " ":
                    self.ids[p], self.shown[p] = self.ids[p[2:]], self.shown[p[2:]]
                else:
                    self.keep(p, [self.special[p[1:]]], self.tokens)
            for x in group:
                yield b"".join(map(self.ids.__getitem__, x)), " ".join(map(self.shown.__getitem__, x))

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


@functools.lru_cache(maxsize=4)
def model(config: str) -> PairIndexBPE:
    """One tokenizer for each worker and file."""
    return PairIndexBPE(config)


def _mapped(docs: DataFrame, path: str, row, schema: str, columns: list[pa.DataType]) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        config = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(config.value)
        H.release()  # what the reading of the file took
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                made = [row(*x) for x in bpe.encode(batch.column(1).to_pylist())]
                cols = [batch.column(0)] + [pa.array([m[k] for m in made], kind) for k, kind in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *[f.split()[0] for f in schema.split(", ")]])
        H.release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


def _digest(ids: bytes, decoded: str) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()


def _whole(ids: bytes, decoded: str) -> tuple[list[int], str]:
    import numpy as np

    return np.frombuffer(ids, "<u4").astype("i4"), decoded


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every document by the tokenizer file at `path`."""
    return _mapped(docs, path, _whole, "ids array<int>, decoded string", [pa.list_(pa.int32()), pa.string()])


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows with `doc_id` and `ids`."""
    with open(path, encoding="utf-8") as f:
        config = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(config.value)
        for batch in batches:
            text = pa.array([bpe.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, written once: they are small, and texts go to Python in small batches."""
    return cut(_mapped(docs, path, _digest, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()]))
