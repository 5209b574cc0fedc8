"""Near-duplicate groups by min-max hashing, banding and exact confirmation.

A text is the set of its distinct runs of `k` words. Each of `PERMUTATIONS` hash
functions gives the least and the greatest hash of the set, two values of a
signature for one evaluation, both equal for two sets with a chance of their
Jaccard similarity. Bands of `ROWS` values are bucket keys; sets of similarity
0.8 share none of `BANDS` buckets with a chance of 0.59 ** 20 = 3e-5.

Texts of equal sets form a class; one of its rows stands for it, so copies cost
one row each. In a bucket, all classes are compared with one of them, its hub,
which joins a large group of near copies in one pass. What is left are buckets of
several components; there the members outside the largest component are compared
with it and with each other. Both steps deal members to blocks of bounded size,
and a block is compared inside a task that only links leave: no pairs are
written, a group of n copies and a few strays costs about n rows, and no link
between components is lost. Confirmation compares the full sets, by 64-bit hashes
of their members.

Defined results: a text without words has no shingles and is its own component;
a text of fewer than `k` words has one; rows that share an id are judged by their
own texts, and each gets the smallest id of its own component; a row without id
is linked with none and kept, with a null component; an empty table gives an
empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import cut, fit_broadcast, ids_repeat, keyed

BANDS, ROWS = 20, 4
PERMUTATIONS = BANDS * ROWS // 2
#: Ids that may be broadcast to pick the texts of candidates: 16 bytes each.
BROADCAST_IDS = 1_000_000
#: Buckets of more members than this are joined by broadcast, if there are at most so many.
HEAVY, BROADCAST_BUCKETS = 1000, 100_000
#: Members in one side of a block at most on average, and their shingles.
BLOCK, BLOCK_SHINGLES = 1000, 1 << 20
_A = H.ODD[:PERMUTATIONS]
_S = H.mix(H.ODD[PERMUTATIONS : 2 * PERMUTATIONS])


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after another, and where each text's begin."""
    low = H.lower_ascii(data)
    starts, ends, first = H.words(low, offsets)
    h = H.slices(H.prefix(low), starts, ends)
    n = np.diff(first)
    run = H.runs(h, k)
    owner = np.repeat(np.arange(len(n)), np.maximum(0, n - k + 1))
    at = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(0, n - k + 1)) - np.maximum(0, n - k + 1), np.maximum(0, n - k + 1))
    made = run[first[:-1][owner] + at]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        short = np.array([H.runs(h[first[i] : first[i + 1]], int(n[i]))[0] for i in few], H.U)
        owner, made = np.concatenate([owner, few]), np.concatenate([made, short])
    order = np.lexsort((made, owner))
    owner, made = owner[order], made[order]
    fresh = np.ones(len(made), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (made[1:] != made[:-1])
    owner, made = owner[fresh], made[fresh]
    return made, np.searchsorted(owner, np.arange(len(n) + 1))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(node, doc_id, n_shingles, k1, k2, bands) of every row of (node, doc_id, text); k1 and k2 digest the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in H.chunks(batch, 2):
                made, begin = shingles(data, offsets, k)
                size = np.diff(begin)
                has = size > 0
                keys = np.zeros((2, hi - lo), H.U)
                bands = np.zeros((hi - lo, BANDS), H.U)
                if has.any():
                    at = begin[:-1][has]
                    for row in range(2):
                        keys[row, has] = np.add.reduceat(H.mix(made ^ H.ODD[-1 - row]), at)
                    for p in range(PERMUTATIONS):
                        x = (made ^ _S[p]) * _A[p]
                        x = (x ^ (x >> H.U(29))) * H.U(0xBF58476D1CE4E5B9)
                        x ^= x >> H.U(32)
                        # The two values go to different bands, so a band never has both.
                        band = p % BANDS
                        bands[has, band] = H.mix(bands[has, band] + np.minimum.reduceat(x, at))
                        band = (p + BANDS // 2) % BANDS
                        bands[has, band] = H.mix(bands[has, band] + np.maximum.reduceat(x, at))
                    bands[has] = H.mix(bands[has] ^ H.ODD[:BANDS])
                flat = pa.array(bands[has].reshape(-1).view(np.int64))
                ends = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype("i4")
                cols = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(size.astype("i8")), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), flat)]
                yield pa.RecordBatch.from_arrays(cols, ["node", "doc_id", "n_shingles", "k1", "k2", "bands"])
        H.release()

    return docs.select("node", "doc_id", "text").mapInArrow(run, "node bigint, doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of the edges (a, b); nodes of one component share a root.

    Each round maps a node to the neighbour of least hash, itself included, and
    the edges with it; hashed order makes the number of rounds logarithmic.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    edges = cut(edges.select("a", "b").filter("a <> b").distinct())
    labels = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        to = cut(least.select(F.col("a").alias("old"), F.least(F.col("m"), order("a"))["id"].alias("new")))
        labels = labels.join(to, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
        moved = edges.join(to, F.col("a") == F.col("old")).select(F.col("new").alias("a"), "b").join(to, F.col("b") == F.col("old")).select("a", F.col("new").alias("b"))
        edges = cut(moved.filter("a <> b").distinct())
    return cut(labels)


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the components that the links join have become one."""
    side = lambda end, name: labels.select(F.col("node").alias(end), F.col("root").alias(name))
    merged = components(links.join(side("a", "ra"), "a").join(side("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    renamed = merged.select(F.col("node").alias("_old"), F.col("root").alias("_new"))
    return cut(labels.join(renamed, F.col("root") == F.col("_old"), "left").select("node", F.coalesce("_new", "root").alias("root")))


def _shares(n: Column, weight: Column) -> Column:
    """In how many blocks `n` members of so many shingles go."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(weight / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _share_of(rep: str, shares: Column) -> Column:
    return F.pmod(F.xxhash64(rep), shares).cast("int")


def _links(dealt: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between members of a block of different roots, one at most for each two roots.

    `dealt`: (block, side, rep, root, share). Members of side 0 are compared with
    those of side 1, members of side 2 with each other; of two shares, each member
    with the other share's. A block is compared inside one task, and only links
    leave it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            keys = np.asarray(batch.column(0))
            cuts = np.flatnonzero(np.diff(keys) != 0) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if lo == hi:
                    continue
                if at is not None and at != keys[lo]:
                    yield _block_links(held, k, percent)
                    held = []
                at = keys[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield _block_links(held, k, percent)
        del held
        H.release()

    full = dealt.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep").select("block", "side", "rep", "root", "share", "text")
    return full.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a bigint, b bigint").distinct()


def _block_links(held: list[pa.RecordBatch], k: int, percent: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    side, rep, root, share = (np.asarray(table.column(c).combine_chunks()) for c in (1, 2, 3, 4))
    sets: list[np.ndarray] = []
    for part in table.select(["text"]).to_batches():
        for _, _, data, offsets in H.chunks(part, 0):
            made, begin = shingles(data, offsets, k)
            sets += np.split(made, begin[1:-1])
    # Those that others are held against first: side 0, or large components of side 2, each member of another against all before its own.
    _, group, size = np.unique(root, return_inverse=True, return_counts=True)
    order = np.lexsort((group, -size[group], side))
    side, rep, group, share = side[order], rep[order], group[order], share[order]
    apart = bool((share != share[0]).any())
    sets = [sets[x] for x in order]
    n = np.array([len(x) for x in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, H.U)
    starts = np.cumsum(n) - n
    first = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(side, prepend=-1) != 0))
    own = first[np.searchsorted(first, np.arange(len(n)), "right") - 1]
    tops = np.where(side == 1, int((side == 0).sum()), np.where(side == 2, own, 0))
    # One link joins two roots: pairs of roots that links of this block joined already are passed over.
    joined = np.arange(group.max(initial=-1) + 1)
    found = []
    for x in range(len(n)):
        top = tops[x]
        near = (100 * np.minimum(n[:top], n[x]) >= percent * np.maximum(n[:top], n[x])) & (joined[group[:top]] != joined[group[x]])
        if apart:
            near &= share[:top] != share[x]
        if not near.any():
            continue
        value = flat[: starts[top]] if top < len(n) else flat
        place = np.searchsorted(sets[x], value)
        place[place == n[x]] = 0
        shared = np.add.reduceat((sets[x][place] == value).astype(np.int64), starts[:top])
        good = np.flatnonzero(near & (100 * shared >= percent * (n[:top] + n[x] - shared)))
        for y in good[np.unique(joined[group[good]], return_index=True)[1]]:
            found.append((int(min(rep[x], rep[y])), int(max(rep[x], rep[y]))))
            joined[joined == joined[group[y]]] = joined[group[x]]
    return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])


def _with_hubs(members: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Blocks (block, side, rep, root, share) of each hub and the members of its buckets that may be similar, by size."""
    near = 100 * F.least("n_shingles", "hub_n") >= percent * F.greatest("n_shingles", "hub_n")
    pairs = cut(_in_buckets(members, hubs).filter((F.col("rep") != F.col("hub")) & near).select("hub", "hub_n", "rep", "n_shingles").distinct())
    sizes = pairs.groupBy("hub").agg(_shares(F.count(F.lit(1)), F.sum("n_shingles")).alias("shares"))
    heavy = sizes.filter("shares > 1")  # a hub of one block needs no look-up
    spread = pairs.join(fit_broadcast(heavy, BROADCAST_IDS), "hub", "left").withColumn("share", _share_of("rep", F.coalesce("shares", F.lit(1))))
    block = F.xxhash64("hub", "share")
    others = spread.select(block.alias("block"), F.lit(1).alias("side"), "rep", F.col("rep").alias("root"), F.lit(1).alias("share"))
    one = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    return others.unionByName(one.select(block.alias("block"), F.lit(0).alias("side"), F.col("hub").alias("rep"), F.col("hub").alias("root"), F.lit(0).alias("share")))


def _across(members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Blocks (block, side, rep, root, share) in which members of one bucket and different components meet.

    The largest component of a bucket is dealt against the others, and the others
    against each other, so a group of copies and a few strays costs a row for each
    copy. Of the largest, only sizes that can match one of the others count.
    """
    held = members.join(labels, F.col("rep") == F.col("node")).select("bucket", "heavy", "rep", "n_shingles", "root")
    per_root = held.groupBy("bucket", "heavy", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"), F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    top = per_root.groupBy("bucket", "heavy").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    open_ = cut(per_root.join(top, ["bucket", "heavy"]).groupBy("bucket", "heavy", "main").agg(
        F.sum(F.when(F.col("root") != F.col("main"), F.col("n"))).alias("n"), F.sum(F.when(F.col("root") != F.col("main"), F.col("w"))).alias("w"),
        F.sum(F.when(F.col("root") == F.col("main"), F.col("n"))).alias("main_n"), F.sum(F.when(F.col("root") == F.col("main"), F.col("w"))).alias("main_w"),
        F.min(F.when(F.col("root") != F.col("main"), F.col("low"))).alias("low"), F.max(F.when(F.col("root") != F.col("main"), F.col("high"))).alias("high"),
    ).select("bucket", "heavy", "main", "low", "high", _shares(F.col("n"), F.col("w")).alias("parts"), _shares(F.col("main_n"), F.col("main_w")).alias("main_parts")))
    rows = _in_buckets(held, open_)
    is_main = F.col("root") == F.col("main")
    main = rows.filter(is_main & (100 * F.col("n_shingles") >= percent * F.col("low")) & (100 * F.col("high") >= percent * F.col("n_shingles")))
    main = main.withColumn("i", _share_of("rep", F.col("main_parts"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = rows.filter(~is_main).withColumn("mine", _share_of("rep", F.col("parts")))
    against = rest.withColumn("j", F.col("mine")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("main_parts") - 1)))
    # The others among themselves: a grid of pairs of shares; a block of two shares holds both once.
    among = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    among = among.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    block = lambda kind: F.xxhash64("bucket", "i", "j", F.lit(kind)).alias("block")
    shown = lambda df, kind, side, share: df.select(block(kind), F.lit(side).alias("side"), "rep", "root", share.alias("share"))
    both = shown(main, "main", 0, F.lit(0)).unionByName(shown(against, "main", 1, F.lit(1)))
    return both.unionByName(shown(among, "rest", 2, F.col("mine")))


def _in_buckets(rows: DataFrame, side: DataFrame) -> DataFrame:
    """`rows` joined with one row of `side` for each bucket; buckets of many rows, which are few, by broadcast."""
    heavy = side.filter("heavy").drop("heavy")
    light = side.filter("NOT heavy").drop("heavy")
    return rows.filter("heavy").join(fit_broadcast(heavy, BROADCAST_BUCKETS), "bucket").unionByName(rows.filter("NOT heavy").join(light, "bucket"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, unique: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of (doc_id, text); `unique`: ids are known to be unique and not null."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if not unique and ids_repeat(rows):
        made, key = keyed(rows)
        rows = made.select(F.col(key).alias("node"), "doc_id", "text")
    else:
        rows = rows.select(F.col("doc_id").alias("node"), "doc_id", "text")
    signed = cut(signatures(rows, k))
    classes = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2", "n_shingles")
    classes = cut(classes.agg(F.min("node").alias("rep"), F.min("doc_id").alias("least"), F.first("bands").alias("bands")))
    in_bands = classes.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    sizes = cut(in_bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", (F.col("n") > HEAVY).alias("heavy")))
    heavy = fit_broadcast(sizes.filter("heavy"), BROADCAST_BUCKETS)
    light = in_bands.join(heavy.select("bucket"), "bucket", "left_anti").join(sizes.filter("NOT heavy"), "bucket")
    members = cut(in_bands.join(heavy, "bucket").unionByName(light).select("bucket", "heavy", "rep", "n_shingles"))
    wanted = cut(members.select(F.col("rep").alias("doc_id")).distinct())
    texts = cut(rows.select(F.col("node").alias("doc_id"), "text").join(fit_broadcast(wanted, BROADCAST_IDS), "doc_id", "left_semi"))
    labels = wanted.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("root"))
    # First the member of smallest key of each bucket against the others: a large group of near copies joins here.
    hub = members.groupBy("bucket", "heavy").agg(F.min(F.struct("rep", "n_shingles")).alias("hub"))
    hubs = hub.select("bucket", "heavy", F.col("hub.rep").alias("hub"), F.col("hub.n_shingles").alias("hub_n"))
    labels = _joined(labels, _links(_with_hubs(members, hubs, percent), texts, k, percent))
    # Then the members of buckets that still hold several components.
    across = cut(_across(members, labels, percent))
    if not across.isEmpty():
        labels = _joined(labels, _links(across, texts, k, percent))
    by_rep = labels.join(classes.select(F.col("rep").alias("node"), "least"), "node")
    least = by_rep.groupBy("root").agg(F.min("least").alias("component"))
    named = by_rep.select("node", "root").join(least, "root").select(F.col("node").alias("rep"), "component")
    by_class = classes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("n_shingles").alias("n"), "rep", "least")
    by_class = by_class.join(named, "rep", "left").select("c1", "c2", "n", F.coalesce("component", "least").alias("component"))
    same = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n_shingles") == F.col("n"))
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(by_class, same, "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("bigint")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
