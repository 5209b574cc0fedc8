"""Benchmark decontamination by SimHash windows and exact confirmation.

Words are lower-cased; an item of n words is held against windows of n words of
each document (the whole document if it is shorter). Each window has a 64-bit
SimHash of its shingles, weighted by their number. A multi-index of `BLOCKS`
blocks holds the items' fingerprints: two that differ in at most `RADIUS` bits
differ in at most ``RADIUS // BLOCKS`` bits of some block, so each item is entered
under all block values that near, and a window looks up its own. All fingerprints
within the radius are found; a pair of one length meets by chance in one of about
25 cases. Pairs within the radius are confirmed by the weighted (multiset) Jaccard
similarity of their shingles. At 0.8, a pair is within the radius with a chance
of 98 %, at 0.9 of 99.99 %, equal texts always.

Windows that can't match get no fingerprint, by a test that loses none. A text as
similar as asked lacks at most a share ``1 - percent`` of the item's shingles, so
of any ``floor((1 - percent) * m) + 1`` of them it has one; those of least hash
are the item's seeds. A window of the item's size lacks fewer, ``m * (1 - percent)
/ (1 + percent)``, so it holds the rest of the seeds, and every window that does
is taken, wherever in it they stand: the order of an item's parts doesn't matter.

An item of fewer than `SHINGLE` words has no shingle of that size: its whole word
sequence is its only one, and it is found wherever that sequence stands.

Only DataFrame functions are used. Defined results: null and empty texts match
nothing; rows that share an id, or have none, are judged by their own texts and
the best window of an id counts; equal items each match; empty tables give empty
ones; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fit_broadcast, ids_repeat, keyed, let, run_hashes, words

SHINGLE, PERCENT, BITS = 5, 80, 64
RADIUS, BLOCKS = 15, 4
#: Rows up to which seeds, items and ids of documents with seeds are broadcast; beyond, Spark shuffles.
BROADCAST_ROWS = 100_000


def _hashes(text: Column) -> Column:
    """The shingle hashes of a text, in order."""
    return let(words(F.lower(text)), lambda ws: run_hashes(ws, SHINGLE))


def _simhash(window: Column) -> Column:
    """The sign of each bit's weighted sum, packed."""

    def bit(b: Column) -> Column:
        one = lambda acc, h: acc + (F.call_function("getbit", h, b).cast("int") * 2 - 1)
        return F.when(F.aggregate(window, F.lit(0), one) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), bit), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def _blocks(hash_: Column) -> Column:
    width = BITS // BLOCKS
    return F.array(*[F.struct(F.lit(b).alias("no"), F.shiftrightunsigned(hash_, b * width).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for b in range(BLOCKS)])


def _nearby() -> list[int]:
    """What a block may differ by: all patterns of at most ``RADIUS // BLOCKS`` bits."""
    bits = range(BITS // BLOCKS)
    return [sum(1 << b for b in chosen) for k in range(RADIUS // BLOCKS + 1) for chosen in combinations(bits, k)]


def _shared(a: Column, b: Column) -> Column:
    """How many members two multisets share: both in one order, run by run."""
    tag = lambda xs, side: F.transform(xs, lambda x: F.struct(x.alias("h"), F.lit(side).alias("side")))
    start = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        same = acc["h"].eqNullSafe(x["h"])
        own = lambda name, side: F.when(same, acc[name]).otherwise(F.lit(0)) + F.when(x["side"] == side, F.lit(1)).otherwise(F.lit(0))
        done = acc["n"] + F.when(same, F.lit(0)).otherwise(F.least(acc["a"], acc["b"]))
        return F.struct(x["h"].alias("h"), own("a", 0).alias("a"), own("b", 1).alias("b"), done.alias("n"))

    return F.aggregate(F.sort_array(F.concat(tag(a, 0), tag(b, 1))), start, step, lambda acc: acc["n"] + F.least(acc["a"], acc["b"]))


def _starts(ps: Column, m: Column, n: Column, least: Column) -> Column:
    """Starts of the windows of `m` shingles of `n` that hold `least` or more of the sorted places `ps`.

    A start belongs to the first place at or after it, so no start comes twice.
    """

    def of(i: Column) -> Column:
        low = F.greatest(F.coalesce(F.get(ps, i - 1) + 1, F.lit(0)), F.get(ps, i + least - 1) - m + 1)
        high = F.least(F.get(ps, i), n - m)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    many = F.when(F.size(ps) < least, F.array().cast("array<int>")).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.size(ps) - least), of)))
    return F.when(n <= m, F.array(F.lit(0))).otherwise(many)


def _of_shingles(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, similarity) of all windows that match an item of `SHINGLE` words or more."""
    items = benchmark.select("item_id", _hashes(F.col("text")).alias("own")).filter(F.size("own") > 0)
    items = cut(items.select("item_id", "own", F.size("own").alias("m"), _simhash(F.col("own")).alias("print")))
    spare = F.floor(F.col("m") * F.lit((100 - PERCENT) / 100)).cast("int")
    seeds = cut(items.select("m", F.explode(F.slice(F.sort_array("own"), F.lit(1), spare + 1)).alias("h")).distinct())
    hashed = docs.select("doc_id", F.posexplode(_hashes(F.col("text"))).alias("p", "h"))
    hits = hashed.join(fit_broadcast(seeds, BROADCAST_ROWS), "h").groupBy("doc_id", "m").agg(F.sort_array(F.collect_set("p")).alias("ps"))
    # A row for each document that holds a seed; its places are no more than its words for each length.
    places = cut(hits.groupBy("doc_id").agg(F.collect_list(F.struct("m", "ps")).alias("places")))
    near = cut(docs.join(fit_broadcast(places.select("doc_id"), BROADCAST_ROWS), "doc_id", "left_semi").select("doc_id", _hashes(F.col("text")).alias("all")))
    at = near.join(places.hint("merge"), "doc_id").select("doc_id", "all", F.explode("places").alias("at")).select("doc_id", "all", "at.*")
    least = spare + 1 - F.floor(F.col("m") * (100 - PERCENT) / (100 + PERCENT)).cast("int")
    starts = _starts(F.col("ps"), F.col("m"), F.size("all"), least)
    prints = F.transform(starts, lambda s: F.struct(s.alias("s"), let(F.slice("all", s + 1, F.col("m")), _simhash).alias("print")))
    windows = cut(at.select("doc_id", "m", F.explode(prints).alias("x")).select("doc_id", "m", "x.*"))
    # Equal windows, as of copies, are looked up once.
    asked = windows.select("m", "print").distinct().select("m", "print", F.explode(_blocks(F.col("print"))).alias("block")).select("m", "print", "block.*")
    indexed = items.select("item_id", "m", F.col("print").alias("item_print"), F.explode(_blocks(F.col("print"))).alias("block")).select("item_id", "m", "item_print", "block.*")
    indexed = indexed.withColumn("value", F.explode(F.transform(F.array(*map(F.lit, _nearby())), lambda x: x.cast("bigint").bitwiseXOR(F.col("value")))))
    within = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS
    # The index has thousands of rows for each item, which Spark doesn't foresee: it is never broadcast.
    found = cut(asked.join(indexed.hint("merge"), ["m", "no", "value"]).filter(within).select("m", "print", "item_id").distinct())
    pairs = windows.join(fit_broadcast(found, BROADCAST_ROWS), ["m", "print"]).select("doc_id", "m", "s", "item_id")
    held = pairs.join(near.select("doc_id", "all"), "doc_id").withColumn("window", F.slice("all", F.col("s") + 1, F.col("m")))
    held = held.join(fit_broadcast(items.select("item_id", "own"), BROADCAST_ROWS, F.size("own")), "item_id")
    scored = held.select("doc_id", "item_id", "s", (F.size("window") + F.size("own")).alias("both"), _shared(F.col("own"), F.col("window")).alias("shared"))
    good = scored.filter(100 * F.col("shared") >= PERCENT * (F.col("both") - F.col("shared")))
    return good.select("doc_id", "item_id", F.col("s").alias("start"), (F.col("shared") / (F.col("both") - F.col("shared"))).alias("similarity"))


def _of_sequences(docs: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """The same for items of fewer words; None if there are none."""
    items = benchmark.select("item_id", words(F.lower("text")).alias("own")).filter((F.size("own") > 0) & (F.size("own") < SHINGLE))
    whole = F.coalesce(*[F.when(F.size("own") == m, F.get(run_hashes(F.col("own"), m), F.lit(0))) for m in range(1, SHINGLE)])
    items = cut(items.select("item_id", "own", F.size("own").alias("m"), whole.alias("h")))
    sizes = sorted(r["m"] for r in items.select("m").distinct().collect())  # fewer than SHINGLE numbers
    if not sizes:
        return None

    def grams(ws: Column) -> Column:
        of = lambda m: F.transform(run_hashes(ws, m), lambda h, i: F.struct(F.lit(m).alias("m"), h.alias("h"), i.alias("start"), F.slice(ws, i + 1, m).alias("gram")))
        return F.flatten(F.array(*[of(m) for m in sizes]))

    at = docs.select("doc_id", F.explode(let(words(F.lower("text")), grams)).alias("x")).select("doc_id", "x.*")
    found = at.join(fit_broadcast(items, BROADCAST_ROWS), ["m", "h"]).filter(F.col("gram") == F.col("own"))
    return found.select("doc_id", "item_id", "start", F.lit(1.0).alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, unique: bool = False) -> DataFrame:
    """(doc_id, item_id, start, similarity): the best window of each document and item that match; `unique`: ids are known to be unique and not null."""
    rows, ids = docs.select("doc_id", "text"), None
    if not unique and ids_repeat(rows):
        made, key = keyed(rows)
        rows, ids = made.select(F.col(key).alias("doc_id"), "text"), made.select(F.col(key).alias("key"), F.col("doc_id").alias("own_id"))
    found, short = _of_shingles(rows, benchmark), _of_sequences(rows, benchmark)
    if short is not None:
        found = found.unionByName(short)
    if ids is not None:
        found = found.join(ids, F.col("doc_id") == F.col("key")).select(F.col("own_id").alias("doc_id"), "item_id", "start", "similarity")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", (-F.col("x.start")).cast("bigint").alias("start"), F.round("x.similarity", 6).alias("similarity"))
