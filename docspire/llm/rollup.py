"""Token counts as rollups that batches of signed changes maintain.

A store is a folder with two tables, a folder for each batch in both:
``log/batch-ID`` has signed rows (doc_id, source, lang, tokenizer, n_tokens,
sign), in `PARTS` parts by a hash of the id, and ``totals/batch-ID`` their sums by
source, language and tokenizer. A count replaces the one of the same document and
tokenizer; a delete takes all of a document back. Only the parts of ids that a
batch changes are read. A batch counts once its totals have Spark's _SUCCESS mark,
so a repeated batch id changes nothing and an unfinished batch is written anew.
Totals are additive: reading them sums a few rows for each batch and never the
documents. `compact` merges the batches so far into one of the live rows, whose
totals are its commit point too; batch ids stay known. One writer commits at a
time.

Defined results: a null text has no tokens and counts as a document; a null
source, language or id is a value of its own; repeated rows of an id count each,
and a later change of that id takes all of them back; an id that a batch both
deletes and counts is counted; an empty batch commits no rows; other columns are
not read.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch, words

LOG = "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint, sign int"
TOTALS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
#: Parts of a log by a hash of the id.
PARTS = 16
_ENCODINGS: dict = {}


def _encoding(ranks: str, pattern: str):
    if ranks not in _ENCODINGS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(str.split, ranks.splitlines())}
        _ENCODINGS[ranks] = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODINGS[ranks]


def counts(docs: DataFrame, tokenizers: dict[str, tuple[str, str] | None]) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens): by words for None, else by (rank file, pattern)."""
    spark = docs.sparkSession
    files = {name: (open(x[0], encoding="utf-8").read(), x[1]) for name, x in tokenizers.items() if x}  # noqa: SIM115
    held = spark.sparkContext.broadcast(files)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", "text", F.size(words(F.col("text"))).cast("bigint").alias("_words"))
    if not files:
        counted = base.select("doc_id", "source", "lang", "_words")
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t or "" for t in batch.column(3).to_pylist()]
                made = []
                for ranks, pattern in held.value.values():
                    encode = _encoding(ranks, pattern).encode_ordinary
                    made.append(pa.array([len(encode(t)) for t in texts], pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 2, 4)), *made], ["doc_id", "source", "lang", "_words", *files])

        schema = "doc_id bigint, source string, lang string, _words bigint, " + ", ".join(f"`{n}` bigint" for n in files)
        counted = base.mapInArrow(run, schema)
    pairs = [F.struct(F.lit(n).alias("tokenizer"), F.col(n if x else "_words").alias("n_tokens")) for n, x in tokenizers.items()]
    return counted.select("doc_id", "source", "lang", F.explode(F.array(*pairs)).alias("x")).select("doc_id", "source", "lang", "x.*")


def _folders(spark: SparkSession, store: str) -> list[str]:
    """Folders of committed batches and of compactions."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{store}/totals")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = [x.getPath() for x in fs.listStatus(path) if x.isDirectory()]
    return sorted(x.getName() for x in done if fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))


def _committed(spark: SparkSession, store: str) -> tuple[list[str], set[str]]:
    """The folders that hold the live rows, and the names of all batches ever committed."""
    names = _folders(spark, store)
    bases = [f"{store}/covers/{n}" for n in names if n.startswith("base-")]
    # A name for each batch.
    covered = {r["name"] for r in spark.read.schema("name string").parquet(*bases).collect()} if bases else set()
    return [n for n in names if n not in covered], {n for n in {*names, *covered} if n.startswith("batch-")}


def _read(spark: SparkSession, store: str, table: str, schema: str) -> DataFrame:
    paths = [f"{store}/{table}/{b}" for b in _committed(spark, store)[0]]
    if not paths:
        return spark.createDataFrame([], schema)
    # Folders of one path each, so the part column is found below each of them.
    out = None
    for path in paths:
        rows = spark.read.schema(schema).option("basePath", path).parquet(path)
        out = rows if out is None else out.unionByName(rows)
    return out


def _part_of(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(PARTS)).cast("int").alias("part")


def _write(spark: SparkSession, store: str, name: str, log: DataFrame) -> None:
    log = log.select("doc_id", "source", "lang", "tokenizer", "n_tokens", F.col("sign").cast("int").alias("sign"), _part_of("doc_id"))
    log.write.mode("overwrite").partitionBy("part").parquet(f"{store}/log/{name}")
    made = spark.read.schema(LOG).option("basePath", f"{store}/log/{name}").parquet(f"{store}/log/{name}")
    sums = made.groupBy("source", "lang", "tokenizer").agg(F.sum("sign").cast("bigint").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
    sums.write.mode("overwrite").parquet(f"{store}/totals/{name}")


def _live(log: DataFrame) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens, k): the rows that no later change took back, and how often."""
    return log.groupBy("doc_id", "source", "lang", "tokenizer", "n_tokens").agg(F.sum("sign").alias("k")).filter("k > 0")


def apply_batch(spark: SparkSession, store: str, batch: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
    """Commit a batch: new or revised counts, as `counts` gives them, and ids to delete. False if it was committed before."""
    name = f"batch-{batch}"
    folders, known = _committed(spark, store)
    if name in known:
        return False
    pairs = upserts.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("tokenizer").alias("_tokenizer")).distinct() if upserts is not None else None
    gone = deletes.select(F.col("doc_id").cast("bigint").alias("_id")).distinct() if deletes is not None else None
    signed = [upserts.withColumn("sign", F.lit(1))] if upserts is not None else []
    if folders and (pairs is not None or gone is not None):
        parts = [x.select(_part_of("_id")).distinct() for x in (pairs, gone) if x is not None]
        touched = sorted({r[0] for x in parts for r in x.collect()})  # at most PARTS numbers
        old = _read(spark, store, "log", f"{LOG}, part int").filter(F.col("part").isin(touched)).drop("part")
        same_id = F.col("doc_id").eqNullSafe(F.col("_id"))
        taken = []
        if gone is not None:
            taken.append(old.join(gone, same_id, "left_semi"))
        if pairs is not None:
            rest = old if gone is None else old.join(gone, same_id, "left_anti")
            taken.append(rest.join(pairs, same_id & F.col("tokenizer").eqNullSafe(F.col("_tokenizer")), "left_semi"))
        for part in taken:
            live = _live(part)
            signed.append(live.select("doc_id", "source", "lang", "tokenizer", "n_tokens", F.explode(F.expr("array_repeat(-1, int(k))")).alias("sign")))
    log = signed[0] if signed else spark.createDataFrame([], LOG)
    for more in signed[1:]:
        log = log.unionByName(more)
    _write(spark, store, name, log)
    return True


def compact(spark: SparkSession, store: str) -> None:
    """Merge all committed batches into one folder of live rows; what it replaces is no longer read."""
    folders, known = _committed(spark, store)
    name = f"base-{uuid.uuid4().hex}"
    live = _live(_read(spark, store, "log", LOG)).select("doc_id", "source", "lang", "tokenizer", "n_tokens", F.explode(F.expr("array_repeat(1, int(k))")).alias("sign"))
    spark.createDataFrame([(n,) for n in sorted({*folders, *known})], "name string").write.mode("overwrite").parquet(f"{store}/covers/{name}")
    _write(spark, store, name, live)


def totals(spark: SparkSession, store: str) -> DataFrame:
    """(source, lang, tokenizer, n_docs, n_tokens) of the documents that the batches left."""
    summed = _read(spark, store, "totals", TOTALS).groupBy("source", "lang", "tokenizer").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return summed.filter("n_docs > 0")


def token_counts(docs: DataFrame, tokenizers: dict[str, tuple[str, str] | None]) -> DataFrame:
    """Totals of a table, by way of a store of its own."""
    spark, store = docs.sparkSession, scratch(docs.sparkSession)
    apply_batch(spark, store, "documents", counts(docs, tokenizers))
    return totals(spark, store)


def token_counts_by_batches(docs: DataFrame, tokenizers: dict[str, tuple[str, str] | None]) -> DataFrame:
    """The same totals, by batches that insert, revise, delete and reinsert a share of the ids each.

    Texts are counted once. The first batch has the first tokenizer alone for a
    share of the ids and counts without tokens for another; the second adds the
    other tokenizers of the one and revises the other; the third deletes a share,
    which the fourth brings back after a compaction; the fourth comes twice, and
    its repetition, without that share's tokens, is refused.
    """
    spark, store = docs.sparkSession, scratch(docs.sparkSession)
    counted = cut(counts(docs, tokenizers))
    share = lambda *n: counted.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)).isin(*n))
    untold = lambda n: share(n).withColumn("n_tokens", F.lit(0).cast("bigint"))
    first = F.col("tokenizer") == next(iter(tokenizers))
    apply_batch(spark, store, "1-insert", share(2).unionByName(share(0).filter(first)).unionByName(untold(1)))
    apply_batch(spark, store, "2-revise", share(1, 3).unionByName(share(0).filter(~first)))
    apply_batch(spark, store, "3-delete", deletes=share(2).select("doc_id"))
    compact(spark, store)
    apply_batch(spark, store, "4-reinsert", share(2))
    if apply_batch(spark, store, "4-reinsert", untold(2)):
        raise RuntimeError("a repeated batch was applied")
    return totals(spark, store)
