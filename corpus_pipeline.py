"""A training corpus from raw documents: five operators, one after another.

Each stage gets what its predecessor kept, as a Parquet table, and all but the
last return the columns of documents. Stages judge rows, not ids: where rows share
an id or have none, each gets a key of its own for the stage and is judged by its
own text. Other columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspire.llm import bpe, decontaminate, minhash, quality, secrets
from docspire.llm.common import cut, fit_broadcast, fresh_name, scratch, with_keys
from docspire.llm.queries import word_tokenizer

#: Dropped keys that may be broadcast, 16 bytes each; beyond, the tables are joined by shuffling.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """`docs` but for the rows of these keys, and without the key."""
    name = fresh_name(docs, "_gone")
    gone = cut(gone.select(F.col("doc_id").alias(name)).distinct())
    kept = docs.join(fit_broadcast(gone, BROADCAST_IDS), F.col(key) == F.col(name), "left_anti")
    return kept if key == "doc_id" else kept.drop(key)


def _by_key(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """What an operator reads of the rows, with the key as id."""
    return rows.select(F.col(key).alias("doc_id"), *columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows, key = with_keys(docs)
    return _without(rows, key, quality.quality_rules(_by_key(rows, key, "text", "lang", "source")).filter("NOT kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates; one without id only if none has one."""
    rows, key = with_keys(docs)
    found = cut(minhash.near_duplicates(_by_key(rows, key, "text"), k=5, percent=80, unique=True).select("doc_id", "component_id"))
    ids = rows.select(F.col("doc_id").alias("_id"), F.col(key).alias("_key"))
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_key").alias("key"))
    best = found.join(ids, F.col("doc_id") == F.col("_key")).groupBy("component_id").agg(F.min(order)["key"].alias("_best"))
    return _without(rows, key, found.join(best.select("_best"), F.col("doc_id") == F.col("_best"), "left_anti"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows, key = with_keys(docs)
    return _without(rows, key, decontaminate.contaminated(_by_key(rows, key, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), unique=True))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in them replaced by a mark."""
    spans = fresh_name(docs, "_spans")
    found = secrets.scan_ledger(docs, scratch(spark), "pipeline", out=spans)
    clean = found.withColumn("text", secrets.redact(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of each document."""
    return bpe.digests(docs, word_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("BPE encoding and decoding", bpe_encoding),
]

#: SQL can't express the MinHash and BPE stages; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
