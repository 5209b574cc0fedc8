"""The registered queries of this subpackage: each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, html, langid, minhash, quality, rollup, secrets, substrings, suffixes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(_table(spark, sf_dir, "documents"), keep_text=False)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scans_by_batches(_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    kinds = {"words-1": None, "byte-bpe-50k": (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)}
    return rollup.token_counts_by_batches(_table(spark, sf_dir, "documents"), kinds)


def word_tokenizer() -> str:
    """The public tokenizer file of the BPE contract."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), word_tokenizer())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_language_id, op2_minhash_near_dedup, op3_substring_dedup, op4_suffix_array_dedup, op5_benchmark_decontamination,
        op6_quality_rules, op7_html_extraction, op8_token_counts, op9_bpe_encoding, op10_secret_scans,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": quality.QUALITY_SQL, "op10_secret_scans": secrets.SECRETS_SQL}
