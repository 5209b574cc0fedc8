"""The pipeline against the stages' rules applied one by one in plain Python."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SECRET, brute_components, words


def test_pipeline(spark, tmp_path):
    text = lambda i, n=40: " ".join(f"word{i}x{j}" for j in range(n))
    rows = [
        (1, text(1)), (2, text(1)), (3, text(1, 39) + " changed"), (4, text(4)), (5, "short"), (6, text(6) + " " + text(99, 15) + " end"),
        (7, text(7) + " " + SECRET), (8, " ".join(["same words again"] * 20)), (9, None), (10, text(10)),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.withColumn("extra", F.lit("kept")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, text(99, 15))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns + ["extra"], name
        seen.append({r["doc_id"]: r["text"] for r in at.collect()})
    long_enough = {i: t for i, t in rows if len(words(t)) >= 20 and i != 8}
    assert seen[0] == long_enough
    ids = sorted(long_enough)
    component, _ = brute_components([long_enough[i] for i in ids], 5)
    kept = {ids[k]: long_enough[ids[k]] for k, c in enumerate(component) if c == k}
    assert seen[1] == kept and 2 not in kept
    assert seen[2] == {i: t for i, t in kept.items() if i != 6}
    assert set(seen[3]) == set(seen[2]) and "hunter22" not in seen[3][7] and re.search(r"\[secret\]", seen[3][7])
    assert {i: t for i, t in seen[3].items() if i != 7} == {i: t for i, t in seen[2].items() if i != 7}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(seen[3]) and all(r["n_tokens"] > 0 for r in out)


def test_pipeline_of_nothing(spark, tmp_path):
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], kinds).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_are_judged_by_their_own_text(spark, tmp_path):
    """Rows without id, and rows of one id and different texts or the same."""
    text = lambda i, n=40: " ".join(f"word{i}x{j}" for j in range(n))
    item = text(99, 15)
    rows = [
        (1, text(1)), (None, text(1)), (None, "too short"), (None, text(2) + " " + item + " end"), (None, text(3)), (None, text(3)),
        (4, text(4)), (4, text(5) + " " + item + " end"), (4, "short"), (6, text(6)), (6, text(6)), (7, text(7)), (7, text(8)),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 5) for i, t in rows], "doc_id bigint, text string, lang string, source string, _row bigint").repartition(3)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
    want = [(None, text(3)), (1, text(1)), (4, text(4)), (6, text(6)), (7, text(7)), (7, text(8))]
    assert sorted(((r["doc_id"], r["text"]) for r in at.collect()), key=str) == sorted(want, key=str)


def test_columns_of_clashing_names(spark, tmp_path):
    """Whatever columns the documents have, stages keep them and their values."""
    text = lambda i, n=40: " ".join(f"word{i}x{j}" for j in range(n))
    rows = [(1, text(1)), (2, text(1)), (3, text(3) + " " + SECRET), (4, None)]
    names = "_row _row_ _gone _salt _blob _heavy _held _own _of _spans spans key node component_id _key _id _best marks n print block kept bucket".split()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.selectExpr("*", *[f"'{n}' `{n}`" for n in names])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, text(99, 15))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        assert all(r[n] == n for r in at.collect() for n in names)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [1, 3]
