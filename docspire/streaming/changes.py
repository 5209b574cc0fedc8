"""The change log: an append-only table that readers batch or stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: insert, update, remove, index_end; `document` is JSON.
SCHEMA = "seq bigint, collection string, kind string, _id bigint, document string, at_ms bigint, originator string"


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The log as a stream; a query over it resumes from its checkpoint."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def subscribe(spark: SparkSession, path: str, handler: Callable[[DataFrame, int], None], checkpoint: str, continuous: bool = False):
    """Call `handler(batch, number)` with new events; once over what there is, or as they come."""
    writer = stream(spark, path).writeStream.option("checkpointLocation", checkpoint).foreachBatch(handler)
    return (writer.trigger(processingTime="1 second") if continuous else writer.trigger(availableNow=True)).start()


def summary(log: DataFrame) -> DataFrame:
    """Events by kind and the greatest id of each."""
    return log.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("_id").alias("last_id"))


def latest(log: DataFrame) -> DataFrame:
    """The last event of each document: a log replayed."""
    return log.groupBy("collection", "_id").agg(F.max_by(F.struct("kind", "document"), "seq").alias("e")).select("collection", "_id", "e.*")
