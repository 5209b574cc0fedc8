"""The folder that driver and executors share, for tables that a plan writes on its way."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a local session that names no shared folder, as in tests.
DEFAULT_SCRATCH = "/tmp/checkpoints"


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared folder that the session names; a cluster must name one. It goes when the application ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = DEFAULT_SCRATCH
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back, which ends its lineage.

    The copy is a plain Parquet table, so a lost executor costs a reread and
    no recomputation.
    """
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
