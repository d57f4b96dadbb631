"""The folder for streams' checkpoints and outputs: spark.checkpoint.dir, which all executors share, or our own where it is unset."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = where or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written once and read back, for what several steps read: lineage ends there.

    Joins with it are merge joins unless one side is sent on purpose: Spark takes the files'
    size for the table's, and sends tables of repeated words that are many times larger in memory.
    """
    path = folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")
