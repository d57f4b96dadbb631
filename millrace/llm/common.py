"""Shared helpers of the text operators: reading tables, cutting lineage, splitting words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read: spark.checkpoint.dir, or (unset and all in one process, as in tests) one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = getattr(spark, "_millrace_scratch", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark._millrace_scratch = where
    return where.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends there, so a lost executor costs no rerun."""
    path = f"{shared_dir(df.sparkSession)}/millrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns that an operator needs, so that others may carry any name."""
    return docs.select("doc_id", "text", *more)


def digest(col) -> "F.Column":
    """128 bits of a string, as two longs: enough to stand for the string in counts over any corpus."""
    return F.struct(F.xxhash64(col).alias("a"), F.xxhash64(F.lit(7), col, F.lit(11)).alias("b"))


def released() -> None:
    """Gives back to the system what earlier tasks of this Python worker have left free, before a task that needs much."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)
