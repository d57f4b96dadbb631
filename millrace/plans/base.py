"""Registration of queries: a function of (spark, sf_dir) and, where SQL can say it, the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.scratch import stored


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores, where its files are fewer than cores: one row group is one task otherwise.

    Dealt out once, for all that read it, and into as many parts as its size asks for.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return stored(df.repartition(key)) if len(df.inputFiles()) < cores else df


def registry() -> tuple[Callable, dict, dict]:
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(name: str, oracle: str | None = None):
        def add(f):
            queries[name] = f
            if oracle:
                sql[name] = oracle
            return f

        return add

    return query, queries, sql
