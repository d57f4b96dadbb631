"""Sources and sinks of records: JSON files, JSON lines, keyed reads, label routing, CSV, summaries, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the file name that carries a record's number.
RECORD_NAME = r"zeroshot_test_(\d+)_result\.json"

PARSED = T.StructType([T.StructField(n, T.StringType()) for n in ("accident_datetime", "location", "weather_or_environment", "road_type", "vehicle_type", "blood_alcohol_content", "accident_trajectory", "casualty_result")])
RECORD = T.StructType([T.StructField("input_file", T.StringType()), T.StructField("source_text", T.StringType()), T.StructField("source_mode", T.StringType()), T.StructField("parsed", PARSED)])


def read_records(spark: SparkSession, path: str, schema: T.StructType = RECORD, name: str = RECORD_NAME) -> DataFrame:
    """One JSON object a file; only files whose whole name matches, whose number is candidate_id."""
    files = spark.read.schema(schema).option("recursiveFileLookup", True).json(path, multiLine=True).withColumn("file_name", F.col("_metadata.file_name"))
    return files.where(F.col("file_name").rlike(f"^{name}$")).withColumn("candidate_id", F.regexp_extract("file_name", name, 1).cast("bigint"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, anything that is no object of the schema raises."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    read = lines.select("value", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("_r"))
    bad = read.where(F.col("_r").isNull() | F.col("_r._corrupt").isNotNull() | ~F.trim("value").startswith("{"))
    if not bad.isEmpty():
        raise ValueError(f"{path} holds lines that are no objects of the schema")
    return read.select(*(F.col(f"_r.{n}").alias(n) for n in schema.names))


def keyed(df: DataFrame, key: str) -> DataFrame:
    """df with an integer key; repeated keys and keys that are no integers raise."""
    from millrace.operators.consensus import repeated_keys

    bad = repeated_keys(df, key).limit(5).collect()
    if bad:
        raise ValueError(f"{key} is repeated or no integer: {[r[0] for r in bad]}")
    return df.withColumn(key, F.col(key).cast("bigint"))


def write_by_label(df: DataFrame, path: str, label: str, fmt: str = "json") -> None:
    """One folder for each label; a frozen folder is never overwritten."""
    df.write.mode("errorifexists").partitionBy(label).format(fmt).save(path)


def report(df: DataFrame, rule: str = "rule") -> DataFrame:
    """The flat report row of each record."""
    keep = [c for c in df.columns if c != rule]
    return df.select(*keep, *(F.col(f"{rule}.{f}").alias(f) for f in ("label", "score", "vehicle_mentions", "collision_hits", "work_hits", "facility_hits")))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV in fixed column order with a header that begins with the byte order mark; for report tables, which are small."""
    first = "﻿" + columns[0]
    df.select(*columns).withColumnRenamed(columns[0], first).coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def long_summary(df: DataFrame) -> DataFrame:
    """measure (dotted), value (string) for every scalar of nested rows; lists are left out."""
    found = []

    def walk(kind, name):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{name}.{f.name}" if name else f.name)
        elif not isinstance(kind, (T.ArrayType, T.MapType)):
            found.append(name)

    walk(df.schema, "")
    flat = df.select(*(F.col(n).cast("string").alias(n.replace(".", "__")) for n in found))
    long = flat.unpivot([], [F.col(f"`{n.replace('.', '__')}`") for n in found], "measure", "value")
    return long.withColumn("measure", F.replace("measure", F.lit("__"), F.lit(".")))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """name (below path), sha256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = path.rstrip("/") + "/"
    return files.select(F.regexp_replace("path", "^.*?" + base.replace(".", r"\."), "").alias("name"), F.sha2("content", 256).alias("sha256"))


def ledger_check(sums: DataFrame, ledger: DataFrame) -> DataFrame:
    """name, state: same, changed, missing (in the ledger only) or unlisted; ledger lines are 'sha  name'."""
    parts = F.split("value", "  ", 2)
    listed = ledger.where(F.trim("value") != "").select(parts[1].alias("name"), parts[0].alias("_l"))
    m = sums.join(listed, "name", "full_outer")
    return m.select("name", F.when(F.col("_l").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when(F.col("_l") == F.col("sha256"), "same").otherwise("changed").alias("state"))
