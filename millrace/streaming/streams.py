"""Append-only logs as streams: classification into label folders, windowed run summaries, monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.lexicon import KOREAN, Lexicon
from millrace.operators.rules import classified
from millrace.sources.scratch import folder


def source(spark: SparkSession, folder_: str, name: str, files_a_batch: int | None = None) -> DataFrame:
    """The Parquet files of a table (a file or a folder of files) as a stream, with the schema that the table has now.

    All files that are there make one batch, so no row of a table is late whatever the order of
    its files; ``files_a_batch`` bounds batches of a log whose files come in order of time.
    Times without a zone are read as UTC instants, which watermarks need.
    """
    path = f"{folder_.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", True)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    table = reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder_) if _is_file(spark, path) else reader.parquet(path)
    return table.withColumns({c: F.col(c).cast("timestamp") for c, kind in table.dtypes if kind == "timestamp_ntz"})


def _is_file(spark: SparkSession, path: str) -> bool:
    """Whether Spark's own file list of the path is the path itself; works in any store that Spark reads."""
    files = spark.read.parquet(path).inputFiles()
    return len(files) == 1 and files[0].rstrip("/").endswith("/" + path.rstrip("/").rsplit("/", 1)[-1])


def classified_stream(records: DataFrame, key: str, text: str, lexicon: Lexicon = KOREAN, at: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each record once, with its label. With an ingest time, what is known of seen keys is dropped after ``delay``; without one it grows."""
    seen = records.withWatermark(at, delay).dropDuplicatesWithinWatermark([key]) if at else records.dropDuplicates([key])
    return classified(seen, text, lexicon).withColumn("final_label", F.col("rule.label"))


def run_counts(log: DataFrame, at: str, label: str, value: str, width: str = "1 day", delay: str = "2 hours") -> DataFrame:
    """Tumbling windows: n and total by label; rows later than ``delay`` are dropped."""
    w = F.window(at, width)
    return log.withWatermark(at, delay).groupBy(w, label).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("window.start").alias("start"), label, "n", "total")


def sliding_monitor(log: DataFrame, at: str, value: str, width: str = "2 days", step: str = "1 day", delay: str = "2 hours") -> DataFrame:
    w = F.window(at, width, step)
    return log.withWatermark(at, delay).groupBy(w).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("max")).select(F.col("window.start").alias("start"), "n", "mean", "max")


def sessions(log: DataFrame, at: str, key: str, gap: str, delay: str = "2 hours") -> DataFrame:
    w = F.session_window(at, gap)
    return log.withWatermark(at, delay).groupBy(w, key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def started(stream: DataFrame, path: str, partition: str | None = None, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, written as Parquet in batches that a lost executor cannot double."""
    out = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", path + "-state").trigger(availableNow=True)
    return (out.partitionBy(partition) if partition else out).start()


def drained(stream: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """The stream's output once all input is read."""
    spark = stream.sparkSession
    path = folder(spark, name)
    started(stream, path, partition).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


REPORTED = ["label", "score", "reason", "matched_positive_keywords", "matched_negative_keywords", "matched_patterns", "vehicle_mentions", "collision_hits", "work_hits", "facility_hits"]
#: A file of this name in a log's folder says that the log is frozen.
FROZEN = "_FROZEN"


def frozen(spark: SparkSession, path: str) -> bool:
    """Whether a log is closed to more rows."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{FROZEN}")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def freeze(spark: SparkSession, path: str) -> None:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{FROZEN}")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark).close()


def logged(records: DataFrame, key: str, text: str, reports: str, candidates: str, state: str, lexicon: Lexicon = KOREAN) -> StreamingQuery:
    """One classification of each micro-batch into two logs: a flat report of every record and a candidate, with its request payload, of every ambiguous one.

    A batch has a folder of its number in both logs and writes it anew when it is replayed, so
    a failure between the two, or a lost state, leaves nothing twice. Keys that the report log
    holds from other batches are skipped: what is known of seen keys is the log itself and no
    state of the stream, so memory stays bounded, at the price of reading the log's keys for
    each batch. Numbers of a new state begin after the last that the log has. A frozen log is
    refused, before anything is written.
    """
    spark = records.sparkSession
    for path in (reports, candidates):
        if frozen(spark, path):
            raise ValueError(f"{path} is frozen")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields if f.name == key)
    before = _batches(spark, reports, columns)
    first = 0 if before is None else (before.agg(F.max("batch")).first()[0] or 0) + 1
    fresh = not _exists(spark, f"{state}/offsets")
    base = first if fresh else int(spark.read.text(f"{state}-base").first()[0])
    if fresh:
        spark.createDataFrame([(str(base),)], "value string").coalesce(1).write.mode("overwrite").text(f"{state}-base")

    def write(batch: DataFrame, number: int) -> None:
        own = base + number
        known = _batches(batch.sparkSession, reports, columns)
        new = batch.dropDuplicates([key])
        if known is not None:
            new = new.join(known.where(F.col("batch") != own).select(key), key, "left_anti")
        done = classified(new, text, lexicon)
        rule = [F.col(f"rule.{c}").alias(c if c.startswith("matched") or c.endswith(("hits", "mentions")) else f"rule_{c}") for c in REPORTED]
        flat = done.select(key, *rule, F.lit(False).alias("used_llm"), F.lit(None).cast("string").alias("llm_label"), F.col("rule.label").alias("final_label"))
        payload = F.to_json(F.struct(F.col(key), F.col(text), F.struct("rule.label", "rule.score", "rule.reason").alias("rule")))
        asked = done.where("rule.label = 'ambiguous'").select(key, F.col("rule.label").alias("final_label"), payload.alias("prompt_payload"))
        asked.write.mode("overwrite").parquet(f"{candidates}/batch={own}")
        flat.write.mode("overwrite").parquet(f"{reports}/batch={own}")  # the report comes last: a key counts as seen once both stand

    return records.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _batches(spark: SparkSession, path: str, columns: str) -> DataFrame | None:
    return spark.read.schema(f"{columns}, batch bigint").option("basePath", path).parquet(path) if _exists(spark, path) else None
