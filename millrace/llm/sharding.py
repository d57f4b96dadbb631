"""Sharding by sampled splitters: shards of near equal bytes, equal texts side by side.

1. A record's key is the hash of its text, so equal texts are neighbours. A sample is drawn
   in which a record's chance is in proportion to its size (about SAMPLE keys whatever the
   input), and its quantiles split the keys into ranges of about equal bytes.
2. Ranges that turn out overfull (a text with very many copies) are subdivided by doc_id.
   Ranges and subdivisions are bounded by the number of shards, not by the data.
3. Within each part, running sums in key order; with the parts' totals (a bounded table)
   they give each record its place in all bytes, and the shard whose stretch holds it.
4. Records over 1 / LARGE of a shard, of which there are fewer than shards * LARGE, are first
   dealt largest first to the emptiest shard; the others fill all shards to one level.

Only doc_id, sizes and hashes are shuffled. Defined results: a null text has the size and
checksum of none; repeated rows are records of their own; an empty table has no shards;
slots run from 0 without gaps in each shard.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SHARDS, RANGES, SAMPLE, LARGE, OVERFULL, OVERHEAD = 40, 32, 60_000, 100, 1.5, 16


def records(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("key"))


def splitters(rows: DataFrame, total: int, ranges: int, sample: int) -> np.ndarray:
    """Quantiles of a size-weighted sample of the keys; about ``sample`` longs come to the driver."""
    chance = F.pmod(F.xxhash64("key", "doc_id", F.lit(3)), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.where(chance < F.col("size") * (sample / total)).select("key").toPandas()["key"].to_numpy()
    return np.unique(np.sort(drawn)[np.linspace(0, len(drawn), ranges + 1).astype(int)[1:-1]]) if len(drawn) else np.empty(0, dtype=np.int64)


def levels(used: list[int], more: int) -> list[int]:
    """Bytes that each shard still takes so that all are filled to one level."""
    order = sorted(used)
    level, left = float(order[0]) if order else 0.0, float(more)
    for k in range(1, len(order) + 1):
        step = (order[k] - level) * k if k < len(order) else float("inf")
        if step >= left:
            level += left / k
            break
        left -= step
        level = float(order[k])
    edges = np.floor(np.cumsum([max(0.0, level - u) for u in used])).astype(np.int64)
    return [int(e) for e in edges]


def assigned(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, key, shard and slot of every row."""
    spark = docs.sparkSession
    rows = stored(records(docs))
    totals = rows.agg(F.sum("size"), F.count("*")).first()
    total = int(totals[0] or 0)
    if not total:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    limit = total / shards / LARGE

    # fewer than shards * LARGE records exceed the limit, so these are few whatever the input
    rank = F.row_number().over(Window.orderBy(F.desc("size"), "key", "doc_id"))
    large = stored(rows.where(F.col("size") > limit).withColumn("rank", rank))
    heap, used, held, where = [(0, k) for k in range(shards)], [0] * shards, [0] * shards, []
    for r in large.select("rank", "size").orderBy("rank").collect():
        _, k = heapq.heappop(heap)
        where.append((r["rank"], k, held[k]))
        used[k] += r["size"]
        held[k] += 1
        heapq.heappush(heap, (used[k], k))
    columns = ["doc_id", "size", "text_crc32", "key", "shard", "slot"]
    first = large.join(F.broadcast(spark.createDataFrame(where, "rank int, shard int, slot long")), "rank").select(*columns)

    small = rows.where(F.col("size") <= limit)
    rest = total - sum(used)
    if not rest:
        return first
    ranges = shards * RANGES
    cut = splitters(small, rest, ranges, SAMPLE)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cut, key.to_numpy(), side="right").astype(np.int32))

    ranged = small.withColumn("range", range_of("key"))
    full = {r["range"]: r["bytes"] for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes")).collect()}  # at most ``ranges`` rows
    fair = rest / ranges
    many = np.array([max(1, int(np.ceil(full.get(i, 0) / fair))) if full.get(i, 0) > OVERFULL * fair else 1 for i in range(len(cut) + 1)], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(many)[:-1]])

    @F.pandas_udf("int")
    def part_of(range_: pd.Series, salt: pd.Series) -> pd.Series:
        r = range_.to_numpy()
        return pd.Series((start[r] + np.mod(salt.to_numpy(), many[r])).astype(np.int32))

    within = Window.partitionBy("part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = stored(
        ranged.withColumn("part", part_of("range", F.xxhash64("doc_id", F.lit(9)))).drop("range")
        .withColumn("before", F.sum("size").over(within) - F.col("size")).withColumn("number", F.count("*").over(within) - 1)
    )
    parts = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("part").collect()  # bounded as the ranges are
    at_byte = at_row = 0
    offsets = []
    for p in parts:
        offsets.append((p["part"], at_byte, at_row))
        at_byte, at_row = at_byte + p["bytes"], at_row + p["rows"]
    edges = levels(used, rest)[:-1]
    joined = placed.join(F.broadcast(spark.createDataFrame(offsets, "part int, at_byte long, at_row long")), "part")
    place = F.col("at_byte") + F.col("before") + F.floor(F.col("size") / 2)
    shard = sum((F.when(place >= e, 1).otherwise(0) for e in edges), F.lit(0))
    put = joined.select("doc_id", "size", "text_crc32", "key", shard.cast("int").alias("shard"), (F.col("at_row") + F.col("number")).alias("row"))
    begins = [(r["shard"], r["row"] - held[r["shard"]]) for r in put.groupBy("shard").agg(F.min("row").alias("row")).collect()]
    second = put.join(F.broadcast(spark.createDataFrame(begins, "shard int, begin long")), "shard").withColumn("slot", F.col("row") - F.col("begin")).select(*columns)
    return first.unionByName(second)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, file_rows: int = 500_000) -> None:
    """docs, with every column, as one folder of Parquet files for each shard, in slot order, about file_rows rows in a file.

    The columns of place are ``shard`` and ``slot``; where docs has such columns, with as many underscores before them as it takes.
    """
    used, names = {c.lower() for c in docs.columns}, {}
    for c in ("shard", "slot"):
        names[c] = c
        while names[c] in used:
            names[c] = "_" + names[c]
    twin = F.row_number().over(Window.partitionBy("id", "key").orderBy("key"))
    numbered = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")).withColumn("twin", twin)
    place = assigned(docs, shards).select(F.col("doc_id").alias("id_"), F.col("key").alias("key_"), "shard", "slot")
    place = place.withColumn("twin_", F.row_number().over(Window.partitionBy("id_", "key_").orderBy("shard", "slot")))
    met = numbered.join(place, F.col("id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")) & (F.col("twin") == F.col("twin_")))
    file = F.floor(F.col("slot") / F.lit(file_rows))
    dealt = met.withColumn("file", file).repartition("shard", "file").sortWithinPartitions("shard", "file", "slot")
    out = [F.col("doc")[c].alias(c) for c in docs.columns]
    dealt.select(*out, F.col("shard").alias(names["shard"]), F.col("slot").alias(names["slot"])).write.partitionBy(names["shard"]).parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = assigned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_sharding": op8_sharding}
SQL: dict[str, str] = {}
