"""Exact samples, allocations and orders that depend on hashes only, so that any engine and partitioning draws the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int | str, *key: Column) -> Column:
    """A reproducible random order: sha256 of the seed and the key."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in key)), 256)


def first_n(df: DataFrame, group: str, order: list[Column], requests: dict[str, int]) -> DataFrame:
    """The first requested rows of each group in the given order; groups stand in request order (column request_order)."""
    most = max(requests.values(), default=0)
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rn") <= most)  # a literal bound lets Spark drop rows before the shuffle
    bound = F.coalesce(*(F.when(F.col(group) == g, n) for g, n in requests.items()), F.lit(0))
    place = F.coalesce(*(F.when(F.col(group) == g, i) for i, g in enumerate(requests)))
    return ranked.where(F.col("_rn") <= bound).withColumn("request_order", place).withColumnRenamed("_rn", "rank")


def shortfall(df: DataFrame, group: str, requests: dict[str, int]) -> DataFrame:
    """check, ok: whether each group has the rows that are asked of it."""
    have = df.groupBy(F.col(group).alias("check")).agg(F.count("*").alias("_n"))
    asked = df.sparkSession.createDataFrame(list(requests.items()), "check string, asked long")
    return asked.join(have, "check", "left").select("check", (F.coalesce("_n", F.lit(0)) >= F.col("asked")).alias("ok"))


def stratified(df: DataFrame, stratum: str, key: str, size: int, seed: int) -> DataFrame:
    """Exactly ``size`` rows of each stratum (or all it has), with its population, the rows drawn and the inverse-probability weight."""
    population = df.groupBy(stratum).agg(F.count("*").alias("population"))
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(stratum).orderBy(draw(seed, F.col(key)), key))).where(F.col("_rn") <= size)
    drawn = F.least("population", F.lit(size))
    return ranked.join(population, stratum).withColumn("sampled", drawn.cast("long")).withColumn("weight", F.col("population") / drawn).withColumnRenamed("_rn", "draw")


def allocated(groups: DataFrame, group: str, size: str, requested: int) -> DataFrame:
    """Largest remainders: ``requested`` places over groups; ties go to the larger group, then the larger key. Integer arithmetic throughout."""
    total = groups.agg(F.sum(size).alias("_total"))
    whole = groups.crossJoin(F.broadcast(total))  # the broadcast side is one row
    share = F.lit(requested).cast("long") * F.col(size)
    base = whole.withColumn("_floor", F.floor(share / F.col("_total")).cast("long")).withColumn("_rest", share % F.col("_total"))
    left = F.least(F.lit(requested).cast("long"), F.col("_total")) - F.sum("_floor").over(Window.partitionBy())
    order = Window.orderBy(F.desc("_rest"), F.desc(size), F.desc(group))  # a row for each group, not for each record
    rank = F.row_number().over(order)
    return base.select(group, size, (F.col("_floor") + F.when(rank <= left, 1).otherwise(0)).cast("long").alias("places")) if requested else whole.select(group, size, F.lit(0).cast("long").alias("places"))


def review_set(df: DataFrame, label: str, stratum: str, key: str, requested: int, seed: int, always: str = "ACCEPT") -> DataFrame:
    """Every ``always`` row, and an allocated sample of the others by stratum and label."""
    others = df.where(F.col(label) != always).withColumn("_group", F.concat_ws("|", stratum, label))
    places = allocated(others.groupBy("_group").agg(F.count("*").alias("_size")), "_group", "_size", requested).select("_group", "places")
    ranked = others.withColumn("_rn", F.row_number().over(Window.partitionBy("_group").orderBy(draw(seed, F.col(key)), key))).where(F.col("_rn") <= requested)
    sampled = ranked.join(F.broadcast(places), "_group").where(F.col("_rn") <= F.col("places"))  # a row for each group
    return df.where(F.col(label) == always).select(key, label, F.lit("all").alias("why")).unionByName(sampled.select(key, label, F.lit("sample").alias("why")))


def cyclic_donors(df: DataFrame, group: str, key: str, cluster: str, shift: int) -> DataFrame:
    """key, donor, other_cluster: the row ``shift`` places on in its group, wrapping; other_cluster is whether the donor is from elsewhere."""
    w = Window.partitionBy(group).orderBy(key)
    n = F.count("*").over(Window.partitionBy(group))
    placed = df.select(group, key, cluster, (F.row_number().over(w) - 1).alias("_at"), n.alias("_n"))
    giver = placed.select(F.col(group).alias("_g"), F.col("_at").alias("_give"), F.col(key).alias("donor"), F.col(cluster).alias("_c"))
    met = placed.join(giver, (F.col(group) == F.col("_g")) & (F.pmod(F.col("_at") + shift, F.col("_n")) == F.col("_give")))
    return met.select(group, key, "donor", (F.col(cluster) != F.col("_c")).alias("other_cluster"))


def opaque_id(prefix: str, namespace: str, *key: Column) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(F.concat_ws("|", F.lit(namespace), *(k.cast("string") for k in key)), 256), 1, 20)))


def permuted(df: DataFrame, within: str, key: str, seed: int) -> DataFrame:
    """df with position: a seeded order of the rows of each group."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(within).orderBy(draw(seed, F.col(within), F.col(key)), key)))
