"""Intervals and paired tests: bootstraps over cells, exact binomial tails, sign flips.

Every metric is a function of a few cell counts, so a replicate resamples cells, not rows: the
work is (methods x replicates), whatever the number of rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from millrace.operators.design import numbered
from millrace.operators.metrics import full_ratios


def hash_draw(seed: int, replicate: Column, i: Column, n: Column) -> Column:
    """A reproducible draw from 0 .. n - 1 that any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("bigint") % n


def metric_frame(tp, tn, fp, fn, open_=0.0) -> pd.DataFrame:
    """Metrics of arrays of cell counts; ``open_`` rows have a label and no decision."""
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = lambda a, b: np.where(b > 0, a / np.where(b > 0, b, 1), 0.0)
        p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
        root = np.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        frame = {"precision": p, "recall": r, "f1": ratio(2 * tp, 2 * tp + fp + fn), "mcc": np.where(root > 0, (tp * tn - fp * fn) / np.where(root > 0, root, 1), 0.0), "false_acceptance": ratio(fp, tp + fp)}
        return pd.DataFrame(frame | _covered(tp + tn, fp + fn, open_))


def _covered(right, wrong, open_) -> dict[str, np.ndarray]:
    covered, every = right + wrong, right + wrong + open_
    share = covered / np.where(every > 0, every, 1)
    return {"coverage": share, "abstention_rate": np.where(every > 0, 1 - share, 0.0), "selective_risk": wrong / np.where(covered > 0, covered, 1)}


METRICS = ["precision", "recall", "f1", "mcc", "false_acceptance", "coverage", "abstention_rate", "selective_risk"]


def stratified_bootstrap(cells: DataFrame, key: str, samples: int = 10_000, seed: int = 0, level: float = 0.95, chunk: int = 2_000) -> DataFrame:
    """key, metric, low, high: percentile intervals; within each true class the cells are drawn from a multinomial.

    cells holds tp, tn, fp, fn and may hold true_open and false_open, rows of each class without a decision.
    """
    spark = cells.sparkSession
    cells = cells.withColumns({c: F.lit(0) for c in ("true_open", "false_open") if c not in cells.columns})
    pieces = -(-samples // chunk)
    tasks = cells.select(key, "tp", "tn", "fp", "fn", "true_open", "false_open").crossJoin(F.broadcast(spark.range(pieces).withColumnRenamed("id", "piece")))  # a few pieces for each method
    schema = ", ".join([f"{key} {cells.schema[key].dataType.simpleString()}", *(f"{m} double" for m in METRICS)])

    def run(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                size = min(chunk, samples - r["piece"] * chunk)
                rng = np.random.default_rng([seed, int(r["piece"]), zlib.crc32(str(r[key]).encode())])
                drawn = []
                for names in (("tp", "fn", "true_open"), ("tn", "fp", "false_open")):
                    had = np.array([int(r[n]) for n in names])
                    drawn.append(rng.multinomial(had.sum(), had / had.sum(), size).astype(float) if had.sum() else np.zeros((size, 3)))
                (tp, fn, lost), (tn, fp, held) = (d.T for d in drawn)
                out = metric_frame(tp, tn, fp, fn, lost + held)
                out.insert(0, key, r[key])
                yield out

    drawn = tasks.repartition(key, "piece").mapInPandas(run, schema)
    long = drawn.unpivot([key], METRICS, "metric", "value")
    q = (1 - level) / 2
    return long.groupBy(key, "metric").agg(F.percentile("value", q).alias("low"), F.percentile("value", 1 - q).alias("high"), F.count("*").alias("replicates"))


def cluster_bootstrap(clusters: DataFrame, cluster: str, sums: list[str], samples: int, seed: int) -> DataFrame:
    """replicate and the summed columns of clusters drawn with replacement; draws come from hashes, so SQL gives the same rows."""
    spark = clusters.sparkSession
    placed = numbered(clusters, cluster, "_at")
    n = clusters.agg(F.count("*").alias("_n"))
    grid = spark.range(samples).withColumnRenamed("id", "replicate").crossJoin(F.broadcast(n)).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))  # samples x clusters draws are the method
    drawn = grid.withColumn("_at", hash_draw(seed, F.col("replicate"), F.col("_i"), F.col("_n")).cast("int"))
    return drawn.join(placed.select("_at", *sums), "_at").groupBy("replicate").agg(*(F.sum(c).alias(c) for c in sums))


FULL_SUMS = ["faults", "clean", "tp", "fn", "tn", "fp", "reviews"]


def cluster_intervals(clusters: DataFrame, cluster: str, samples: int = 10_000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """metric, low, high, valid_replicates: percentile intervals of nine ratios over clusters (FULL_SUMS each) drawn with replacement.

    A replicate in which a ratio has nothing to divide by is not valid for it and is left out of its interval.
    """
    ratios = full_ratios()
    drawn = cluster_bootstrap(clusters, cluster, FULL_SUMS, samples, seed).select(*(v.alias(k) for k, v in ratios.items()))
    q = (1 - level) / 2
    return drawn.unpivot([], list(ratios), "metric", "value").groupBy("metric").agg(F.percentile("value", q).alias("low"), F.percentile("value", 1 - q).alias("high"), F.count("value").alias("valid_replicates"))


@F.pandas_udf(DoubleType())
def exact_mcnemar(b: pd.Series, c: pd.Series) -> pd.Series:
    """Two-sided exact p of b against c discordant pairs, in log space; 1.0 without any."""

    def one(x: int, y: int) -> float:
        n = x + y
        if not n:
            return 1.0
        i = np.arange(1, min(x, y) + 1)
        logs = np.concatenate([[0.0], np.cumsum(np.log(n - i + 1) - np.log(i))]) - n * math.log(2)
        top = logs.max()
        return min(1.0, 2 * math.exp(top) * float(np.exp(logs - top).sum()))

    return pd.Series([one(int(x), int(y)) for x, y in zip(b, c, strict=True)])


def pairwise(predictions: DataFrame, key: str, method: str, right: str, methods: list[str]) -> DataFrame:
    """left, right, common, b, c for every pair of methods, on keys that both decide; keys are pivoted once, never paired."""
    wide = predictions.groupBy(key).pivot(method, methods).agg(F.max(F.col(right).cast("int")))
    names = [(x, y) for i, x in enumerate(methods) for y in methods[i + 1:]]
    pairs = F.array(*(F.struct(F.lit(x).alias("left"), F.lit(y).alias("right"), F.col(f"`{x}`").alias("l"), F.col(f"`{y}`").alias("r")) for x, y in names))
    each = wide.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("l").isNotNull() & F.col("r").isNotNull())
    return each.groupBy("left", "right").agg(F.count("*").alias("common"), F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("b"), F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("c"))


def sign_flips(clusters: DataFrame, pair: list[str], difference: str, samples: int = 10_000, seed: int = 0, chunk: int = 1_000) -> DataFrame:
    """pair, clusters, observed, p = (extreme + 1) / (samples + 1): cluster means with random signs.

    A matrix product for each pair and ``chunk`` of samples, each a task of its own; the draws depend on the sorted differences alone.
    """
    fields = {f.name: f.dataType.simpleString() for f in clusters.schema.fields}
    schema = ", ".join([*(f"{p} {fields[p]}" for p in pair), "clusters long, observed double, extreme long"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d, piece = np.sort(pdf[difference].to_numpy(dtype=float)), int(pdf["piece"].iloc[0])
        rng = np.random.default_rng([seed, piece, zlib.crc32("|".join(str(pdf[p].iloc[0]) for p in pair).encode())])
        size = min(chunk, samples - piece * chunk)
        extreme = int((np.abs(rng.choice([-1.0, 1.0], size=(size, len(d))) @ d / len(d)) >= abs(d.mean()) - 1e-15).sum())
        return pd.DataFrame([{**{p: pdf[p].iloc[0] for p in pair}, "clusters": len(d), "observed": float(d.mean()), "extreme": extreme}])

    # a pair's clusters are a row for each cluster, not for each record
    dealt = clusters.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(-(-samples // chunk) - 1))))
    counted = dealt.groupBy(*pair, "piece").applyInPandas(run, schema)
    return counted.groupBy(*pair).agg(F.max("clusters").alias("clusters"), F.max("observed").alias("observed"), ((F.sum("extreme") + 1) / (samples + 1)).alias("p"))
