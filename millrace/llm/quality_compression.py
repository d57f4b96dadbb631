"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text is
compressed in blocks with each of them, so that a long text cannot become its own dictionary;
the difference of the two sizes, divided by the size of the text, is large where one class's
dictionary fits better. A logistic curve, fitted on labelled rows that were not used for the
dictionaries, turns it into a score between 0 and 1.

Labels are learnt only from rows whose crc32(doc_id as text) mod 4 is not 2, at most
MAX_LABELLED of each class (a documented bound: those with the smallest hash), and of each of
them at most SAMPLED blocks, spread over the whole text; whole texts of all rows are scored. Labels, lang, source and doc_id are no inputs of a score.

A few words say little, so NEUTRAL bytes at the share of good rows stand beside every text.

Defined results: a null text is scored as an empty one, and an empty one gets the share of
good rows in the fit; with fewer than five labelled rows of a class in a half of the fit every
score is that share (0.5 without labels); of texts under one doc_id the one with the smallest
hash is learnt from; repeated rows are scored alike.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MAX_LABELLED, DICTIONARY, BLOCK, LEVEL, LEAST = 1_500, 65_536, 2_048, 3, 0.7
#: Bytes of neutral text that stand beside every text, so that a few words alone decide little.
NEUTRAL = 96
#: Blocks of a labelled text that are learnt from at most: with MAX_LABELLED they bound what comes to the driver.
SAMPLED = 4


def held_out(doc_id):
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2


def blocks(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i: i + BLOCK] for i in range(0, len(raw), BLOCK)]


class Pair:
    """The two dictionaries and the curve; small enough to go with each task."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad, self.slope, self.shift, self.share = good, bad, 0.0, 0.0, 0.5
        self.tools = None

    def __getstate__(self):
        return self.__dict__ | {"tools": None}

    def differences(self, texts) -> np.ndarray:
        import zstandard

        if self.tools is None:
            self.tools = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (self.good, self.bad)]
        good, bad = (t.compress for t in self.tools)
        out = np.zeros(len(texts))
        for k, text in enumerate(texts):
            cut = blocks(text)
            if cut:
                out[k] = sum(len(bad(b)) - len(good(b)) for b in cut) / sum(map(len, cut))
        return out

    def scores(self, texts) -> np.ndarray:
        if not self.good:
            return np.full(len(texts), self.share)
        size = np.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], dtype=float)
        d, still = self.differences(texts), 0.0
        if self.slope > 0 and 0 < self.share < 1:  # the difference at which the curve gives the share of good rows
            still = (np.log(self.share / (1 - self.share)) - self.shift) / self.slope
        d = (d * size + still * NEUTRAL) / (size + NEUTRAL)
        return np.where(size == 0, self.share, 1 / (1 + np.exp(-np.clip(self.slope * d + self.shift, -30, 30))))


def trained(samples: list[str]) -> bytes:
    import zstandard

    pieces = [b for text in samples for b in blocks(text)]
    return zstandard.train_dictionary(DICTIONARY, pieces, k=256, d=8, level=LEVEL).as_bytes()


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Pair:
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = F.xxhash64("doc_id", F.lit(21))
    chosen = None
    for quality in (0, 1):
        part = known.where(F.col("quality") == quality).orderBy(order, "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * most rows are chosen, so they may be sent to every task
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("length(text) > 0")
    stretches = F.ceil(F.length("text") / F.lit(BLOCK)).cast("int")
    stride = F.greatest(F.ceil(stretches / F.lit(SAMPLED)).cast("int"), F.lit(1))
    some = F.array_join(F.transform(F.sequence(F.lit(0), stretches - 1, stride), lambda k: F.substring("text", k * BLOCK + 1, F.lit(BLOCK))), "")
    rows = rows.select("doc_id", "quality", F.xxhash64("text").alias("hash"), some.alias("text")).groupBy("doc_id").agg(F.min(F.struct("hash", "text", "quality")).alias("row"))
    rows = rows.select("doc_id", "row.text", "row.quality").toPandas().sort_values("doc_id")
    y = rows["quality"].to_numpy(dtype=float)
    # shares of both classes among all labelled rows weigh the curve
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    half = np.array([zlib.crc32(f"half {i}".encode()) % 2 == 0 for i in rows["doc_id"]], dtype=bool)
    if min((y[half] == 0).sum(), (y[half] == 1).sum(), (y[~half] == 0).sum(), (y[~half] == 1).sum()) < 5:
        none = Pair(b"", b"")
        none.share = share
        return none
    pair = Pair(*(trained(list(rows["text"][half & (y == q)])) for q in (1, 0)))
    d, t = pair.differences(list(rows["text"][~half])), y[~half]
    weight = np.where(t == 1, share / max(1e-9, (t == 1).mean()), (1 - share) / max(1e-9, (t == 0).mean()))
    a, b = 0.0, 0.0
    scale = d.std() or 1.0
    z = d / scale
    for _ in range(60):  # Newton's steps of a logistic fit with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = weight * np.maximum(p * (1 - p), 1e-6)
        g = np.array([(weight * (t - p) * z).sum() - 0.05 * a, (weight * (t - p)).sum()])
        h = np.array([[(w * z * z).sum() + 0.05, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
    pair.slope, pair.shift, pair.share = a / scale, b, share
    return pair


def scored(docs: DataFrame, pair: Pair) -> DataFrame:
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(pair.scores(list(text)))

    return docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score("text").alias("score")).withColumn("predicted", F.when(F.col("score") >= LEAST, 1).otherwise(0))


def op2_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op2_quality_compression": op2_quality_compression}
SQL: dict[str, str] = {}
