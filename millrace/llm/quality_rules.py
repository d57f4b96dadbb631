"""Quality rules: boosted trees over statistics of whole documents.

The statistics of each text are computed once per row inside Spark tasks. The trees are
grown in numpy from at most ``max_labelled`` labelled rows (a documented bound: the rows
with the smallest hash of doc_id), then flattened into node arrays that are scored for a
whole batch at a time. Chosen features are monotone: more symbols, repetition or shouting
can never raise a score.

Defined results: a null text has no words and fails the base rules; an empty text likewise;
rows that repeat are scored alike, each row returned once; without labelled rows of both
classes the verdict is that of the base rules; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed values of the base statistics.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

#: Feature name and direction: -1 may only lower the score as it grows, 0 is free.
FEATURES = (
    ("log_words", 0), ("mean_word", 0), ("symbol_rate", -1), ("dup_line_rate", -1), ("repeat_rate", -1),
    ("upper_rate", -1), ("bang_rate", -1), ("bar_rate", -1), ("digit_rate", 0), ("variety", 0),
    ("stop_rate", 0), ("line_words", 0), ("adjacent_rate", -1), ("space_rate", 0),
)
NAMES = [n for n, _ in FEATURES]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(codes: np.ndarray) -> int:
    """Positions covered by a window of five words that occurs at least twice; exact, by renumbering 2-, 4- and 5-grams."""
    n = len(codes)
    if n <= WINDOW:
        return 0
    size = int(codes.max()) + 1
    two, pairs = np.unique(codes[:-1] * size + codes[1:], return_inverse=True)
    if len(two) == n - 1:
        return 0
    four, quads = np.unique(pairs[:-2] * len(two) + pairs[2:], return_inverse=True)
    if len(four) == n - 3:
        return 0
    _, at, count = np.unique(quads[:-1] * size + codes[4:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[at] > 1)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def statistics(text: str | None) -> list[float]:
    """The base counts, then the features, of one whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly \x20 and \x09-\x0D
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    seen, dup, filled = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            filled += 1
            dup += line in seen
            seen.add(line)
    base = [n, chars, symbols, dup]
    if not n:
        return [*base, 0, *[0.0] * len(NAMES)]
    codes, kinds = pd.factorize(np.array(words, dtype=object))
    codes = codes.astype(np.int64)
    repeat = repeated_words(codes)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    tally = np.bincount(raw, minlength=256)
    lower, upper = int(tally[97:123].sum()), int(tally[65:91].sum())
    return [
        *base, repeat,
        float(np.log1p(n)), chars / n, symbols / chars, dup / max(1, filled), repeat / n,
        upper / max(1, lower + upper), int(tally[33]) / n, int(tally[124]) / n, int(tally[48:58].sum()) / chars,
        len(kinds) / n, (int(tally[46]) + int(tally[44])) / n, n / max(1, filled),
        float((codes[1:] == codes[:-1]).mean()) if n > 1 else 0.0, (len(text) - chars) / len(text),
    ]


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, the base counts as longs and the features as one array, for every row."""
    fields = {f.name: f for f in docs.schema.fields}
    schema = ", ".join([*(f"`{k}` {fields[k].dataType.simpleString()}" for k in keep), *(f"{b} long" for b in BASE), "features array<double>"])

    def run(batches):
        for pdf in batches:
            rows = [statistics(t) for t in pdf["text"]]
            out = pdf[keep].copy()
            for i, b in enumerate(BASE):
                out[b] = np.array([r[i] for r in rows], dtype=np.int64)
            out["features"] = [r[len(BASE):] for r in rows]
            yield out

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInPandas(run, schema)


class Trees:
    """Flattened trees: node i of a tree splits feature[i] at threshold[i] (<= goes left); a leaf points to itself."""

    def __init__(self, feature, threshold, left, right, value, depth, start):
        self.feature, self.threshold, self.left, self.right, self.value = feature, threshold, left, right, value
        self.depth, self.start = depth, start

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                go = x[rows, self.feature[t][node]] <= self.threshold[t][node]
                node = np.where(go, self.left[t][node], self.right[t][node])
            total += self.value[t][node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 2.0) -> Trees:
    """Logistic boosting on binned features; a split on a monotone feature must order its sides, and bounds pass down."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    start = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    raw = np.full(n, start)
    size = 2 ** (depth + 1) - 1
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(size, dtype=np.int64), np.zeros(size)
        left, right = np.arange(size), np.arange(size)
        value, low, high = np.zeros(size), np.full(size, -np.inf), np.full(size, np.inf)
        where = np.zeros(n, dtype=np.int64)
        for node in range(size):
            mine = np.flatnonzero(where == node)
            if not len(mine):
                continue
            g, h = grad[mine].sum(), hess[mine].sum()
            value[node] = np.clip(g / (h + 1.0), low[node], high[node])
            if node >= 2**depth - 1:
                continue
            best = (1e-6, -1, -1, 0.0, 0.0)
            for j in range(width):
                if not len(cuts[j]):
                    continue
                gs = np.cumsum(np.bincount(binned[mine, j], grad[mine], len(cuts[j]) + 1))[:-1]
                hs = np.cumsum(np.bincount(binned[mine, j], hess[mine], len(cuts[j]) + 1))[:-1]
                a, b = np.clip(gs / (hs + 1), low[node], high[node]), np.clip((g - gs) / (h - hs + 1), low[node], high[node])
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(hs < least) | (h - hs < least) | (signs[j] * (b - a) < 0)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], j, k, a[k], b[k])
            _, j, k, a, b = best
            if j < 0:
                continue
            feature[node], threshold[node] = j, cuts[j][k]
            left[node], right[node] = 2 * node + 1, 2 * node + 2
            low[[2 * node + 1, 2 * node + 2]], high[[2 * node + 1, 2 * node + 2]] = low[node], high[node]
            if signs[j]:
                middle = (a + b) / 2
                if signs[j] < 0:
                    low[2 * node + 1], high[2 * node + 2] = middle, middle
                else:
                    high[2 * node + 1], low[2 * node + 2] = middle, middle
            where[mine] = np.where(binned[mine, j] <= k, 2 * node + 1, 2 * node + 2)
        value *= rate
        raw += value[where]
        grown.append((feature, threshold, left, right, value))
    return Trees(*(list(z) for z in zip(*grown, strict=True)), depth, start)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000) -> Trees | None:
    """Trees from at most max_labelled labelled rows, those with the smallest hash of doc_id; None without both classes."""
    chosen = (
        labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    # the chosen rows are bounded by max_labelled, so they may be sent to every task
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # of texts under one doc_id, the one with the smallest hash
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "quality")).alias("row")).select("doc_id", "row.text", "row.quality")
    got = with_statistics(rows, ["doc_id", "quality"]).where("n_words > 0").select("doc_id", "quality", "features").toPandas()
    if got["quality"].nunique() < 2:
        return None
    got = got.sort_values("doc_id")
    return grow(np.array(got["features"].tolist(), dtype=float), got["quality"].to_numpy(dtype=float), [s for _, s in FEATURES])


def judged(docs: DataFrame, labels: DataFrame, keep: list[str], least: float = 0.5, max_labelled: int = 12_000) -> DataFrame:
    """keep, the base counts, base_failed, score and kept for every row of docs."""
    model = fit(docs, labels, max_labelled)
    scored = with_statistics(docs, keep)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    if model is None:
        return scored.withColumn("base_failed", failed).withColumn("score", F.lit(None).cast("double")).withColumn("kept", ~F.col("base_failed")).drop("features")

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(features.tolist(), dtype=float).reshape(len(features), len(NAMES))))

    return (
        scored.withColumn("base_failed", failed).withColumn("score", score("features"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least)).drop("features")
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", *BASE, "base_failed", "score", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    columns = docs.columns
    numbered = docs.select(F.struct(*columns).alias("row"), "text", "doc_id")
    model = fit(docs, table(spark, sf_dir, "labels"))

    @F.pandas_udf("boolean")
    def keeps(text: pd.Series) -> pd.Series:
        got = [statistics(t) for t in text]
        base = np.array([r[: len(BASE)] for r in got], dtype=np.int64).reshape(-1, len(BASE))
        good = (base[:, 0] >= MIN_WORDS) & (100 * base[:, 4] <= MAX_REPEAT_PERCENT * base[:, 0])
        if model is not None and len(got):
            good &= model.score(np.array([r[len(BASE):] for r in got], dtype=float)) >= 0.5
        return pd.Series(good)

    return numbered.where(keeps("text")).select("row.*")


QUERIES = {"op9_quality_rules": op9_quality_rules}
SQL: dict[str, str] = {}
