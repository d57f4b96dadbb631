"""Ranked lexical search over posting lists cut into geometric blocks, one blocking for each term.

Documents become sparse vectors of integer impacts over the terms of the queries. They are
ordered by similarity (the two nearest of PIVOTS drawn documents), so that each posting list,
read in that order, is clustered: BLOCK neighbouring documents of a list are a block, and its
summary is the coordinatewise maximum of their vectors. For a query, the product of a summary
and the query's weights bounds every score within the block. A block is skipped only if that
bound is below the query's threshold, and a list only if all terms of the query up to its
own cannot reach the threshold together (terms in the order of their largest product). Every
document that can be among the best stands in a block that is read, so results are exact. What is
read is scored in 64-bit integers, and the threshold rises with the best found.

The first thresholds come from the 1 in SAMPLED documents of a hash, searched in the same way;
they only bound, every document is searched. Documents are range-partitioned by similarity and each task reads
slices of at most CELLS vector cells, so no list, however long, meets in one place; a task
sends its best per query alone. Queries are dealt in batches of about SENT_TERMS terms, which
are sent to every task.

Defined results: a null text has no term, and a document without terms is not counted; rows
that repeat are documents of their own; equal rows of queries are one; two different texts of
one item_id are two queries that share the id; a null doc_id is counted but never returned.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, stored, table

TOP = 20
PIVOTS, BLOCK, SAMPLED, CELLS, SENT_TERMS = 64, 32, 32, 1 << 23, 200_000
#: Bytes of terms as they are, A-Z lower-cased, all others blanks; letters beyond ASCII are bytes from 0x80 up.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()


def weight(count: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, count: int, length: int) -> np.ndarray:
    """For each term of a document tf times in its n: below 1,000,000, so exact in single precision too."""
    m = 75 + (25 * n * count) // length
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


# -- tables --------------------------------------------------------------------------------------
def asked(queries: DataFrame) -> DataFrame:
    """query, item_id, term, n: the terms of each different row, with repeats counted."""
    rows = queries.select("item_id", "text").distinct().withColumn("query", F.xxhash64("item_id", "text"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [(q, i, t, n) for q, i, text in zip(*(part.column(c).to_pylist() for c in ("query", "item_id", "text")), strict=True) for t, n in Counter(terms(text)).items()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.int64()))], names=["query", "item_id", "term", "n"])

    return rows.mapInArrow(run, "query long, item_id long, term binary, n long")


def _lists(parts: list, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array([x for p in parts for x in p], kind))


def counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers of those asked for, ascending) and tfs, of every document with terms."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches):
        get = shared.value.get
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, out = b.slice(at, 256), []
                for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if words := terms(text):
                        found = Counter(map(get, words))
                        found.pop(None, None)
                        pairs = sorted(found.items())
                        out.append((i, len(words), [t for t, _ in pairs], [f for _, f in pairs]))
                ids, n, which, tfs = zip(*out, strict=True) if out else ((),) * 4
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), _lists(which, pa.int32()), _lists(tfs, pa.int32())], names=["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _flat(b: pa.RecordBatch) -> tuple:
    """doc_ids, n, offsets, terms and tfs of a batch as arrays."""
    which, tfs = b.column("terms"), b.column("tfs")
    lengths = np.diff(which.offsets.to_numpy())
    return b.column("doc_id").to_numpy(zero_copy_only=False), b.column("n").to_numpy(), np.r_[0, np.cumsum(lengths)], which.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)


def _ordered(vectors: DataFrame, weights: np.ndarray, count: int, length: int) -> DataFrame:
    """vectors with ``like``: the numbers of the two drawn documents whose weighted vectors are nearest."""
    most = max(2, min(PIVOTS, CELLS // 2 // max(1, len(weights))))
    drawn = vectors.orderBy(F.xxhash64("doc_id", "n", "terms")).limit(most).collect()
    pivots = np.zeros((len(weights), most), dtype=np.float32)
    for k, r in enumerate(drawn):
        if r["terms"]:
            v = impacts(np.array(r["tfs"], dtype=np.int64), np.int64(r["n"]), count, length) * weights[r["terms"]] / 1e6
            pivots[r["terms"], k] = v / max(1.0, float(np.sqrt((v * v).sum())))
    shared = vectors.sparkSession.sparkContext.broadcast((pivots, weights))

    def run(batches):
        pivots, weights = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                _, n, offsets, which, tfs = _flat(part)
                near = np.zeros((part.num_rows, pivots.shape[1]))
                if len(which):
                    sizes = np.diff(offsets)
                    v = (impacts(tfs, np.repeat(n, sizes), count, length) * weights[which]).astype(np.float32)
                    full = sizes > 0
                    near[full] = np.add.reduceat(pivots[which] * v[:, None], offsets[:-1][full], axis=0)
                two = np.argsort(-near, axis=1, kind="stable")[:, :2]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(two[:, 0] * pivots.shape[1] + two[:, 1], pa.int64())], names=[*part.schema.names, "like"])

    return vectors.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>, like long")


# -- a slice of documents ------------------------------------------------------------------------
class Queries:
    """Queries that are searched together: their terms (ascending) as columns, each one's columns and integer weights."""

    def __init__(self, batch: list[tuple[int, list, list]]):
        self.names = [q for q, _, _ in batch]
        self.terms = np.unique(np.concatenate([np.array(t, dtype=np.int64) for _, t, _ in batch]))
        self.columns = [np.searchsorted(self.terms, t) for _, t, _ in batch]
        self.weights = [np.array(w, dtype=np.int64) for _, _, w in batch]


def grouped(queries: list[tuple[int, list, list]], most: int) -> list[Queries]:
    """Queries in groups of ``most`` different terms, or of one query that has more."""
    groups, now, held = [], [], set()
    for q in queries:
        if now and len(held | set(q[1])) > most:
            groups.append(Queries(now))
            now, held = [], set()
        now.append(q)
        held |= set(q[1])
    return groups + ([Queries(now)] if now else [])


def blocked(x: np.ndarray, column: int, others: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The posting list of a column: its rows in order of similarity, where its blocks start, and their summaries over other columns."""
    rows = np.flatnonzero(x[:, column])
    starts = np.arange(0, len(rows), block)
    return rows, starts, np.maximum.reduceat(x[np.ix_(rows, others)], starts, axis=0) if len(rows) else x[:0][:, others]


def candidates(x: np.ndarray, queries: Queries, least: list[int], block: int = BLOCK) -> list[np.ndarray]:
    """Rows of x that can score ``least`` of each query: those in a block, of a list that is needed, whose bound reaches it."""
    highest = x.max(axis=0).astype(np.float64)
    needs: dict[int, list[int]] = {}
    for k, (columns, w) in enumerate(zip(queries.columns, queries.weights, strict=True)):
        parts = highest[columns] * w
        order = np.argsort(parts, kind="stable")
        for j in order[(np.cumsum(parts[order]) * (1 + 1e-9) >= least[k]) & (parts[order] > 0)]:
            needs.setdefault(int(columns[j]), []).append(k)
    found = np.zeros((len(least), len(x)), dtype=bool)
    for column, who in needs.items():
        others = np.unique(np.concatenate([queries.columns[k] for k in who]))
        rows, starts, summary = blocked(x, column, others, block)
        w = np.zeros((len(others), len(who)))
        for j, k in enumerate(who):
            w[np.searchsorted(others, queries.columns[k]), j] = queries.weights[k]
        reach = (summary.astype(np.float64) @ w) * (1 + 1e-9) >= np.array([least[k] for k in who])
        lengths = np.diff(np.r_[starts, len(rows)])
        for j, k in enumerate(who):
            found[k, rows[np.repeat(reach[:, j], lengths)]] = True
    return [np.flatnonzero(f) for f in found]


def _best(scores: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.lexsort((ids, -scores))[:top]
    return scores[keep], ids[keep]


def searched(vectors: DataFrame, queries: list[tuple[int, list, list]], least: dict[int, int], count: int, length: int, top: int = TOP) -> DataFrame:
    """query, doc_id, score: the best of each task, all with at least the query's ``least``."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries, least))
    cells, block = CELLS, BLOCK

    def run(batches):
        queries, least = shared.value
        groups = grouped(queries, 8192)
        widest = max((len(g.terms) for g in groups), default=1)
        best = {q: (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for q, _, _ in queries}
        floor = {q: max(1, least.get(q, 1)) for q in best}
        for part in _slices(batches, max(64, min(2048, cells // widest))):
            ids, n, offsets, which, tfs = part
            sizes = np.diff(offsets)
            values, row = impacts(tfs, np.repeat(n, sizes), count, length), np.repeat(np.arange(len(ids)), sizes)
            for g in groups:
                at = np.minimum(np.searchsorted(g.terms, which), len(g.terms) - 1)
                own = g.terms[at] == which
                x = np.zeros((len(ids), len(g.terms)), dtype=np.float32)
                x[row[own], at[own]] = values[own]
                for k, rows in enumerate(candidates(x, g, [floor[q] for q in g.names], block)):
                    if len(rows):
                        q = g.names[k]
                        scores = x[np.ix_(rows, g.columns[k])].astype(np.int64) @ g.weights[k]
                        good = scores >= floor[q]
                        best[q] = _best(np.r_[best[q][0], scores[good]], np.r_[best[q][1], ids[rows[good]]], top)
                        if len(best[q][0]) == top:
                            floor[q] = max(floor[q], int(best[q][0][-1]))
        for q, (scores, ids) in best.items():
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q), pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["query", "doc_id", "score"])

    return vectors.mapInArrow(run, "query long, doc_id long, score long")


def _slices(batches, most: int):
    """Arrays of at most ``most`` documents that follow each other, without null ids."""
    for b in batches:
        b = b.filter(b.column("doc_id").is_valid())
        for at in range(0, b.num_rows, most):
            yield _flat(b.slice(at, most))


# -- the search ----------------------------------------------------------------------------------
def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {top}")


def ranked(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the best ``top`` documents of each row of queries (item_id, text) that score above 0."""
    spark = docs.sparkSession
    asks = stored(asked(queries))
    batches = max(1, math.ceil(asks.count() / SENT_TERMS))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for k in range(batches):  # one, unless the queries hold more than SENT_TERMS terms
        rows = asks.where(F.pmod("query", F.lit(batches)) == k).collect()
        numbers = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
        vectors = stored(counted(docs, numbers))
        count, length = vectors.agg(F.count("*"), F.sum("n")).first()
        if not rows or not count:
            continue
        weights = np.full(len(numbers), weight(count, 0), dtype=np.int64)
        for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term asked for
            weights[r["t"]] = weight(count, r["count"])
        by: dict[int, tuple] = {}
        for r in sorted(rows, key=lambda r: (r["query"], bytes(r["term"]))):
            t = numbers[bytes(r["term"])]
            _, which, w = by.setdefault(r["query"], (r["query"], [], []))
            which.append(t)
            w.append(r["n"] * int(weights[t]))
        ordered = stored(_ordered(vectors, weights, count, length))
        dealt = lambda df: df.repartitionByRange(partitions(spark), "like", "n", "doc_id").sortWithinPartitions("like", "n", "doc_id")
        part = dealt(ordered.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0))
        sampled = _ranked(searched(part, list(by.values()), {}, count, length, top), top).where(F.col("rank") == top)
        least = {r["query"]: r["score"] for r in sampled.collect()}
        found = _ranked(searched(dealt(ordered), list(by.values()), least, count, length, top), top)
        names = asks.where(F.pmod("query", F.lit(batches)) == k).select("query", "item_id").distinct()
        out = out.unionByName(found.join(names, "query").select("item_id", "rank", "doc_id", "score"))
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_lexical_search": op13_lexical_search}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = {
    "op13_lexical_search": f"""
with q as (select item_id, text, unnest({_WORDS}) as term from (select distinct item_id, text from benchmark)),
a as (select item_id, text, term, count(*) as qn from q group by all),
d as (select doc_id, row_number() over () as r, {_WORDS} as w from documents),
s as (select count(*) as big_n, cast(sum(len(w)) as bigint) as big_l from d where len(w) > 0),
t as (select r, term, count(*) as tf from (select r, unnest(w) as term from d) where term in (select term from a) group by r, term),
f as (select term, cast(floor(1000 * ln((2 * big_n + 2) / cast(2 * count(*) + 1 as double))) as bigint) as w from t, s group by term, big_n),
i as (select t.r, t.term, f.w * ((1000000000 * t.tf) // (1000 * t.tf + 12 * (75 + (25 * len(d.w) * s.big_n) // s.big_l))) as part from t join f using (term) join d using (r), s),
g as (select a.item_id, a.text, i.r, cast(sum(a.qn * i.part) as bigint) as score from a join i using (term) group by all),
o as (select g.item_id, d.doc_id, g.score, row_number() over (partition by g.item_id, g.text order by g.score desc, d.doc_id) as rank from g join d using (r) where g.score > 0 and d.doc_id is not null)
select item_id, cast(rank as integer) as rank, doc_id, score from o where rank <= {TOP}"""
}
