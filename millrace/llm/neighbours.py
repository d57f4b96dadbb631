"""Approximate nearest neighbours by low-dimensional stable projections, a kd-tree and a chi-square stopping test.

Vectors are brought to length one, so that the largest cosine is the least distance, and
projected by DIMS Gaussian (2-stable) directions: the squared projected distance of a pair is
its squared distance times a chi-square variable of DIMS degrees. Neighbours of a query are
taken in the order of their projected distance and verified on the original vectors, until
chi-square(projected^2 / kth^2) >= SURE: a vector nearer than the kth found would then lie
beyond that projected distance with probability 1 - SURE at most. So each true neighbour is
found with probability SURE or more, whatever the data.

The upper levels of the kd-tree are fitted on at most SAMPLE projected vectors (those of the
least hash of their content) and cut the projected space into cells of about CELL vectors;
every vector is dealt to its cell, and a cell with more than BLOCK of them, by a hash, to
several blocks. A query first visits one block of its own cell, which bounds its kth
distance, then the blocks of all cells whose boxes lie within the radius of that bound. Within a block a
tree of leaves is built, and leaves are visited in the order of the projected distance of
their boxes. Blocks and the queries that visit one are groups of bounded size.

Equal vectors are one point that carries the least K + 1 of their ids, and one search. The
tree's cells and the boxes (SAMPLE / LEAF at most) are all that the driver holds.

Defined results: null or empty vectors, zero vectors and those with null or non-finite
components take no part; vectors of different lengths are never compared; rows that repeat an
id and a vector are one; all rows of a query's id are its own, and none is its neighbour.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

K, DIMS, SURE = 5, 8, 0.95
SAMPLE, CELL, BLOCK, LEAF, QUERIES_AT_ONCE = 32_768, 8_192, 16_384, 128, 2_048
EVERY = 50


def chi_square(x: float, dims: int = DIMS) -> float:
    """Distribution function at x; an even number of degrees has a closed form."""
    half, term, total = x / 2, 1.0, 0.0
    if half > 700:
        return 1.0
    for j in range(dims // 2):
        total += term
        term *= half / (j + 1)
    return 1.0 - math.exp(-half) * total


def radius_factor(sure: float = SURE, dims: int = DIMS) -> float:
    """The squared projected distance at which the stopping test holds, in squared kth distances."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < sure else (low, mid)
    return high


def directions(size: int, dims: int = DIMS) -> np.ndarray:
    """The projection of vectors of one length; vectors of another length have another one."""
    return np.random.default_rng([20_11, size]).standard_normal((size, dims))


def units(vectors) -> np.ndarray:
    """Rows of length one. Lengths are taken row by row in one order, so equal rows stay equal."""
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def keyed(vectors: DataFrame, ids: str, vector: str) -> DataFrame:
    """_id, key and vector, once each, of the rows that take part."""
    good = F.filter(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))  # no negative zeros
    rows = vectors.where(F.col(ids).isNotNull() & (F.size(vector) > 0) & (F.size(good) == F.size(vector)) & F.exists(vector, lambda x: x != 0)).select(F.col(ids).alias("_id"), v.alias("vector"))
    return rows.withColumn("key", F.concat_ws(":", F.xxhash64("vector"), F.xxhash64(F.lit(7), "vector"))).groupBy("_id", "key").agg(F.first("vector").alias("vector"))


def points(vectors: DataFrame, ids: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """One row for each different vector: key, size, vector, ids (its k + 1 least)."""
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("_id"))
    few = keyed(vectors, ids, vector).withColumn("salt", F.pmod(F.xxhash64("_id"), F.lit(64))).withColumn("n", nth("key", "salt")).where(f"n <= {k + 1}").withColumn("n", nth("key")).where(f"n <= {k + 1}")
    return few.groupBy("key").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("_id")).alias("ids")).withColumn("size", F.size("vector"))


# -- the upper tree ------------------------------------------------------------------------------
class Cells:
    """Cuts of the projected space, fitted on a sample: a leaf for each cell, halved along the widest direction."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.cuts: list[tuple] = []  # axis, value, left, right; a leaf is ~cell
        self.n = 0
        self.root = self._grow(sample, max(1, cells))

    def _grow(self, x: np.ndarray, cells: int) -> int:
        spread = np.ptp(x, axis=0) if len(x) > 1 else np.zeros(DIMS)
        axis = int(spread.argmax())
        if cells < 2 or not spread[axis] > 0:
            self.n += 1
            return ~(self.n - 1)
        value = float(np.median(x[:, axis]))
        left = x[:, axis] < value
        if not left.any():
            value = float(np.nextafter(value, np.inf))
            left = x[:, axis] < value
        if left.all():
            self.n += 1
            return ~(self.n - 1)
        at = len(self.cuts)
        self.cuts.append(())
        self.cuts[at] = (axis, value, self._grow(x[left], cells // 2), self._grow(x[~left], cells - cells // 2))
        return at

    def cell(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = ~node
                continue
            axis, value, left, right = self.cuts[node]
            low = x[rows, axis] < value
            stack += [(left, rows[low]), (right, rows[~low])]
        return out

    def within(self, q: np.ndarray, square: float) -> list[int]:
        """Cells whose region comes within that squared distance of q."""
        out, stack = [], [(self.root, np.zeros(DIMS))]
        while stack:
            node, off = stack.pop()
            if float((off * off).sum()) > square:
                continue
            if node < 0:
                out.append(~node)
                continue
            axis, value, left, right = self.cuts[node]
            gap = q[axis] - value
            near, far = (left, right) if gap < 0 else (right, left)
            other = off.copy()
            other[axis] = max(abs(gap), off[axis])
            stack += [(near, off), (far, other)]
        return out


# -- within a block ------------------------------------------------------------------------------
class Leaves:
    """A kd-tree over a block's projected points as its leaves: rows of each, and their boxes."""

    def __init__(self, projected: np.ndarray, leaf: int = LEAF):
        order, stack, ends = np.arange(len(projected)), [(0, len(projected))], []
        while stack:
            a, b = stack.pop()
            part = projected[order[a:b]]
            if b - a <= leaf:
                ends.append((a, b, part.min(axis=0), part.max(axis=0)))
                continue
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, np.ptp(part, axis=0).argmax()], mid)]
            stack += [(a, a + mid), (a + mid, b)]
        self.rows = [order[a:b] for a, b, _, _ in ends]
        self.low, self.high = np.array([e[2] for e in ends]), np.array([e[3] for e in ends])

    def distances(self, q: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return (gap * gap).sum(axis=1)


def searched(unit: np.ndarray, ids: list, leaves: Leaves, q: np.ndarray, projected: np.ndarray, bound: float, factor: float, keep: int) -> list[tuple]:
    """(-cosine, id) of the least ``keep`` found among a block's ids; bound: a cosine that the keep-th nearest is known to reach."""
    best: list[tuple] = []
    off = leaves.distances(projected)
    for leaf in np.argsort(off, kind="stable"):
        kth = -best[-1][0] if len(best) >= keep else -2.0
        if off[leaf] > factor * (2 - 2 * max(kth, bound)) + 1e-9:  # the stopping test: no leaf from here on comes nearer
            break
        rows = leaves.rows[leaf]
        near = rows[(unit[rows] @ q) >= max(kth, bound) - 1e-9]
        if not len(near):
            continue
        cosines = (unit[near] * q).sum(axis=1)  # row by row in one order: the same vector scores the same anywhere
        best += [(-float(c), i) for c, r in zip(cosines, near, strict=True) for i in ids[r]]
        seen: set = set()  # an id counts by its nearest vector
        best = [x for x in sorted(best) if not (x[1] in seen or seen.add(x[1]))][:keep]
    return best


# -- in Spark ------------------------------------------------------------------------------------
def _trees(found: DataFrame) -> dict[int, Cells]:
    """The upper tree of each length of vectors, from a bounded sample and a count; lengths are few, and share the sample."""
    counts = {r["size"]: r["count"] for r in found.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1024).collect()}
    few = found.where(F.col("size").isin(list(counts))) if counts else found
    drawn = few.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("size", "vector")
    by: dict[int, list] = {}
    for r in drawn.select("size", _projected(drawn)).toLocalIterator():
        by.setdefault(r["size"], []).append(r["projected"])
    return {size: Cells(np.array(rows), min(-(-counts[size] // CELL), max(1, len(rows) // 16))) for size, rows in by.items()}


def _projected(df: DataFrame):
    @F.pandas_udf("array<double>")
    def project(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        sizes = vectors.map(len)
        out = pd.Series([None] * len(vectors), index=vectors.index, dtype=object)
        for size in sizes.unique():
            mine = vectors[sizes == size]
            out[mine.index] = list(units(mine) @ directions(size))
        return out

    return project("vector").alias("projected")


def _dealt(found: DataFrame, trees: dict[int, Cells]) -> DataFrame:
    """found with projected and cell."""
    shared = found.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("long")
    def cell(sizes: pd.Series, projected: pd.Series) -> pd.Series:
        out = np.zeros(len(sizes), dtype=np.int64)
        for size in sizes.unique():
            mine = (sizes == size).to_numpy()
            if size in shared.value:
                out[mine] = shared.value[size].cell(np.array(list(projected[mine])))
        return pd.Series(out)

    return found.withColumn("projected", _projected(found)).withColumn("cell", cell("size", "projected"))


def _visits(asks: DataFrame, blocks: DataFrame, keep: int, factor: float) -> DataFrame:
    """asks (key, size, cell, block, vector, bound) against blocks of points: key, id, cosine of what each visit keeps."""
    schema = f"key string, id {blocks.schema['ids'].dataType.elementType.simpleString()}, cosine double"

    def visit(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(p):
            unit, asked = units(p["vector"]), units(q["vector"])
            where = directions(unit.shape[1])
            leaves, ids = Leaves(unit @ where), list(p["ids"])
            for key, v, bound in zip(q["key"], asked, q["bound"], strict=True):
                out += [(key, i, -c) for c, i in searched(unit, ids, leaves, v, v @ where, bound, factor, keep)]
        return pd.DataFrame(out, columns=["key", "id", "cosine"])

    by = ["size", "cell", "block", "turn"]
    return asks.groupBy(*by).cogroup(blocks.groupBy(*by)).applyInPandas(visit, schema)


def _least(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.desc("cosine"), "id")
    return found.groupBy("key", "id").agg(F.max("cosine").alias("cosine")).withColumn("n", F.row_number().over(order)).where(f"n <= {keep}")


def neighbours(vectors: DataFrame, is_query, ids: str = "vec_id", vector: str = "embedding", k: int = K, sure: float = SURE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that is_query (a condition on ids) selects."""
    keep, factor = k + 1, radius_factor(sure)
    found = stored(points(vectors, ids, vector, k))
    trees = _trees(found)
    held = stored(_dealt(found, trees))
    sizes = held.groupBy("size", "cell").count().select("size", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    salt = lambda n, c="key": F.pmod(F.xxhash64(F.lit(3), c), n).cast("int")
    spread = stored(held.join(sizes, ["size", "cell"]).withColumn("block", salt(F.col("blocks"))))

    pairs = stored(keyed(vectors.where(is_query), ids, vector).select(F.col("_id").alias("query_id"), "key"))
    asks = spread.join(pairs.select("key").distinct(), "key", "left_semi").select("key", "size", "cell", "block", "vector", "projected")

    def met(wanted: DataFrame) -> DataFrame:
        """Visits dealt in turns of bounded size, the points of a block with each."""
        turns = wanted.groupBy("size", "cell", "block").count().select("size", "cell", "block", F.ceil(F.col("count") / QUERIES_AT_ONCE).cast("int").alias("turns"))
        mine = wanted.join(turns, ["size", "cell", "block"]).withColumn("turn", F.pmod(F.xxhash64(F.lit(5), "key"), F.col("turns")).cast("int"))
        theirs = spread.join(turns, ["size", "cell", "block"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
        renewed = lambda df, *names: df.select(*(F.col(c).alias(c) for c in names))  # noqa: E731  both sides come from one table
        return _visits(renewed(mine, "key", "size", "cell", "block", "turn", "vector", "bound"), renewed(theirs, "size", "cell", "block", "turn", "vector", "ids"), keep, factor)

    first = met(asks.withColumn("bound", F.lit(-1.0)))
    bounds = stored(_least(first, keep).groupBy("key").agg(F.when(F.count("*") == keep, F.min("cosine")).otherwise(-1.0).alias("bound")))
    shared = vectors.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("array<long>")
    def cells(size: pd.Series, projected: pd.Series, bound: pd.Series) -> pd.Series:
        at = lambda s, p, b: shared.value[s].within(np.asarray(p), factor * (2 - 2 * b) + 1e-9) if s in shared.value else [0]
        return pd.Series([at(*x) for x in zip(size, projected, bound, strict=True)])

    wanted = asks.drop("block").join(bounds, "key", "left").withColumn("bound", F.coalesce("bound", F.lit(-1.0)))
    wanted = wanted.withColumn("cell", F.explode(cells("size", "projected", "bound"))).join(sizes, ["size", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    best = stored(_least(met(wanted), keep))
    own = best.join(pairs, "key").where(F.col("id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    # an id may stand for several vectors: its nearest one counts
    once = own.groupBy("query_id", "id").agg(F.max("cosine").alias("cosine"))
    return once.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", F.col("id").alias("vec_id"), F.col("cosine").alias("score"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op12_nearest_neighbours": op12_nearest_neighbours}
SQL: dict[str, str] = {}
