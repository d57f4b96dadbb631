"""Nearest neighbours beside brute force: recall, exact scores, ties, awkward vectors."""

import math

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import neighbours as n

SCHEMA = "vec_id long, embedding array<float>, key string, size int, cell long"


def brute(rows, k=5, every=50):
    """Cosines of each query with all ids of its length, best first."""
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if q % every == 0:
            out[q] = sorted(((-float(a @ b / np.sqrt((a @ a) * (b @ b)))), i) for i, b in good if i != q and len(a) == len(b))[:k]
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "k", 0, 0) for i, v in rows], SCHEMA)
    out = {}
    for r in n.neighbours(df, F.col("vec_id") % 50 == 0, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    hits = sum(len({i for _, i in got.get(q, [])} & {i for _, i in w}) for q, w in want.items())
    return hits / max(1, sum(map(len, want.values())))


def test_recall_and_scores_on_the_given_vectors(spark, monkeypatch):
    monkeypatch.setattr(n, "CELL", 200)
    monkeypatch.setattr(n, "BLOCK", 150)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    got, want = found(spark, rows), brute(rows)
    assert set(got) == set(want) and all(len(got[q]) == 5 for q in got)
    assert recall(got, want) >= 0.9
    by = dict(rows)
    for q, g in got.items():
        a = np.array(by[q], dtype=float)
        for s, i in g:
            b = np.array(by[i], dtype=float)
            assert abs(-s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
        assert g == sorted(g)


def test_recall_on_clusters_with_few_visits(spark, monkeypatch):
    """Where near vectors are much nearer than others the stopping test ends early and still finds them."""
    monkeypatch.setattr(n, "CELL", 256)
    monkeypatch.setattr(n, "LEAF", 16)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((200, 32))
    rows = [(i, (centres[i % 200] + 0.05 * rng.standard_normal(32)).tolist()) for i in range(4000)]
    assert recall(found(spark, rows), brute(rows)) >= 0.95
    unit = n.units([v for _, v in rows])
    where = n.directions(32)
    leaves, seen = n.Leaves(unit @ where, 16), []
    monkeypatch.setattr(leaves, "rows", [Seen(r, seen) for r in leaves.rows])
    n.searched(unit, [[i] for i, _ in rows], leaves, unit[0], unit[0] @ where, -1.0, n.radius_factor(), 6)
    assert len(seen) < len(leaves.rows) / 3


class Seen(np.ndarray):
    def __new__(cls, rows, seen):
        out = np.asarray(rows).view(cls)
        out.seen = seen
        return out

    def __getitem__(self, mask):
        self.seen.append(1)
        return np.asarray(self)[mask]


def test_ties_copies_and_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(n, "CELL", 64)
    rng = np.random.default_rng(6)
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(0, 700)] + [(700 + i, rng.standard_normal(3).tolist()) for i in range(100)]
    rows += rows[:30] + [(900, None), (950, []), (1000, [0.0, 0.0, 0.0]), (1050, [1.0, None, 2.0]), (1100, [float("nan"), 1.0, 1.0]), (1150, [float("inf"), 1.0, 1.0]), (None, same), (1200, [5.0, 1.0]), (1201, [5.0, 1.5]), (1250, [1e-30] * 3), (1250, [3e30, 1e30, 2e30]), (1300, [1.0] * 7)]
    got, want = found(spark, rows), brute(rows)
    assert [i for _, i in got[0]] == [1, 2, 3, 4, 5] and [i for _, i in got[50]] == [0, 1, 2, 3, 4]
    assert set(got) == {q for q, w in want.items() if w} and 1300 not in got
    assert [i for _, i in got[1200]] == [1201]
    assert recall(got, {q: w for q, w in want.items() if q > 650 and q != 1250}) >= 0.9
    assert len({i for _, i in got[1250]}) == 5 and 1250 not in {i for _, i in got[1250]}


def test_empty_table(spark):
    assert found(spark, []) == {}


def test_chi_square():
    assert abs(n.chi_square(15.507, 8) - 0.95) < 1e-4 and n.chi_square(0, 8) == 0 and n.chi_square(1e9) == 1
    assert abs(n.radius_factor(0.95, 8) - 15.507) < 1e-3
