"""Lexical search beside brute force: random, awkward, tied and repeated documents, several batches and slices."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from millrace.llm import lexical as x

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
words = lambda t: TERM.findall((t or "").translate(LOWER))


def brute(docs, items):
    held = [(i, words(t)) for i, t in docs]
    held = [(i, w, Counter(w)) for i, w in held if w]
    n, length = len(held), sum(len(w) for _, w, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, w, c in held:
            m = 100 - 25 + (25 * len(w) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:20])]
    return sorted(out, key=repr)


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "q", 1, "l") for i, t in docs], "doc_id long, text string, query string, n int, like string")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, term int")
    return sorted((tuple(r) for r in x.ranked(d, q).collect()), key=repr)


def corpus(seed, n):
    rnd = random.Random(seed)
    names = [f"w{k}" for k in range(300)] + ["Ünï", "北京", "x y", "A1"]
    draw = lambda k: " ".join(names[min(int(rnd.expovariate(0.02)), len(names) - 1)] + rnd.choice(["", ".", "-", "\n"]) for _ in range(k))
    docs = [(i, draw(rnd.randrange(1, 60))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(60)]  # ties beyond the top
    return docs, [(k, docs[k * 7][1].upper() if k % 2 else draw(12)) for k in range(25)]


AWKWARD = [(1000, None), (1001, ""), (1002, " \n.,"), (1003, "w1 " * 200_000), (None, "w1 w2 w3"), (1004, "w5 w6"), (1004, "w5 w6")]


def test_search_against_brute_force(spark, monkeypatch):
    docs, items = corpus(1, 500)
    docs += AWKWARD
    items += [(90, None), (91, "nowhere123"), (92, "w1"), (92, "w2 w2 w3"), (None, "w7 w8"), items[0]]
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    monkeypatch.setattr(x, "CELLS", 64 * 100)  # small slices
    monkeypatch.setattr(x, "BLOCK", 4)
    monkeypatch.setattr(x, "SENT_TERMS", 100)  # several batches of queries
    assert found(spark, docs, items) == want


def test_empty_tables(spark):
    docs, items = corpus(2, 180)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []


def test_blocks_are_skipped_and_bounds_hold():
    rng = np.random.default_rng(3)
    x_ = np.zeros((256, 40), dtype=np.float32)
    for r in range(256):  # eight clusters of documents that share five terms each
        x_[r, 5 * (r // 32) + rng.integers(0, 5, 4)] = rng.integers(1, 1_000_000, 4)
    q = x.Queries([(1, [0, 1, 2, 5, 35], [900, 800, 700, 5, 3])])
    scores = x_[:, q.columns[0]].astype(np.int64) @ q.weights[0] if len(q.terms) == 40 else x_[:, q.terms][:, q.columns[0]].astype(np.int64) @ q.weights[0]
    least = int(np.sort(scores)[-20])
    rows = x.candidates(x_[:, q.terms], q, [least], block=8)[0]
    assert set(np.flatnonzero(scores >= least)) <= set(rows) and len(rows) < 64


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_search_against_sql(spark, sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '/root/testdata/{sf}/{t}.parquet'")
    got = x.op13_lexical_search(spark, f"/root/testdata/{sf}").select("item_id", "rank", "doc_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(f"select item_id, rank, doc_id, score from ({x.SQL['op13_lexical_search']})").fetchall())
