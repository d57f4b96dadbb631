"""Every registered query of the library beside its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from millrace.queries import ENTRY, QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else float(f"{x:.9g}")
        return x

    return sorted([tuple(plain(r[i]) for i in order) for r in found], key=repr)


def tail(spark, found):
    for r in found:
        n, k = r["b"] + r["c"], min(r["b"], r["c"])
        assert abs(r["p"] - (min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0)) < 1e-9
    assert len(found) == 6


def intervals(spark, found):
    by = {(r["method"], r["metric"]): r for r in found}
    points = {r["method"]: r for r in QUERIES["consensus_metrics"](spark, SF).collect()} if "consensus_metrics" in QUERIES else {}
    assert len(by) == len(found) and all(r["low"] <= r["high"] and r["replicates"] == 10_000 for r in found)
    assert any(by[m, "coverage"]["high"] < 1 and by[m, "abstention_rate"]["low"] > 0 for m in {r["method"] for r in found})  # open rows are drawn too
    for m, r in points.items():
        assert by[m, "f1"]["low"] - 1e-9 <= r["f1"] <= by[m, "f1"]["high"] + 1e-9


def digest(spark, found):
    from millrace.operators import consensus

    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select(consensus.record_digest("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").alias("h"))
    again = consensus.table_digest(rows.repartition(7, "h"), "h").first()
    less = consensus.table_digest(rows.where("h < 'f'"), "h").first()
    assert [(r["n"], r["digest"]) for r in found] == [(again["n"], again["digest"])] and less["digest"] != again["digest"]


def flips(spark, found):
    assert len(found) == 6 and all(0 < r["p"] <= 1 and r["clusters"] > 1 and abs(r["observed"]) <= 1 for r in found)
    assert min(found, key=lambda r: abs(r["observed"]))["p"] >= max(found, key=lambda r: abs(r["observed"]))["p"]


def named_roles(spark, found):
    assert all(r["agent"] != r["target"] for r in found)


WITHOUT_SQL = {"mcnemar_exact": tail, "bootstrap_intervals": intervals, "table_digest": digest, "paired_sign_flip": flips, "collision_roles": named_roles}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.collect(), df.columns)
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows(want.fetchall(), want.columns)
    else:
        WITHOUT_SQL[name](spark, [r.asDict() for r in df.collect()])


def test_entry(spark):
    assert ENTRY(spark, SF).count() > 0
