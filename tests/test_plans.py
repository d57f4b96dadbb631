"""What plans must not hold: steps that are worked out again for each reader, and tables sent by the size of their files."""

import re

import pytest

from millrace.operators import funnel, graphs, scenarios, spans
from millrace.plans.base import read, spread
from millrace.plans.evaluation import trace_outcomes
from millrace.plans.extraction import PROSE
from millrace.plans.scenarios import fault_tables, faulty
from millrace.sources.scratch import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plan(capsys):
    def of(df, *mode):
        capsys.readouterr()
        df.explain(*mode)
        return capsys.readouterr().out

    return of


def test_stored_tables_are_not_sent_by_the_size_of_their_files(spark, plan):
    a, b = stored(spark.range(100)), stored(spark.range(50).selectExpr("id", "id + 1 as n"))
    met = a.join(b.where("n > 3"), "id", "left")
    assert "BroadcastHashJoin" not in plan(met) and met.where("n is null").count() == 53


def test_ends_of_sentences_are_cut_without_patterns(spark, plan):
    blank = [chr(c) for c in range(0x3100) if chr(c).isspace() and chr(c) != "\n"]
    texts = [f"{b}{b}a{b}b.{b}" for b in blank] + [f"​{b}c" for b in blank] + ["".join(blank)]
    found = spans.sentences(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), ["id"], "t")
    assert "regexp_replace" not in plan(found)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["id"], r["start"])):
        got.setdefault(r["id"], []).append((r["start"], r["end"], r["quote"]))
    for i, t in enumerate(texts[:-1]):
        assert got[i] == [(t.index(t.strip()), t.index(t.strip()) + len(t.strip()), t.strip())]
    assert got[len(texts) - 1] == [(0, len(texts[-1]), texts[-1])]


def test_graph_tables_read_roles_and_drivers_that_are_worked_out_once(spark, plan):
    d = read(spark, SF, "documents").limit(20)
    g = graphs.extracted(d, "doc_id", "text", "source", PROSE)
    assert not any(re.search(r"[Cc]ontains\(quote#\d+, label#|collect_set", plan(t)) for t in (g.nodes, g.edges, g.evidence, g.heads))
    assert plan(graphs.verified(stored(g.evidence), stored(d), "doc_id", "text")).count("FileScan parquet") == 2


def test_graphs_are_made_beside_their_texts(spark, plan):
    d = read(spark, SF, "documents").limit(20)
    g = graphs.extracted(d, "doc_id", "text", "source", PROSE)
    assert not any("Exchange" in plan(t) or "Window" in plan(t) for t in g)


def test_texts_are_cut_into_sentences_once(spark, plan):
    stops = re.compile(r"[^.!?。\n]+[.!?。]?")
    texts = ["a tion. b of c!\n\n d? ", "..", " . ", "", "\n \n", "tion", "\U0001f600tion。of x\n.ment", "a\r\nb..c . !"]
    found = spans.sentences(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), ["id"], "t")
    assert plan(found).count("regexp_extract_all") == 0
    got = sorted((r["id"], r["start"], r["end"], r["quote"]) for r in found.collect())
    want = []
    for i, t in enumerate(texts):
        own = [(i, m.start() + len(m[0]) - len(m[0].lstrip()), m[0].strip()) for m in stops.finditer(t) if m[0].strip()] or [(i, 0, t)]
        want += [(i, at, at + len(q), q) for i, at, q in own]
    assert got == want


def test_contract_fields_read_each_text_once(spark, plan):
    d = read(spark, SF, "documents").limit(20).selectExpr("doc_id", "text", "source", "'A' as tier")
    g = graphs.Graph(*map(stored, graphs.extracted(d, "doc_id", "text", "source", PROSE)))
    c = scenarios.compiled(g, stored(d), "doc_id", "text", "tier")
    assert plan(c.fields).count("FileScan parquet") <= 5
    assert c.fields.where("path = 'topology'").count() == 20


def test_faulty_fields_keep_the_clean_value(spark, plan):
    _, f = faulty(spark, SF)
    rows = f.fields.where("not (value <=> clean)").groupBy("trial_id").count().collect()
    assert rows and all(r["count"] == 1 for r in rows)
    assert plan(fault_tables(spark, SF)).count("FileScan parquet") <= 12


def test_few_files_are_dealt_out_once(spark, plan):
    d = spread(read(spark, SF, "documents").select("doc_id", "text"), "doc_id")
    assert "Exchange" not in plan(d) and d.count() == read(spark, SF, "documents").count()


def test_rows_are_labelled_once_for_their_counts_and_totals(spark, plan):
    df = stored(spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "label string, end string"))
    n, ends = funnel.stage_table(df, "label"), funnel.routed_table(df, "label", "end", "a")
    assert all(plan(t).count("FileScan parquet") == 1 for t in (n, ends))
    assert sorted(n.collect(), key=str) == sorted([("a", 2, 50.0), ("b", 1, 25.0), (None, 1, 25.0)], key=str)
    assert sorted(ends.collect()) == [("x", 1, 50.0, 25.0), ("y", 1, 50.0, 25.0)]


def test_traces_are_dealt_out_once_by_order(spark, plan):
    text = plan(trace_outcomes(spark, SF))
    assert text.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in text
