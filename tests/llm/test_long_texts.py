"""Megabytes of what patterns repeat over: no text may end a JVM or take more than seconds."""

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, decontamination, lexical, line_dedup, pseudonyms, quality_rules, secrets

MB = 1 << 20
TEXTS = {
    "digits and dots": "1." * MB, "names": "see Ab " + "Cd " * (MB // 2), "one run": "acgt" * (MB // 2), "mail-like dots": "x@" + "a." * MB + "com", "mail run": "a.b" * (MB // 2) + "@example.org",
    "secrets": "password=abcdefgh12345X token: zyxwvuts98765Q\n" * 25_000, "sentences": "This is one sentence. " * 60_000, "lines": "a line of text\n" * 90_000,
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i}", len(t)) for i, t in enumerate(TEXTS.values())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(len(TEXTS), "doc_id").cache()


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "How far does a train travel in 12 hours at 80 km an hour if it stops twice for ten minutes?"), (2, "This is one sentence. " * 6)], "item_id long, text string")
    assert [tuple(r) for r in decontamination.leaks(docs, items).select("doc_id", "item_id").collect()] == [(6, 2)]


def test_pseudonyms(spark, docs):
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymised(docs, "k").select("doc_id", "text", "_text", "_kinds").collect()}
    assert all(got[i]["_text"].endswith("@example.invalid") and len(got[i]["_text"]) < 100 for i in (3, 4))
    assert got[3]["_kinds"] == ["mail"] and got[2]["_text"] == got[2]["text"]


def test_secrets(spark, docs):
    got = {r["doc_id"]: r for r in secrets.scanned(docs, F.col("source"), F.col("source")).collect()}
    assert got[5]["n_assign"] == 50_000 and got[0]["n_assign"] == 0
    assert got[5]["spans"].count(",") == 49_999


def test_lines_rules_tokens_and_terms(spark, docs):
    assert line_dedup.without_boilerplate(docs, "source", "text").count() == len(TEXTS)
    rules = {r["doc_id"]: r for r in quality_rules.judged(docs, spark.createDataFrame([], "doc_id long, quality int"), ["doc_id"]).collect()}
    assert rules[7]["n_dup_lines"] == 89_999 and rules[2]["n_words"] == 1
    assert {r["doc_id"] for r in bpe.encoded(docs.where("doc_id > 4"), bpe.vocabulary()).collect()} == {5, 6, 7}
    found = {r["doc_id"]: r["n"] for r in lexical.counted(docs, {b"1": 0}).collect()}
    assert found[0] == MB and found[2] == 1


def test_texts_are_as_long_as_they_are_said_to_be():
    assert all(len(t) >= MB for t in TEXTS.values()) and len({hashlib.sha256(t.encode()).hexdigest() for t in TEXTS.values()}) == len(TEXTS)
