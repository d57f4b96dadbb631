"""Line dedup by site-relative frequency.

For each host, the share of its pages that hold a line; lines whose share exceeds the
boilerplate ratio, on at least ``min_pages`` pages, are dropped from every page of that
host. A line is compared without blanks at its ends; blank lines are never counted or
dropped. Only digests of lines are shuffled; a host can have at most (mean lines a page /
ratio) lines over the ratio, so a host's list is bounded. All lists are sent to every task if
they have SENT_LINES digests at most; beyond that pages meet them by host and a salt.

Defined results: a null host is a host of its own; a null text stays null; an empty text
stays empty; a page that repeats a line counts once for it; rows that repeat are pages of
their own; a page that loses every line keeps an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

RATIO, MIN_PAGES = 0.1, 5
SENT_LINES, SALTS = 200_000, 64


def _trimmed(line):
    return F.btrim(line, F.lit(" \t\r"))


def _digest(line):
    """128 bits of a line as one string; longs of two seeds."""
    return F.concat_ws(":", F.xxhash64(line), F.xxhash64(F.lit(7), line))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, lines: digests of the lines over the ratio, one row for each host that has any."""
    lines = F.array_distinct(F.transform(F.split(F.col(text), "\n"), _trimmed))
    each = pages.where(F.col(text).isNotNull()).select(
        F.col(host).alias("_host"),
        F.explode(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))).alias("_line"),
    )
    counted = each.groupBy("_host", "_line.a", "_line.b").agg(F.count("*").alias("_pages")).where(F.col("_pages") >= min_pages)
    totals = pages.where(F.col(text).isNotNull()).groupBy(F.col(host).alias("_of")).agg(F.count("*").alias("_total"))
    return (
        counted.join(totals, F.col("_host").eqNullSafe(F.col("_of"))).where(F.col("_pages") > ratio * F.col("_total"))
        .groupBy("_host").agg(F.collect_list(F.concat_ws(":", "a", "b")).alias("_lines"))
    )


def without_boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, sent_lines: int = SENT_LINES) -> DataFrame:
    """Every row and column of pages, and _kept: its lines that stay, _n_lines and _n_dropped."""
    found = stored(boilerplate(pages, host, text, ratio, min_pages))
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("_lines"), _digest(_trimmed(x))), F.lit(False)) | (_trimmed(x) == ""))
    same = F.col(host).eqNullSafe(F.col("_host"))
    if (found.agg(F.sum(F.size("_lines"))).first()[0] or 0) <= sent_lines:
        met = pages.join(F.broadcast(found), same, "left")  # at most SENT_LINES digests
    else:
        salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        mine = F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")
        met = pages.join(salted, same & (mine == F.col("_salt")), "left").drop("_salt")
    return (
        met
        .withColumn("_kept", F.when(F.col("_lines").isNull(), lines).otherwise(kept))
        .withColumn("_n_lines", F.coalesce(F.size(lines), F.lit(0))).withColumn("_n_dropped", F.coalesce(F.size(lines) - F.size("_kept"), F.lit(0)))
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return without_boilerplate(docs, "source", "text").select(
        "doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_dropped").cast("long").alias("n_dropped"), F.array_join("_kept", "\n").alias("text")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the lines that stay; every row stays, n_chars follows the text."""
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col("source").alias("_source"), F.col("text").alias("_text"))
    done = without_boilerplate(row, "_source", "_text").withColumn("_new", F.array_join("_kept", "\n"))
    out = {"text": F.col("_new"), "n_chars": F.length("_new").cast("long")}
    return done.select(*(out[c].alias(c) if c in out else F.col("_row")[c].alias(c) for c in docs.columns))


QUERIES = {"op6_line_dedup": op6_line_dedup}
SQL = {
    "op6_line_dedup": f"""
with d as (select doc_id, text, source, row_number() over () as r from documents),
l as (select r, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from d where text is not null),
t as (select r, source, line, pos, trim(line, ' ' || chr(9) || chr(13)) as key from l),
pages as (select source, key, count(distinct r) as n from t where key <> '' group by source, key),
totals as (select source, count(*) as total from d where text is not null group by source),
bad as (select p.source, p.key from pages p join totals o on p.source is not distinct from o.source where p.n >= {MIN_PAGES} and p.n > {RATIO} * o.total),
m as (select t.*, bad.key is not null as dropped from t left join bad on t.source is not distinct from bad.source and t.key = bad.key),
g as (select r, count(*) as n_lines, count(*) filter (where dropped) as n_dropped, coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '') as text from m group by r)
select d.doc_id, cast(coalesce(g.n_lines, 0) as bigint) as n_lines, cast(coalesce(g.n_dropped, 0) as bigint) as n_dropped, g.text
from d left join g on d.r = g.r"""
}
