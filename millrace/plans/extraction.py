"""Queries of spans and relations on documents, with terms for their invented prose."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import spans
from millrace.plans.base import read, registry, spread

query, QUERIES, SQL = registry()

PROSE = spans.Terms(
    mentions=(r"(?:[Tt]he|[Dd]er) (?:th|er|un)[a-z]{1,6}", r"[A-Z][a-z]{2,8} (?:ation|of|und)", r"(?:son|de) [a-z]{2,5}ment"),
    collisions=("tion", "keit", "ment"),
    maneuvers=(("stop", " and the "), ("turn", "ation"), ("merge", " der ")),
    statuses=(("party_claim", ("idiot", "Licensed")), ("accepted_fact", ("tion ", "lich ")), ("court_reasoning", ("que", "and"))),
    gate=" of ", driver=r"([A-Za-z]{1,20}) of ", roles=("the ", "der ", "The ", "Der "),
    instrument=r"(?:en|er)(?:\s|,|$)", object=r"(?:e|n)(?:\s|,|$)", subject=r"(?:o|a)(?:\s|,)",
)


def docs(spark, sf):
    return spread(read(spark, sf, "documents").select("doc_id", "text", "source"), "doc_id")


SENT_SQL = r"""with m as (select doc_id, unnest(regexp_extract_all(text, '[^.!?。\n]+[.!?。]?')) as q, unnest(list_transform(regexp_split_to_array(text, '[^.!?。\n]+[.!?。]?')[1:len(regexp_extract_all(text, '[^.!?。\n]+[.!?。]?'))], lambda p: length(p))) as gap,
 unnest(range(len(regexp_extract_all(text, '[^.!?。\n]+[.!?。]?')))) as pos from documents where regexp_matches(text, '[^.!?。\n]+[.!?。]?')),
p as (select *, sum(gap + length(q)) over (partition by doc_id order by pos) - length(q) as s from m),
b as (select doc_id, s + length(regexp_extract(q, '^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]*', 0)) as s, regexp_replace(q, '^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+|[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+$', '', 'g') as quote from p),
sent as (select doc_id, cast(s as bigint) as start, cast(s + length(quote) as bigint) as stop, quote from b where quote <> ''
 union all select doc_id, 0, length(text), text from documents where text is not null and doc_id not in (select doc_id from b where quote <> ''))
"""


@query("sentence_spans", SENT_SQL + 'select doc_id, start, stop as "end", md5(quote) as quote from sent')
def sentence_spans(spark, sf):
    return spans.sentences(docs(spark, sf), ["doc_id"], "text").select("doc_id", "start", "end", F.md5("quote").alias("quote"))


STATUS_SQL = "case when contains(quote, 'idiot') or contains(quote, 'Licensed') then 'party_claim' when contains(quote, 'tion ') or contains(quote, 'lich ') then 'accepted_fact' when contains(quote, 'que') or contains(quote, 'and') then 'court_reasoning' else 'unknown' end"


@query("span_status", SENT_SQL + f"select doc_id, {STATUS_SQL} as status, count(*) as n from sent group by all")
def span_status(spark, sf):
    s = spans.sentences(docs(spark, sf), ["doc_id"], "text")
    return s.groupBy("doc_id", spans.legal_status(F.col("quote"), PROSE).alias("status")).agg(F.count("*").alias("n"))


MENTION_SQL = r"""with e as (select doc_id, text, list_transform(regexp_extract_all(text, '(?:[Tt]he|[Dd]er) (?:th|er|un)[a-z]{1,6}') || regexp_extract_all(text, '[A-Z][a-z]{2,8} (?:ation|of|und)') || regexp_extract_all(text, '(?:son|de) [a-z]{2,5}ment'), lambda m: trim(m)) as l from documents),
x as (select doc_id, text, unnest(l) as label, unnest(range(len(l))) as i from e), u as (select doc_id, any_value(text) as text, label, min(i) as i from x group by doc_id, label),
k as (select * from u where not exists (select 1 from u o where o.doc_id = u.doc_id and o.label <> u.label and contains(o.label, u.label))),
nodes as (select doc_id, row_number() over (partition by doc_id order by i) - 1 as ord, label, strpos(text, label) - 1 as source_start from k)
"""


@query("entity_mentions", MENTION_SQL + "select doc_id, 'vehicle_' || (ord + 1) as node_id, cast(ord as int) as ord, label, cast(source_start as int) as source_start from nodes")
def entity_mentions(spark, sf):
    return spans.mention_nodes(docs(spark, sf), "doc_id", "text", PROSE)


@query("evidence_rows", SENT_SQL + "select doc_id, 'ev_' || substr(sha256(source || '|' || start || '|' || stop || '|' || quote), 1, 12) as evidence_id, start, sha256(text) as source_text_sha256, cast(0.9 as double) as confidence from sent join documents using (doc_id)")
def evidence_rows(spark, sf):
    d = docs(spark, sf)
    s = spans.sentences(d.withColumn("source_text_sha256", F.sha2("text", 256)), ["doc_id", "source", "source_text_sha256"], "text")
    return spans.evidence(s, "doc_id", "source", "sentence", 0.9).select("doc_id", "evidence_id", "start", "source_text_sha256", "confidence")


CLAUSE_SQL = SENT_SQL + """, v as (select *, greatest(case when contains(quote, 'tion') then length(quote) - strpos(reverse(quote), 'noit') + 1 - 4 else -1 end, case when contains(quote, 'keit') then length(quote) - strpos(reverse(quote), 'tiek') + 1 - 4 else -1 end,
 case when contains(quote, 'ment') then length(quote) - strpos(reverse(quote), 'tnem') + 1 - 4 else -1 end) as verb from sent), c as (select *, row_number() over (partition by doc_id order by start) as clause from v where verb >= 0)
"""


@query("collision_clauses", CLAUSE_SQL + "select doc_id, cast(clause as int) as clause, start, cast(start + verb as bigint) as verb_start from c")
def collision_clauses(spark, sf):
    c = spans.clauses(spans.sentences(docs(spark, sf), ["doc_id"], "text"), "doc_id", PROSE)
    return c.select("doc_id", "clause", "start", F.col("verb_start").cast("long").alias("verb_start"))


ROLE_SQL = MENTION_SQL + CLAUSE_SQL.replace("with m as", ", m as", 1) + r""", near as (select c.doc_id, clause, quote, verb, 'vehicle_' || (ord + 1) as node_id, label from c join nodes n on n.doc_id = c.doc_id and contains(quote, label)),
cut as (select *, string_split(quote, label) as pieces from near), occ as (select *, unnest(range(1, len(pieces))) as i from cut), at_ as (select *, length(array_to_string(pieces[1:i], '')) + (i - 1) * length(label) as begin from occ),
aft as (select *, substr(quote, begin + length(label) + 1, greatest(verb - begin - length(label), 0)) as suffix from at_ where begin < verb),
mk as (select *, regexp_matches(suffix, '^(?s:.{0,35}?)(?:e|n)(?:\s|,|$)') as obj, regexp_matches(suffix, '^(?s:.{0,35}?)(?:en|er)(?:\s|,|$)') as ins, regexp_matches(suffix, '(?:o|a)(?:\s|,)') as sub from aft),
gr as (select doc_id, clause, count(distinct node_id) as k, arg_max(node_id, begin) filter (where obj) as target, arg_max(node_id, begin) filter (where ins) as agent, arg_min(node_id, begin) as head, arg_min(sub, begin) as sub from mk group by all),
pr as (select doc_id, clause, case when agent is not null and target is not null and agent <> target then agent when sub and target is not null and head <> target then head end as agent, target from gr where k >= 2)
select doc_id, cast(clause as int) as clause, agent, target from pr where agent is not null and target is not null"""


@query("collision_roles", ROLE_SQL)
def collision_roles(spark, sf):
    d = docs(spark, sf)
    return spans.roles(spans.clauses(spans.sentences(d, ["doc_id"], "text"), "doc_id", PROSE), spans.mention_nodes(d, "doc_id", "text", PROSE), "doc_id", PROSE)


def _occ(kind: str, term: str) -> str:
    return f"select doc_id, '{kind}' as kind, unnest(list_transform(range(1, len(string_split(text, '{term}'))), lambda i: length(array_to_string(string_split(text, '{term}')[1:i], '{term}')))) as start, {len(term)} as size from documents where contains(text, '{term}')"


@query("maneuver_spans", "with o as (" + " union all ".join(_occ(k, t) for k, t in PROSE.maneuvers) + ') select doc_id, kind, cast(start as bigint) as start, cast(start + size as bigint) as "end" from o')
def maneuver_spans(spark, sf):
    return spans.maneuvers(docs(spark, sf), "doc_id", "text", PROSE).select("doc_id", "kind", "start", "end")


ENT_SQL = MENTION_SQL + SENT_SQL.replace("with m as", ", m as", 1) + ", g as (select sent.doc_id, start, quote, count(*) as n, min('vehicle_' || (ord + 1)) as one, count(*) filter (where regexp_matches(label, 'the |der |The |Der ')) as roles, max(case when regexp_matches(label, 'the |der |The |Der ') then 'vehicle_' || (ord + 1) end) as role, max(case when not regexp_matches(label, 'the |der |The |Der ') then 'vehicle_' || (ord + 1) end) as model from sent join nodes on sent.doc_id = nodes.doc_id and contains(quote, label) group by all) "


@query("driver_relations", ENT_SQL + "select doc_id, start, regexp_extract(quote, '([A-Za-z]{1,20}) of ', 1) as driver, one as vehicle from g where contains(quote, ' of ') and n = 1 and regexp_extract(quote, '([A-Za-z]{1,20}) of ', 1) <> ''")
def driver_relations(spark, sf):
    d = docs(spark, sf)
    return spans.drivers(spans.sentences(d, ["doc_id"], "text"), spans.mention_nodes(d, "doc_id", "text", PROSE), "doc_id", PROSE).drop("quote")


@query("same_as_relations", ENT_SQL + "select doc_id, start, role, model from g where contains(quote, ' of ') and n = 2 and roles = 1")
def same_as_relations(spark, sf):
    d = docs(spark, sf)
    return spans.same_as(spans.sentences(d, ["doc_id"], "text"), spans.mention_nodes(d, "doc_id", "text", PROSE), "doc_id", PROSE).drop("quote")


@query("event_order", "with e as (select user_id, 'e_' || (event_id % 97) as id, event_id // 10 as at_ from events), o as (select user_id, id as source, lead(id) over (partition by user_id order by at_, id) as target from e) select user_id, source, target, count(*) as n from o where target is not null group by all")
def event_order(spark, sf):
    e = read(spark, sf, "events").select("user_id", F.concat(F.lit("e_"), (F.col("event_id") % 97).cast("string")).alias("id"), F.floor(F.col("event_id") / 10).alias("at_"))
    return spans.event_order(e, "user_id", "at_", "id").groupBy("user_id", "source", "target").agg(F.count("*").alias("n"))


@query("unresolved_flags", MENTION_SQL + CLAUSE_SQL.replace("with m as", ", m as", 1) + ", a as (select doc_id, count(*) as n from nodes group by 1), z as (select doc_id, count(*) as e from c where clause = 1 group by 1) select d.doc_id, array_to_string(list_filter([case when coalesce(n, 0) < 2 then 'two_vehicle_entities' end, case when coalesce(e, 0) = 0 then 'collision_agent' end, case when coalesce(e, 0) = 0 then 'collision_target' end], lambda x: x is not null), ',') as flags from documents d left join a using (doc_id) left join z using (doc_id)")
def unresolved_flags(spark, sf):
    d = docs(spark, sf)
    edges = spans.clauses(spans.sentences(d, ["doc_id"], "text"), "doc_id", PROSE).where("clause = 1")
    return spans.unresolved(d, spans.mention_nodes(d, "doc_id", "text", PROSE), edges, "doc_id").select("doc_id", F.array_join("critical_unresolved", ",").alias("flags"))


@query("resolver_merge", MENTION_SQL + ", a as (select doc_id, count(*) as n from nodes group by 1) select d.doc_id, case when d.doc_id % 4 = 0 then 'no answer' when coalesce(n, 0) < 2 then 'unknown or equal entities' when d.doc_id % 4 = 1 then 'quote is not in the text' end as note from documents d left join a using (doc_id)")
def resolver_merge(spark, sf):
    d = docs(spark, sf)
    k = F.col("doc_id") % 4
    answers = d.where(k != 0).select("doc_id", F.lit("vehicle_1").alias("agent"), F.lit("vehicle_2").alias("target"), F.when(k == 1, "\u0007").otherwise(F.col("text")).alias("quote"))
    return spans.resolved(d, answers, spans.mention_nodes(d, "doc_id", "text", PROSE), "doc_id", "text").select("doc_id", "note")


@query("span_integrity", SENT_SQL + "select count(*) as spans, cast(0 as bigint) as broken from sent")
def span_integrity(spark, sf):
    d = docs(spark, sf)
    s = spans.sentences(d, ["doc_id"], "text")
    bad = spans.broken_spans(s, d, "doc_id", "text").agg(F.count("*").alias("broken"))
    return s.agg(F.count("*").alias("spans")).crossJoin(bad)  # one row beside one row


@query("batch_summary", "select source, count(*) as attempted, count(*) filter (where text is not null and length(text) > 0) as valid, count(*) filter (where n_chars < 200) as errors from documents group by source")
def batch_summary(spark, sf):
    d = read(spark, sf, "documents").select("source", "text", "n_chars")
    return d.groupBy("source").agg(F.count("*").alias("attempted"), F.count_if(F.length("text") > 0).alias("valid"), F.count_if(F.try_divide(F.lit(1), F.floor(F.col("n_chars") / 200)).isNull()).alias("errors"))
