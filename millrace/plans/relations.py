"""Queries of evidence graphs built from whole documents: flat predictions, resolver answers, integrity, semantic scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import graphs
from millrace.plans.base import read, registry
from millrace.plans.extraction import CLAUSE_SQL, ENT_SQL, MENTION_SQL, PROSE, ROLE_SQL, SENT_SQL, STATUS_SQL, docs
from millrace.sources.scratch import stored

query, QUERIES, SQL = registry()

_ROLES = ROLE_SQL[len(MENTION_SQL + CLAUSE_SQL.replace("with m as", ", m as", 1)):]
_ROLES = _ROLES[: _ROLES.index("\nselect doc_id, cast(clause")]
_ENTITIES = ENT_SQL[len(MENTION_SQL + SENT_SQL.replace("with m as", ", m as", 1)):]


def _occurs(n: int, kind: str, term: str) -> str:
    return f"select doc_id, {n} as term, '{kind}' as kind, unnest(list_transform(range(1, len(string_split(text, '{term}'))), lambda i: length(array_to_string(string_split(text, '{term}')[1:i], '{term}')))) as start, '{term}' as quote from documents where contains(text, '{term}')"


# Evidence at places that 5 divides is stored with its quote reversed: ok says that it still stands there.
GRAPH_SQL = MENTION_SQL + CLAUSE_SQL.replace("with m as", ", m as", 1) + _ROLES + _ENTITIES + """,
mv as (select *, row_number() over (partition by doc_id order by term, start) as n from (""" + " union all ".join(_occurs(n, k, t) for n, (k, t) in enumerate(PROSE.maneuvers)) + """)),
pe as (select doc_id, clause, agent, target from pr where agent is not null and target is not null),
dr as (select doc_id, start, quote, row_number() over (partition by doc_id order by start) as n from g where contains(quote, ' of ') and n = 1 and regexp_extract(quote, '([A-Za-z]{1,20}) of ', 1) <> ''),
sm as (select doc_id, start, quote from g where contains(quote, ' of ') and n = 2 and roles = 1),
sp as (select distinct doc_id, cast(start as bigint) as start, quote, start % 5 <> 0 or quote = reverse(quote) as ok from (select doc_id, source_start as start, label as quote from nodes union all select doc_id, start, quote from c
 union all select doc_id, start, quote from mv union all select doc_id, start, quote from dr union all select doc_id, start, quote from sm)),
en as (select doc_id, start + verb as at_, 'collision_event_' || clause as id, start % 5 <> 0 or quote = reverse(quote) as ok from c union all select doc_id, start, 'maneuver_event_' || n, start % 5 <> 0 or quote = reverse(quote) from mv),
ce as (select 'collides_with' as relation, doc_id, c.clause as ord, start % 5 <> 0 or quote = reverse(quote) as ok, true as ok2 from pe join c using (doc_id, clause) union all select 'drives', doc_id, n, start % 5 <> 0 or quote = reverse(quote), true from dr
 union all select 'same_as', doc_id, start, start % 5 <> 0 or quote = reverse(quote), true from sm union all select 'precedes', doc_id, at_, ok, next from (select doc_id, at_, ok, lead(ok) over (partition by doc_id order by at_, id) as next from en) where next is not null),
hd as (select d.doc_id, list_filter([case when (select count(*) from nodes n where n.doc_id = d.doc_id) < 2 then 'two_vehicle_entities' end, case when d.doc_id not in (select doc_id from pe) then 'collision_agent' end, case when d.doc_id not in (select doc_id from pe) then 'collision_target' end], lambda x: x is not null) as flags from documents d),
ag as (select doc_id, count(*) as relations, count(*) filter (where not (ok and ok2)) as unsupported, count(*) filter (where relation = 'collides_with') as hits, count(*) filter (where relation = 'collides_with' and ok) as good from ce group by doc_id),
fi as (select doc_id, arg_min(agent, clause) as agent, arg_min(target, clause) as target, min(clause) as clause from pe group by doc_id),
ve as (select doc_id, list(label order by ord) as labels from nodes group by doc_id),
fl as (select hd.doc_id, coalesce(ve.labels, []) as entities, a.label as agent, t.label as target, coalesce(""" + STATUS_SQL.replace("quote", "c.quote").replace("else 'unknown'", "when c.quote is not null then 'unknown'") + """, 'unknown') as legal_status, coalesce(hits > 0 and hits = good, false) as sufficient,
 coalesce(unsupported, 0) as unsupported, coalesce(relations, 0) as relations, case when len(flags) > 0 then 'unresolved' else 'resolved' end as resolver_status, flags
 from hd left join ag using (doc_id) left join fi using (doc_id) left join ve using (doc_id) left join c on c.doc_id = hd.doc_id and c.clause = fi.clause
 left join nodes a on a.doc_id = hd.doc_id and 'vehicle_' || (a.ord + 1) = fi.agent left join nodes t on t.doc_id = hd.doc_id and 'vehicle_' || (t.ord + 1) = fi.target)
"""


def graph(spark, sf):
    """The graphs of all documents, with the quotes of one place in five reversed in the evidence and found out again."""
    d = docs(spark, sf)
    g = graphs.extracted(d, "doc_id", "text", "source", PROSE)
    kept = g.evidence.withColumn("quote", F.when(F.col("start") % 5 == 0, F.reverse("quote")).otherwise(F.col("quote")))
    return d, g._replace(evidence=graphs.verified(kept, d, "doc_id", "text").drop("same_source"))


@query("graph_predictions", GRAPH_SQL + "select doc_id, array_to_string(entities, '|') as entities, agent, target, legal_status, sufficient, unsupported, relations, resolver_status, array_to_string(flags, ',') as flags from fl")
def graph_predictions(spark, sf):
    _, g = graph(spark, sf)
    return graphs.flat_predictions(g, "doc_id").select(
        "doc_id", F.array_join("vehicle_entities", "|").alias("entities"), F.col("collision_agent").alias("agent"), F.col("collision_target").alias("target"), "legal_status", F.col("evidence_span_sufficient").alias("sufficient"),
        F.col("unsupported_relation_count").alias("unsupported"), F.col("relation_count").alias("relations"), "resolver_status", F.array_join("critical_unresolved", ",").alias("flags"),
    )


@query("graph_semantics", GRAPH_SQL + """, rf as (select doc_id, case when doc_id % 3 = 0 then entities[2:] when doc_id % 11 = 0 then [] else entities end as entities, case when doc_id % 5 = 0 then target else agent end as agent, target, case when doc_id % 7 = 0 then 'unknown' else legal_status end as legal_status,
 case when doc_id % 4 = 0 then null when doc_id % 6 = 1 then not sufficient else sufficient end as sufficient, doc_id % 8 <> 5 as reviewed from fl),
st as (select rf.*, list_distinct(case when len(rf.entities) > 0 then rf.entities else list_filter([rf.agent, rf.target], lambda x: x <> '') end) as gold, list_distinct(case when len(fl.entities) > 0 then fl.entities else list_filter([fl.agent, fl.target], lambda x: x <> '') end) as said,
 fl.agent as p_agent, fl.target as p_target, fl.legal_status as p_legal, fl.sufficient as p_sufficient, fl.unsupported, fl.relations, fl.resolver_status from rf join fl using (doc_id)),
su as (select count(*) as total, count(*) filter (where reviewed) as n, cast(sum(len(list_intersect(gold, said))) filter (where reviewed) as bigint) as tp, cast(sum(len(said) - len(list_intersect(gold, said))) filter (where reviewed) as bigint) as fp, cast(sum(len(gold) - len(list_intersect(gold, said))) filter (where reviewed) as bigint) as fn,
 count(*) filter (where reviewed and agent is not distinct from p_agent) as a, count(*) filter (where reviewed and target is not distinct from p_target) as t, count(*) filter (where reviewed and legal_status = p_legal) as l,
 count(*) filter (where reviewed and sufficient is not null) as sn, count(*) filter (where reviewed and sufficient = p_sufficient) as s, cast(sum(unsupported) filter (where reviewed) as bigint) as un, cast(sum(relations) filter (where reviewed) as bigint) as re, count(*) filter (where reviewed and resolver_status = 'unresolved') as op from st)
select case when n = 0 then 'pending_semantic_review' when n = total then 'complete' else 'partial' end as status, total as total_tasks, n as evaluated, tp as entity_tp, fp as entity_fp, fn as entity_fn, tp / (tp + fp) as entity_precision, tp / (tp + fn) as entity_recall, 2 * tp / (2 * tp + fp + fn) as entity_f1,
 a / n as agent_exact_match, t / n as target_exact_match, l / n as legal_status_accuracy, s / nullif(sn, 0) as sufficiency_accuracy, sn as sufficiency_n, un as unsupported_relations, re as relation_total, un / nullif(re, 0) as unsupported_relation_rate, op / n as resolver_abstention_rate from su""")
def graph_semantics(spark, sf):
    """Scores of the graphs of all documents against an annotation of them that differs in entities, agents, statuses and sufficiency."""
    _, g = graph(spark, sf)
    said = stored(graphs.flat_predictions(g, "doc_id"))
    k, c = (lambda n: F.col("doc_id") % n), F.col
    gold = said.select(
        "doc_id", F.when(k(3) == 0, F.slice("vehicle_entities", 2, 1 << 30)).when(k(11) == 0, F.array().cast("array<string>")).otherwise(c("vehicle_entities")).alias("vehicle_entities"),
        F.when(k(5) == 0, c("collision_target")).otherwise(c("collision_agent")).alias("collision_agent"), "collision_target", F.when(k(7) == 0, "unknown").otherwise(c("legal_status")).alias("legal_status"),
        F.when(k(4) == 0, None).when(k(6) == 1, ~c("evidence_span_sufficient")).otherwise(c("evidence_span_sufficient")).alias("evidence_span_sufficient"),
        F.when(k(8) == 5, "pending").otherwise(graphs.REVIEWED[1]).alias("review_status"),
    )
    return graphs.semantic_scores(gold, said, "doc_id")


@query("resolver_effects", GRAPH_SQL + """, an as (select d.doc_id, text, source, case when d.doc_id % 4 = 1 then chr(7) else right(text, 30) end as quote, case when d.doc_id % 7 = 3 then 'vehicle_1' else 'vehicle_2' end as target from documents d join hd using (doc_id) where len(flags) > 0 and d.doc_id % 4 <> 0),
ju as (select *, case when target = 'vehicle_1' or (select count(*) from nodes n where n.doc_id = an.doc_id) < 2 then 'resolver returned invalid entity IDs' when strpos(text, quote) = 0 then 'resolver returned a quote absent from source' end as note from an),
pl as (select *, strpos(text, quote) - 1 as start from ju)
select hd.doc_id, case when pl.doc_id is not null and note is null then array_to_string(list_filter(flags, lambda x: x = 'two_vehicle_entities'), ',') else array_to_string(flags, ',') end as flags, coalesce(note, '') as review, case when pl.doc_id is not null and note is null then 'ev_' || substr(sha256(source || '|' || start || '|' || (start + length(quote)) || '|' || quote), 1, 12) end as evidence_id,
 case when pl.doc_id is not null and note is null then 'edge_' || substr(sha256(hd.doc_id || '|collision|vehicle_1|' || target), 1, 12) end as edge_id, cast(0 as bigint) as broken from hd left join pl using (doc_id)""")
def resolver_effects(spark, sf):
    """Answers for all graphs with open flags: what each adds, clears or notes, and what of it is not right when verified again."""
    d = docs(spark, sf)
    g = graphs.extracted(d, "doc_id", "text", "source", PROSE)
    k = lambda n: F.col("doc_id") % n
    answers = d.where(k(4) != 0).select("doc_id", F.lit("vehicle_1").alias("agent"), F.when(k(7) == 3, "vehicle_1").otherwise("vehicle_2").alias("target"), F.when(k(4) == 1, "\u0007").otherwise(F.expr("right(text, 30)")).alias("quote"), F.lit(0.7).alias("confidence"))
    h = graphs.with_answers(g, d, answers, "doc_id", "text", "source", PROSE)
    added = h.edges.where("provenance = 'inferred'").select("doc_id", "edge_id", F.col("evidence_ids")[0].alias("evidence_id"))
    new = h.evidence.where("extractor = 'resolver'")
    wrong = graphs.verified(new, d, "doc_id", "text").where("not (supported and same_source)").groupBy("doc_id").agg(F.count("*").alias("broken"))
    return h.heads.join(added, "doc_id", "left").join(wrong, "doc_id", "left").select("doc_id", F.array_join("critical_unresolved", ",").alias("flags"), F.array_join("review_required", ",").alias("review"), "evidence_id", "edge_id", F.coalesce("broken", F.lit(0)).alias("broken"))


@query("graph_integrity", GRAPH_SQL + """, ci as (select doc_id, ok from ce union all select doc_id, ok2 from ce where relation = 'precedes' union all select doc_id, ok from en union all select n.doc_id, source_start % 5 <> 0 or label = reverse(label) from nodes n)
select problem, count(*) as n, count(distinct doc_id) as graphs from (select doc_id, 'source hash mismatch' as problem from sp join documents d using (doc_id) where n_chars % 11 = 0 union all select doc_id, 'quote/offset mismatch' from sp where not ok union all select doc_id, 'unsupported evidence' from ci where not ok) group by problem""")
def graph_integrity(spark, sf):
    """Faults in all graphs whose evidence has reversed quotes at one place in five, and hashes of another text in one document of eleven."""
    _, g = graph(spark, sf)
    other = read(spark, sf, "documents").where("n_chars % 11 = 0").select("doc_id", F.lit("0" * 64).alias("_other"))
    evidence = g.evidence.join(other, "doc_id", "left").withColumn("source_text_sha256", F.coalesce("_other", "source_text_sha256")).drop("_other")
    found = graphs.integrity(g._replace(evidence=stored(evidence)), read(spark, sf, "documents"), "doc_id", "text")
    kind = F.when(F.startswith("problem", F.lit("unsupported evidence")), "unsupported evidence").otherwise(F.col("problem"))
    return found.groupBy(kind.alias("problem")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("graphs"))
