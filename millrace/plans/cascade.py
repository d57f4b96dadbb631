"""Queries of the rule cascade and its funnel on the driver's tables (records: documents; gold: labels)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.lexicon import KOREAN, PROSE, Lexicon
from millrace.operators import funnel, rules, verdicts
from millrace.plans.base import read, registry, spread

query, QUERIES, SQL = registry()

# -- SQL of the classifier, written from the same lists ----------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def _hits(words) -> str:
    return f"list_filter({_list(words)}, lambda k: contains(t, k))"


def _patterns(found: dict) -> str:
    return "list_filter([" + ", ".join(f"case when regexp_matches(t, {_q(p)}) then {_q(n)} end" for n, p in found.items()) + "], lambda x: x is not null)"


def rules_sql(lexicon: Lexicon, base: str) -> str:
    """r: the rows of base (with their text as t) with every hit, the score and the label, from the lists of a lexicon."""
    return f"""
with base as ({base}),
h as (select *, {_patterns(lexicon.roles)} as roles, {_patterns(lexicon.pairs)} as pairs, {_patterns(lexicon.events)} as events,
  {' + '.join(f"(length(t) - length(replace(t, {_q(w)}, ''))) // {len(w)}" for w in lexicon.vehicle)} as m,
  {', '.join(f"{_hits(getattr(lexicon, n))} as {n}" for n in Lexicon.LISTS)} from base),
n as (select *, greatest(len(roles), least(m, 8)) as v, len(machinery) + len(work_context) as w, len(facility) + len(person) + len(two_wheeler) + len(machinery) + len(work_context) as neg,
  list_contains(events, 'vehicle_to_vehicle_collision_pattern') as v2v, list_contains(events, 'vehicle_to_person_pattern') as v2p,
  list_contains(events, 'vehicle_to_facility_pattern') as v2f, list_contains(events, 'work_accident_pattern') as wa from h),
r as (select *, case when coalesce(t, '') = '' then -5 else 2 * v + 3 * len(collision) + len(accident) + 2 * len(pairs) + case when v2v then 4 else 0 end - 3 * len(facility)
   - 4 * len(person) - 4 * len(two_wheeler) - 2 * w - len(non_traffic) - case when v2p then 4 else 0 end - case when v2f then 4 else 0 end - case when wa then 4 else 0 end end as score,
  case when coalesce(t, '') = '' then 'not_car_to_car' when v2p or len(person) > 0 or len(two_wheeler) > 0 then 'not_car_to_car'
   when v2f or len(facility) >= 2 or (len(facility) >= 1 and not v2v and len(pairs) = 0) then 'not_car_to_car'
   when wa or (len(machinery) > 0 and len(work_context) > 0) then 'not_car_to_car' when v = 0 and len(collision) = 0 and len(accident) = 0 then 'not_car_to_car'
   when v2v and neg = 0 then 'car_to_car' when v >= 2 and len(collision) >= 1 and len(pairs) >= 1 and neg = 0 then 'car_to_car'
   when v >= 1 and (len(collision) >= 1 or len(accident) >= 1) then 'ambiguous' else 'not_car_to_car' end as label from n)
"""


RULES_SQL = rules_sql(PROSE, "select doc_id, source, lang, text as t from documents")


def ruled(spark, sf, *keep):
    """documents with doc_id, text and keep, each once, and their rule."""
    return rules.classified(spread(read(spark, sf, "documents").select(*dict.fromkeys(["doc_id", "text", *keep])), "doc_id"), "text", PROSE)


#: Korean phrases by column, so that every order tells an accident: who, where, what was hit, in which matter.
PHRASES = {
    "o_orderpriority": ("1-URGENT", "원고 차량이 직진하던 중 ", "2-HIGH", "피고 차량이 후진하다가 ", "3-MEDIUM", "피고인의 승용차가 교차로에서 ", "4-NOT SPECIFIED", "화물차로 현장에서 하역 작업을 하다가 ", "매매 계약에 따른 대금에 관하여 "),
    "o_orderstatus": ("O", "상대 차량을 추돌하였다. ", "F", "피고 차량과 접촉하는 사고가 났다. ", "보행자를 충격하였다. "),
    "k": (0, "가드레일이 부서졌다.", 1, "오토바이가 넘어졌다.", 2, "지게차가 있었다.", 3, "보험금을 지급하였다.", "피해자의 버스가 정차하였다."),
}
KOREAN_SQL = "select o_orderkey as doc_id, " + " || ".join(
    f"case {'o_custkey % 7' if c == 'k' else c} " + " ".join(f"when {v!r} then {t!r}" for v, t in zip(p[:-1:2], p[1:-1:2], strict=True)) + f" else {p[-1]!r} end" for c, p in PHRASES.items()
) + " as t from orders"


def korean_texts(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 7).alias("k"))

    def phrase(c, p):
        out = F
        for v, t in zip(p[:-1:2], p[1:-1:2], strict=True):
            out = out.when(F.col(c) == v, t)
        return out.otherwise(p[-1])

    return o.select(F.col("o_orderkey").alias("doc_id"), F.concat(*(phrase(c, p) for c, p in PHRASES.items())).alias("text"))


@query("korean_rule_classify", rules_sql(KOREAN, KOREAN_SQL) + """select doc_id, label, cast(score as int) as score, cast(v as int) as vehicle_mentions, array_to_string(list_sort(list_distinct(roles || collision || accident)), '|') as positive,
 array_to_string(list_sort(list_distinct(facility || person || two_wheeler || machinery || work_context || non_traffic)), '|') as negative, array_to_string(events || pairs, '|') as patterns from r""")
def korean_rule_classify(spark, sf):
    r = rules.classified(korean_texts(spark, sf), "text", KOREAN).select("doc_id", "rule.*")
    return r.select("doc_id", "label", "score", "vehicle_mentions", F.array_join("matched_positive_keywords", "|").alias("positive"), F.array_join("matched_negative_keywords", "|").alias("negative"), F.array_join("matched_patterns", "|").alias("patterns"))


@query("korean_rule_funnel", rules_sql(KOREAN, KOREAN_SQL) + "select label as stage, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 3) as percent from r group by label")
def korean_rule_funnel(spark, sf):
    return funnel.stage_table(rules.classified(korean_texts(spark, sf), "text", KOREAN).select(F.col("rule.label").alias("label")), "label")


@query("rule_cascade_funnel", RULES_SQL + "select label as stage, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 3) as percent from r group by label")
def rule_cascade_funnel(spark, sf):
    return funnel.stage_table(ruled(spark, sf).select(F.col("rule.label").alias("label")), "label")


@query("rule_classify", RULES_SQL + """select doc_id, label, cast(score as int) as score, cast(v as int) as vehicle_mentions, cast(len(collision) as int) as collision_hits, cast(w as int) as work_hits,
 cast(len(facility) as int) as facility_hits, array_to_string(list_sort(list_distinct(roles || collision || accident)), '|') as positive,
 array_to_string(list_sort(list_distinct(facility || person || two_wheeler || machinery || work_context || non_traffic)), '|') as negative, array_to_string(events || pairs, '|') as patterns from r""")
def rule_classify(spark, sf):
    r = ruled(spark, sf).select("doc_id", "rule.*")
    return r.select("doc_id", "label", "score", "vehicle_mentions", "collision_hits", "work_hits", "facility_hits", F.array_join("matched_positive_keywords", "|").alias("positive"), F.array_join("matched_negative_keywords", "|").alias("negative"), F.array_join("matched_patterns", "|").alias("patterns"))


@query("rule_reasons", RULES_SQL + """select why as reason, count(*) as n from (select unnest([
  case when v >= 2 then '차량 언급 ' || v || '회 수준으로 2대 이상 가능성이 높음' when v = 1 then '차량 언급은 있으나 1대 수준으로 보임' else '차량 언급이 거의 없음' end,
  case when len(collision) > 0 then '충돌/접촉 표현 ' || len(collision) || '개 확인' else '충돌/접촉 표현이 약함' end,
  case when len(pairs) > 0 then '상대 차량 또는 다중 차량 문맥 확인' end, case when len(facility) > 0 then '구조물 충돌 신호 존재' end, case when len(person) > 0 then '보행자/사람 충돌 신호 존재' end,
  case when len(two_wheeler) > 0 then '자전거/오토바이 등 비자동차 신호 존재' end, case when w > 0 then '작업기계 또는 작업현장 문맥이 강함' end,
  case when len(non_traffic) > 0 and len(accident) = 0 and len(collision) = 0 and v = 0 then '교통사고보다는 일반 민사/상사 문맥이 강함' end]) as why from r) where why is not null group by why""")
def rule_reasons(spark, sf):
    return ruled(spark, sf).select(F.explode("rule.reason").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("analysis_text", r"""select doc_id, length(a) as n_chars, md5(a) as digest from (select doc_id, trim(regexp_replace(concat_ws(chr(10), nullif(text, ''), nullif(source, ''), nullif(lang, '')),
 '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+', ' ', 'g'), ' ') as a from documents)""")
def analysis_text(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", rules.analysis_text(F.col("text"), F.col("source"), F.col("lang")).alias("a"))
    return d.select("doc_id", F.length("a").cast("long").alias("n_chars"), F.md5("a").alias("digest"))


@query("record_slice", "select doc_id, source, n_chars from documents order by doc_id limit 50 offset 10")
def record_slice(spark, sf):
    return funnel.sliced(read(spark, sf, "documents").select("doc_id", "source", "n_chars"), "doc_id", 11, 50)


@query("skip_existing", "select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def skip_existing(spark, sf):
    return funnel.unseen(read(spark, sf, "documents").select("doc_id", "source"), read(spark, sf, "labels"), "doc_id")


@query("resume_predictions", RULES_SQL + """select r.doc_id, coalesce(o.label, f.label) as label, case when o.label is not null then 'kept' else 'fresh' end as origin from r
 left join (select doc_id, case quality when 1 then 'car_to_car' when 0 then 'not_car_to_car' end as label from labels where toxic = 0) o on r.doc_id = o.doc_id join r f on r.doc_id = f.doc_id""")
def resume_predictions(spark, sf):
    fresh = ruled(spark, sf).select("doc_id", "rule.label")
    old = read(spark, sf, "labels").where("toxic = 0").select("doc_id", F.when(F.col("quality") == 1, rules.ACCEPT).when(F.col("quality") == 0, rules.REJECT).alias("label"))
    return funnel.resumed(read(spark, sf, "documents"), old, fresh, "doc_id", "label", [rules.ACCEPT, rules.REJECT])


@query("request_payloads", RULES_SQL + "select doc_id, md5(to_json({'doc_id': doc_id, 'lang': lang, 'score': cast(score as int)})) as digest from r where label = 'ambiguous'")
def request_payloads(spark, sf):
    asked = ruled(spark, sf, "lang").where(F.col("rule.label") == rules.AMBIGUOUS)
    return asked.select("doc_id", F.md5(F.to_json(F.struct("doc_id", "lang", F.col("rule.score").alias("score")))).alias("digest"))


MERGED_SQL = RULES_SQL + """, a as (select doc_id, case when toxic = 1 then 'ambiguous' when quality = 1 then 'car_to_car' else 'not_car_to_car' end as answer from labels),
f as (select r.doc_id, r.source, r.lang, r.label, case when label = 'ambiguous' then coalesce(answer, 'ambiguous') else label end as final_label,
 case when label <> 'ambiguous' then 'rule' when answer is not null then 'answer' else 'unanswered' end as stage from r left join a on r.doc_id = a.doc_id)
"""


def finals(spark, sf):
    answers = read(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, rules.AMBIGUOUS).when(F.col("quality") == 1, rules.ACCEPT).otherwise(rules.REJECT).alias("answer"))
    # the text is projected away before the join
    return funnel.merged(ruled(spark, sf, "source", "lang").select("doc_id", "source", "lang", "rule.label"), answers, "doc_id", "label", "answer")


@query("merge_stages", MERGED_SQL + "select doc_id, label, final_label, stage from f")
def merge_stages(spark, sf):
    return finals(spark, sf).select("doc_id", "label", "final_label", "stage")


@query("run_summary", MERGED_SQL + "select count(*) as processed, count(*) filter (where stage = 'unanswered') as failed, count(*) filter (where final_label = 'car_to_car') as accepted, count(*) filter (where final_label = 'not_car_to_car') as rejected, count(*) filter (where final_label = 'ambiguous') as unresolved, round(100.0 * count(*) filter (where label = 'ambiguous') / count(*), 3) as routed_percent from f")
def run_summary(spark, sf):
    final = F.col("final_label")
    return finals(spark, sf).agg(F.count("*").alias("processed"), F.count_if(F.col("stage") == "unanswered").alias("failed"), F.count_if(final == rules.ACCEPT).alias("accepted"), F.count_if(final == rules.REJECT).alias("rejected"), F.count_if(final == rules.AMBIGUOUS).alias("unresolved"), F.round(100 * F.count_if(F.col("label") == rules.AMBIGUOUS) / F.count("*"), 3).alias("routed_percent"))


@query("candidate_manifest", MERGED_SQL + "select doc_id as candidate_id, case when stage = 'rule' then 'rule_accepted' else 'answer_accepted' end as source_stage, case when stage = 'rule' then null else final_label end as answer from f where final_label = 'car_to_car'")
def candidate_manifest(spark, sf):
    f = finals(spark, sf).where(F.col("final_label") == rules.ACCEPT)
    by_rule = f.where("stage = 'rule'").select(F.col("doc_id").alias("candidate_id"), F.lit("rule_accepted").alias("source_stage"))
    by_answer = f.where("stage = 'answer'").select(F.col("doc_id").alias("candidate_id"), F.lit("answer_accepted").alias("source_stage"), F.col("final_label").alias("answer"))
    return by_rule.unionByName(by_answer, allowMissingColumns=True)


TIER_SQL = "case when {v} and {t} and ({a} or {b}) then 'A_minimum_grounded' when {v} and {t} then 'B_defaults_needed' else 'C_reextract_or_review' end".format(v="n_chars > 400", t="lang <> 'es'", a="source in ('src1', 'src2', 'src3')", b="n_chars % 2 = 0")


def tiered(spark, sf):
    some = lambda test, value: F.when(test, value).otherwise(F.lit(""))
    d = read(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return d.withColumn("tier", funnel.readiness(some(F.col("n_chars") > 400, F.col("lang")), some(F.col("lang") != "es", F.col("lang")), some(F.col("source").isin("src1", "src2", "src3"), F.col("source")), some(F.col("n_chars") % 2 == 0, F.col("source"))))


@query("readiness_tiers", f"select doc_id, {TIER_SQL} as tier from documents")
def readiness_tiers(spark, sf):
    return tiered(spark, sf).select("doc_id", "tier")


@query("field_coverage", "with d as (select d.*, l.quality from documents d left join labels l on d.doc_id = l.doc_id) select field, filled, round(100.0 * filled / n, 2) as percent from (select count(*) as n, count(nullif(text, '')) as text, count(nullif(lang, '')) as lang, count(quality) as quality from d) unpivot (filled for field in (text, lang, quality))")
def field_coverage(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text", "lang").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return funnel.coverage(d, ["text", "lang", "quality"])


@query("funnel_distributions", MERGED_SQL + ", u as (select 'stage' as measure, stage as value from f union all select 'lang', lang from f union all select 'answer', coalesce(answer, 'missing') from f left join a on f.doc_id = a.doc_id) select measure, value, count(*) as n from u group by all")
def funnel_distributions(spark, sf):
    answers = read(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, rules.AMBIGUOUS).when(F.col("quality") == 1, rules.ACCEPT).otherwise(rules.REJECT).alias("answer"))
    return funnel.distributions(finals(spark, sf).join(answers, "doc_id", "left"), ["stage", "lang", "answer"])


@query("conservation_checks", MERGED_SQL + """, c as (select count(*) as n, count(*) filter (where stage = 'rule') as ruled, count(*) filter (where label = 'ambiguous') as routed, count(*) filter (where stage = 'answer') as answered,
 count(*) filter (where stage = 'unanswered') as open, count(*) filter (where final_label = 'car_to_car') as acc, count(*) filter (where final_label = 'not_car_to_car') as rej, count(*) filter (where final_label = 'ambiguous') as amb from f)
select unnest(['branches_sum_to_total', 'routed_is_answered_or_open', 'labels_sum_to_total']) as "check", unnest([ruled + answered + open = n, routed = answered + open, acc + rej + amb = n]) as ok from c""")
def conservation_checks(spark, sf):
    n = lambda test: F.count_if(F.expr(test))
    counts = finals(spark, sf).agg(F.count("*").alias("n"), n("stage = 'rule'").alias("ruled"), n("label = 'ambiguous'").alias("routed"), n("stage = 'answer'").alias("answered"), n("stage = 'unanswered'").alias("open"), n("final_label = 'car_to_car'").alias("acc"), n("final_label = 'not_car_to_car'").alias("rej"), n("final_label = 'ambiguous'").alias("amb"))
    return funnel.conserved(counts, {"branches_sum_to_total": F.expr("ruled + answered + open = n"), "routed_is_answered_or_open": F.expr("routed = answered + open"), "labels_sum_to_total": F.expr("acc + rej + amb = n")})


# -- verdict text: JSON built from events, clean, noisy and broken -----------------------------

RAW_SQL = """with e as (select event_id, event_type, value, event_id % 7 as k from events), w as (select event_id, k, case
 when k = 0 then 'no object here' when k = 1 then 'Answer: {"label": "car_to_car", "confidence": "high", "is_car_to_car": true, "reason": " ' || event_type || ' ", "evidence": ["a", " ", "b "]} done'
 when k = 2 then '{"label": 5, "confidence": "high"}' when k = 3 then '{"label": "not_car_to_car", "accident_type": "work_accident", "is_car_to_car": "yes"}'
 when k = 4 then '{"label": "maybe", "confidence": "medium", "reason": ""}' when k = 5 then '{"label": "car_to_car"' else '{"label": "ambiguous", "evidence": ["' || event_type || '"]}' end as raw from e)"""


def raw_answers(spark, sf):
    read(spark, sf, "events").createOrReplaceTempView("millrace_events")
    return spark.sql(RAW_SQL.replace("from events", "from millrace_events") + " select event_id, raw from w")


@query("normalise_verdicts", RAW_SQL + """, j as (select event_id, case when json_valid(regexp_extract(raw, '(?s)\\{.*\\}', 0)) then regexp_extract(raw, '(?s)\\{.*\\}', 0)::json end as j from w),
x as (select event_id, j, case when json_type(j, '$.reason') = 'VARCHAR' then trim(j->>'$.reason') end as why from j)
select event_id, case when json_type(j, '$.label') = 'VARCHAR' and j->>'$.label' in ('car_to_car', 'not_car_to_car', 'ambiguous') then j->>'$.label' else 'ambiguous' end as label,
 case when json_type(j, '$.confidence') = 'VARCHAR' and j->>'$.confidence' in ('high', 'medium', 'low') then j->>'$.confidence' else 'low' end as confidence,
 case when json_type(j, '$.accident_type') = 'VARCHAR' and j->>'$.accident_type' in ('car_to_car', 'car_to_person', 'car_to_two_wheeler', 'car_to_facility', 'work_accident', 'other_or_unknown') then j->>'$.accident_type' else 'other_or_unknown' end as accident_type,
 coalesce(json_type(j, '$.is_car_to_car') = 'BOOLEAN' and (j->>'$.is_car_to_car') = 'true', false) as is_car_to_car, case when coalesce(why, '') = '' then 'LLM response unavailable' else why end as reason,
 coalesce(array_to_string(list_filter(list_transform(cast(j->'$.evidence' as varchar[]), lambda s: trim(s)), lambda s: s <> ''), '|'), '') as evidence from x""")
def normalise_verdicts(spark, sf):
    v = verdicts.normalised(raw_answers(spark, sf), "raw").select("event_id", "verdict.*")
    return v.select("event_id", "label", "confidence", "accident_type", "is_car_to_car", "reason", F.array_join("evidence", "|").alias("evidence"))


@query("strip_fence", "select conv_id, turn, md5(trim(text, ' ')) as digest, case when length(text) % 3 = 0 then 'abstain' else 'keep' end as decision from conversations")
def strip_fence(spark, sf):
    c = read(spark, sf, "conversations")
    fenced = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    label = F.when(F.length("text") % 3 == 0, "ambiguous").otherwise("keep")
    return c.select("conv_id", "turn", F.md5(verdicts.without_fence(fenced)).alias("digest"), F.when(label == "ambiguous", "abstain").otherwise(label).alias("decision"))
