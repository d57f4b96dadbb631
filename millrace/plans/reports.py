"""Queries of reports: readiness of gold labels, fidelity, executed requests, load sweeps, device logs, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import assurance, consensus, funnel, metrics, runtime, rules
from millrace.plans.base import read, registry
from millrace.plans.cascade import MERGED_SQL, RULES_SQL, finals, ruled
from millrace.plans.gold import annotators

query, QUERIES, SQL = registry()

# -- readiness of gold labels: tasks are the labelled documents -----------------------------------
ROLES_SQL = """with n as (select doc_id, case when doc_id % 11 = 0 then 'U' when quality = 1 then 'A' else 'R' end as a, case when doc_id % 13 = 0 then 'U' when (quality = 1) = (doc_id % 17 <> 0) then 'A' else 'R' end as b from labels),
u as (select 'annotator_a' as role, doc_id, a as l from n union all select 'annotator_b', doc_id, b from n where doc_id % 40 <> 3 union all select 'adjudicated', doc_id, case when a = 'U' then null else a end from n)
"""


def roles(spark, sf):
    """role, doc_id, label: the second annotator leaves documents out, the adjudicated file has gaps."""
    a, b = annotators(spark, sf)
    final = a.select("doc_id", F.when(F.col("label") != "uncertain", F.col("label")).alias("label"))
    named = {"annotator_a": a, "annotator_b": b.where("doc_id % 40 <> 3"), "adjudicated": final}
    parts = [df.select(F.lit(role).alias("role"), "doc_id", "label") for role, df in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("gold_readiness", ROLES_SQL + "select role, count(*) as n, count(*) = (select count(*) from labels) as same_ids, count(*) filter (where l in ('A', 'R')) as binary, count(*) filter (where l = 'U') as uncertain, count(*) filter (where l is null) as missing, count(*) filter (where l in ('A', 'R')) = (select count(*) from labels) as ready from u group by role")
def gold_readiness(spark, sf):
    return consensus.role_status(read(spark, sf, "labels"), roles(spark, sf), "doc_id", "role", "label")


@query("gold_overlap", ROLES_SQL + """, o as (select n.doc_id, case when a <> 'U' and b <> 'U' and doc_id % 40 <> 3 then a = 'A' end as x, case when a <> 'U' and b <> 'U' and doc_id % 40 <> 3 then b = 'A' end as y from n),
c as (select count(*) as tasks, count(x) as overlap, count(*) filter (where x <> y) as disagreements, count(*) filter (where x) / count(x) as p, count(*) filter (where y) / count(x) as q from o),
k as (select *, 1 - disagreements / overlap as seen, p * q + (1 - p) * (1 - q) as chance from c)
select tasks, overlap, round(overlap / tasks, 9) as overlap_rate, disagreements, round(case when chance = 1 then 1.0 else (seen - chance) / (1 - chance) end, 9) as kappa from k""")
def gold_overlap(spark, sf):
    return consensus.overlap(read(spark, sf, "labels"), roles(spark, sf), "doc_id", "role", "label", "annotator_a", "annotator_b")


@query("withheld_metrics", ROLES_SQL + "select t as truth, k.n, null::double as kappa, null::double as observed, (select count(*) from u where role = 'adjudicated' and l is null) as incomplete from (select 'open' as t, count(*) as n from n) k union all select 'whole', count(*), round((avg(case when a = b then 1.0 else 0 end) - (select sum(x * y) / (select count(*) * count(*) from n) from (select a as l, count(*) as x from n group by a) join (select b as l, count(*) as y from n group by b) using (l))) / (1 - (select sum(x * y) / (select count(*) * count(*) from n) from (select a as l, count(*) as x from n group by a) join (select b as l, count(*) as y from n group by b) using (l))), 9), round(avg(case when a = b then 1.0 else 0 end), 9), 0 from n")
def withheld_metrics(spark, sf):
    """Agreement of the annotators held back behind the adjudicated labels with gaps, and given out behind whole ones."""
    a, b = annotators(spark, sf)
    met = a.select("doc_id", consensus.label_of(F.col("label")).alias("a")).join(b.select("doc_id", consensus.label_of(F.col("label")).alias("b")), "doc_id")
    got = metrics.kappa(met, [], "a", "b").select("n", "kappa", "observed")
    final = roles(spark, sf).where("role = 'adjudicated'")
    held = consensus.withheld(got.select(F.lit("open").alias("truth"), "*"), final, "label")
    return held.unionByName(consensus.withheld(got.select(F.lit("whole").alias("truth"), "*"), final.where("label is not null"), "label"))


# -- fidelity: an order is a run, its customer the scenario ---------------------------------------
CHECKS = ["compiled", "launched", "ran", "actors", "lanes", "ordered", "hard"]
RUNS_SQL = """with f as (select o_custkey as scenario, case when o_orderstatus = 'P' then 'failed' else 'completed' end as status, case when o_orderkey % 4 <> 0 then o_totalprice > 50000 end as compiled, o_orderkey % 19 <> 0 as launched,
 o_orderkey % 23 <> 1 as ran, case when o_orderkey % 6 <> 1 then o_custkey % 7 <> 2 end as actors, o_totalprice > 20000 as lanes, case when o_orderkey % 3 <> 0 then o_totalprice < 300000 end as ordered,
 case when o_orderstatus = 'F' then o_custkey % 2 = 0 end as hard, case when o_orderkey % 5 <> 0 then cast(o_orderkey % 90 as double) / 8 end as ttc, o_orderkey % 37 = 0 as fallback,
 case when o_orderkey % 8 <> 0 then o_orderpriority else '' end as topology, case when o_orderkey % 4 = 1 then 'no collision' when o_orderkey % 19 = 0 then 'launch failed' when o_orderkey % 2 = 0 then '' end as reason from orders)
"""


def runs(spark, sf):
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    return read(spark, sf, "orders").select(
        c.alias("scenario"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"), F.when(k % 4 != 0, p > 50000).alias("compiled"), (k % 19 != 0).alias("launched"),
        (k % 23 != 1).alias("ran"), F.when(k % 6 != 1, c % 7 != 2).alias("actors"), (p > 20000).alias("lanes"), F.when(k % 3 != 0, p < 300000).alias("ordered"),
        F.when(F.col("o_orderstatus") == "F", c % 2 == 0).alias("hard"), F.when(k % 5 != 0, (k % 90).cast("double") / 8).alias("ttc"), (k % 37 == 0).alias("fallback"),
        F.when(k % 8 != 0, F.col("o_orderpriority")).otherwise("").alias("topology"), F.when(k % 4 == 1, "no collision").when(k % 19 == 0, "launch failed").when(k % 2 == 0, "").alias("reason"),
    )


@query("fidelity_summary", RUNS_SQL + "select count(*) as planned, count(*) filter (where status = 'completed') as completed, count(distinct case when status = 'completed' then scenario end) as scenarios, "
       + ", ".join(f"count(*) filter (where status = 'completed' and {c}) as {c}_passed, count({c}) filter (where status = 'completed') as {c}_assessed, round(count(*) filter (where status = 'completed' and {c}) / nullif(count({c}) filter (where status = 'completed'), 0), 9) as {c}_rate" for c in CHECKS)
       + ", round(avg(ttc) filter (where status = 'completed'), 6) as ttc_mean, count(*) filter (where status = 'completed' and fallback) as fallbacks from f")
def fidelity_summary(spark, sf):
    return assurance.fidelity_summary(runs(spark, sf), "status", CHECKS, "scenario", ["ttc"], "fallback")


@query("fidelity_by_topology", RUNS_SQL + f"select 'topology' as field, coalesce(nullif(topology, ''), 'unspecified') as value, count(*) as n, count(distinct scenario) as scenarios, count(*) filter (where {' and '.join(CHECKS)}) as \"full\", round(count(*) filter (where {' and '.join(CHECKS)}) / count(*), 9) as full_rate, round(count(*) filter (where hard) / nullif(count(hard), 0), 9) as hard_rate from f where status = 'completed' group by all")
def fidelity_by_topology(spark, sf):
    return assurance.fidelity_strata(runs(spark, sf), "status", ["topology"], CHECKS, "scenario", "hard")


@query("failure_reasons", RUNS_SQL + "select reason, count(*) as n from f where status = 'completed' and reason <> '' group by reason")
def failure_reasons(spark, sf):
    return assurance.taxonomy(runs(spark, sf), "status", "reason")


# -- executed requests: a document is a template, sent under three seeds --------------------------
CALLS_SQL = """with i as (select doc_id as request_id, sha256(text) as h, case when doc_id % 97 = 0 then 'frozen otherwise' else sha256(text) end as approved, sha256(coalesce(lang, '') || text) as r from documents),
c as (select s as seed, request_id, approved, h, r, case when request_id % 53 = 0 and s = 2 then null else h end as t, case when request_id % 71 = 0 and s = 1 then 'other' else r end as w from i, range(3) a(s)),
"""


def calls_and_index(spark, sf):
    """calls (each under seeds 0 to 2, every 101st document again under seed 0) and the index of templates; texts are hashed once."""
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("request_id"), F.sha2("text", 256).alias("h"), F.sha2(F.concat(F.coalesce("lang", F.lit("")), "text"), 256).alias("r"))
    i = F.col("request_id")
    index = d.select(i, F.when(i % 97 == 0, "frozen otherwise").otherwise(F.col("h")).alias("approved_sha256"), F.col("h").alias("template_sha256"), F.col("r").alias("rendered_sha256"))
    seeds = F.when(i % 101 == 0, F.array(*map(F.lit, (0, 1, 2, 0)))).otherwise(F.array(*map(F.lit, (0, 1, 2))))
    c = d.select("*", F.explode(seeds.cast("array<bigint>")).alias("seed"))
    calls = c.select(
        "seed", "request_id", F.when((i % 53 != 0) | (F.col("seed") != 2), F.col("h")).alias("template_sha256"), F.when((i % 71 == 0) & (F.col("seed") == 1), "other").otherwise(F.col("r")).alias("rendered_sha256"),
        F.when(i % 31 != 0, F.when(i % 3 == 0, "PASS").when(i % 3 == 1, "FAIL").otherwise("MANUAL_REVIEW")).alias("verdict"), (i % 4).cast("int").alias("attempts"),
    )
    return calls, index


@query("request_hash_failures", CALLS_SQL + "f as (select * from c where approved <> h or t is null or w <> r), e as (select * from f union all select * from f where seed = 0 and request_id % 101 = 0) select seed, request_id, approved, h as template_now, t as template_recorded, r as rendered_now, w as rendered_recorded from e")
def request_hash_failures(spark, sf):
    return assurance.hash_failures(*calls_and_index(spark, sf))


@query("call_audit", CALLS_SQL + """e as (select * from c union all select * from c where seed = 0 and request_id % 101 = 0), m as (select seed as method, count(*) as n from e group by seed)
select (select count(*) from e) as calls, (select count(distinct request_id) from e) as templates, (select count(*) from e) - (select count(distinct (seed, request_id)) from e) as duplicates, (select count(*) from e where request_id % 31 = 0) as preserved,
 (select coalesce(sum(greatest(request_id % 4 - 1, 0)), 0)::bigint from e) as retries, (select count(*) from e where approved <> h or t is null or w <> r) as hash_failures, (select count(*) from i where request_id % 500 = 7) as leaks, 1::bigint as denominators, false as ok""")
def call_audit(spark, sf):
    """Methods are the seeds: the one whose requests were sent again has another denominator."""
    calls, index = calls_and_index(spark, sf)
    total = index.count()
    fault = F.col("request_id") % 7 != 0
    summary = calls.groupBy(F.col("seed").alias("method")).agg(F.count("*").alias("n"), F.count_if(fault).alias("faults"), F.count_if(~fault).alias("clean"))
    faults = index.where(fault).count()
    return assurance.call_audit(calls, index, summary, 3 * total, total, faults, total - faults, index.where("request_id % 500 = 7"))


# -- load: an event is a request ------------------------------------------------------------------
@query("sweep_report", """with r as (select user_id % 5 + 1 as c, case when event_type = 'error' then 'error' else 'ok' end as status, value as s, ts, ts + to_microseconds(cast(round(value * 1000) as bigint) * 1000) as done from events),
w as (select c, count(*) as requests, count(*) filter (where status = 'ok') as success, count(*) filter (where status <> 'ok') as failed, round((epoch_us(max(done)) - epoch_us(min(ts))) / 1e6, 4) as wall_seconds, round(avg(s) filter (where status = 'ok'), 4) as mean,
 round(quantile_cont(s, 0.5) filter (where status = 'ok'), 4) as p50, round(quantile_cont(s, 0.95) filter (where status = 'ok'), 4) as p95 from r group by c), t as (select *, round(requests / wall_seconds, 4) as throughput, round(first_value(wall_seconds) over (order by c) / wall_seconds, 3) as speedup from w)
select c, requests, success, failed, wall_seconds, mean, p50, p95, throughput, speedup, round(100 * speedup / c, 1) as efficiency_percent from t""")
def sweep_report(spark, sf):
    e = read(spark, sf, "events").select((F.col("user_id") % 5 + 1).alias("c"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("value").alias("s"), "ts")
    e = e.withColumn("done", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("s") * 1000).cast("long") * 1000))
    return runtime.sweep_report(e, "c", "status", "s", "ts", "done")


@query("gpu_log_report", """with g as (select user_id % 3 as device, least(value, 100) as util, event_id % 24000 as mem, value * 2 as power from events where event_id % 13 <> 0 and event_id % 17 <> 0)
select count(*) as n, round(avg(util), 2) as util_mean, round(quantile_cont(util, 0.95), 2) as util_p95, round(max(util), 2) as util_peak, round(avg(case when device < 2 then 100.0 * mem / 24576 end), 2) as memory_mean, round(max(case when device < 2 then 100.0 * mem / 24576 end), 2) as memory_peak, round(avg(power), 2) as power_mean from g""")
def gpu_log_report(spark, sf):
    """Lines of a device log written from the events; some hold no number, some are cut short, one device has no known total."""
    i = F.col("event_id")
    number = lambda c: c.cast("string")
    util = F.when(i % 13 == 0, "[N/A]").otherwise(number(F.least("value", F.lit(100.0))))
    short = F.concat_ws(", ", number(F.col("ts")), number(F.col("user_id") % 3), util)
    lines = read(spark, sf, "events").select(F.when(i % 17 == 0, short).otherwise(F.concat_ws(", ", short, number(i % 24000), number(F.col("value") * 2))).alias("line"))
    totals = spark.createDataFrame([("index, memory.total [MiB]",), ("0, 24576 MiB",), ("1, 24576 MiB",)], "line string")
    return runtime.gpu_report(runtime.gpu_samples(lines, "line"), runtime.gpu_totals(totals, "line"))


@query("cpu_log_report", "select count(*) as n, round(avg(100 - event_id % 101), 2) as mean, round(quantile_cont(100 - event_id % 101, 0.95), 2) as p95, max(100 - event_id % 101)::double as peak from events where event_id % 17 <> 0")
def cpu_log_report(spark, sf):
    i = F.col("event_id")
    columns = [F.lit("1")] * 14 + [(i % 101).cast("string"), F.lit("0"), F.when(i % 17 == 0, "st").otherwise("0")]
    return runtime.cpu_report(runtime.vmstat(read(spark, sf, "events").select(F.concat_ws("  ", *columns).alias("line")), "line"))


# -- runs of the cascade --------------------------------------------------------------------------
PAYLOAD = "source_text string, source_mode string, parsed struct<location: string>, rule_summary struct<label: string, score: int, matched_positive_keywords: array<string>>"


@query("payload_fields", RULES_SQL + "select doc_id, md5(d.text) as text_digest, 'prose' as source_mode, d.lang as location, label, cast(score as int) as score from r join documents d using (doc_id) where label = 'ambiguous'")
def payload_fields(spark, sf):
    """Requests of the ambiguous documents, whole texts included, read back from their JSON."""
    d = ruled(spark, sf, "lang").select("doc_id", F.col("text").alias("source_text"), F.lit("prose").alias("source_mode"), F.struct(F.col("lang").alias("location")).alias("parsed"), "rule")
    p = funnel.payloads(d, "doc_id", "rule", rules.AMBIGUOUS).select("doc_id", F.from_json("payload", PAYLOAD).alias("p"))
    return p.select("doc_id", F.md5("p.source_text").alias("text_digest"), "p.source_mode", "p.parsed.location", "p.rule_summary.label", "p.rule_summary.score")


RESULTS_SQL = MERGED_SQL + ", v as (select *, case when doc_id % 10 = 0 then 'skipped' when stage = 'unanswered' and doc_id % 3 = 0 then 'error' else 'ok' end as status, (doc_id % 64) / 16 as s from f)"


@query("run_report", RESULTS_SQL + " select count(*) as selected, count(*) filter (where status <> 'skipped') as processed, count(*) filter (where status = 'skipped') as skipped, count(*) filter (where status = 'ok') as success, count(*) filter (where status = 'error') as failed, count(*) filter (where final_label = 'car_to_car') as car_to_car, count(*) filter (where final_label = 'not_car_to_car') as not_car_to_car, count(*) filter (where final_label = 'ambiguous') as ambiguous, round(coalesce(sum(s) filter (where status <> 'skipped'), 0), 4) as elapsed, round(sum(s) filter (where status <> 'skipped') / count(*) filter (where status <> 'skipped'), 4) as mean_seconds from v")
def run_report(spark, sf):
    i = F.col("doc_id")
    status = F.when(i % 10 == 0, "skipped").when((F.col("stage") == "unanswered") & (i % 3 == 0), "error").otherwise("ok")
    results = finals(spark, sf).select("final_label", status.alias("status"), ((i % 64) / 16).alias("s"))
    return funnel.run_report(results, "status", "final_label", "s", [rules.ACCEPT, rules.REJECT, rules.AMBIGUOUS])


@query("routed_outcomes", MERGED_SQL + "select final_label as outcome, count(*) as n, round(100.0 * count(*) / (select count(*) from f where label = 'ambiguous'), 3) as percent_of_routed, round(100.0 * count(*) / (select count(*) from f), 3) as percent_of_all from f where label = 'ambiguous' group by 1")
def routed_outcomes(spark, sf):
    return funnel.routed_table(finals(spark, sf), "label", "final_label", rules.AMBIGUOUS)
