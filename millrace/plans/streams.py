"""Queries that run their input as a stream, and those of sources and assembled records."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.lexicon import PROSE
from millrace.operators import contracts, design, verdicts
from millrace.plans.base import read, registry
from millrace.plans.cascade import RULES_SQL
from millrace.plans.selection import PLAN_SQL, cases
from millrace.sources import records
from millrace.streaming import streams

query, QUERIES, SQL = registry()


@query("stream_classified", RULES_SQL + "select label as final_label, count(*) as n, cast(sum(score) as bigint) as score from r group by label")
def stream_classified(spark, sf):
    s = streams.source(spark, sf, "documents").select("doc_id", "text")
    done = streams.drained(streams.classified_stream(s, "doc_id", "text", PROSE).select("doc_id", "final_label", F.col("rule.score").alias("score")), "classified", "final_label")
    return done.groupBy("final_label").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


@query("stream_logs", RULES_SQL + "select label as final_label, count(*) as n, cast(sum(score) as bigint) as score, count(*) filter (where label = 'ambiguous') as candidates from r group by label")
def stream_logs(spark, sf):
    """Both logs after the stream has run and, with its state lost, has run again over the same logs: nothing stands twice."""
    from millrace.sources.scratch import folder

    reports, candidates = folder(spark, "reports"), folder(spark, "candidates")
    for _ in range(2):
        records = streams.source(spark, sf, "documents").select("doc_id", "text")
        streams.logged(records, "doc_id", "text", reports, candidates, folder(spark, "state"), PROSE).awaitTermination()
    asked = spark.read.parquet(candidates).groupBy("final_label").agg(F.count("*").alias("candidates"))
    told = spark.read.parquet(reports).groupBy("final_label").agg(F.count("*").alias("n"), F.sum("rule_score").alias("score"))
    return told.join(asked, "final_label", "left").select("final_label", "n", "score", F.coalesce("candidates", F.lit(0)).alias("candidates"))


# A window comes out once the watermark (latest time less two hours) has passed its end.
CLOSED = "(select max(ts) - interval 2 hour from events)"


@query("stream_run_counts", f"select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2 having time_bucket(interval 1 day, any_value(ts)) + interval 1 day <= {CLOSED}")
def stream_run_counts(spark, sf):
    return streams.drained(streams.run_counts(streams.source(spark, sf, "events"), "ts", "event_type", "value"), "counts").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sliding_monitor", f"with w as (select time_bucket(interval 1 day, ts) - k * interval 1 day as start, value from events, range(2) r(k)) select start, count(*) as n, round(avg(value), 6) as mean, max(value) as \"max\" from w group by start having start + interval 2 day <= {CLOSED}")
def stream_sliding_monitor(spark, sf):
    return streams.drained(streams.sliding_monitor(streams.source(spark, sf, "events"), "ts", "value"), "monitor").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sessions", f"""with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from o)
 select user_id, min(ts) as start, max(ts) + interval 6 hour as "end", count(*) as n from s group by user_id, k having max(ts) + interval 6 hour <= {CLOSED}""")
def stream_sessions(spark, sf):
    return streams.drained(streams.sessions(streams.source(spark, sf, "events"), "ts", "user_id", "6 hours"), "sessions").withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("summary_long", "select 'n' as measure, cast(count(*) as varchar) as value from orders union all select 'by.status.f', cast(count(*) filter (where o_orderstatus = 'F') as varchar) from orders union all select 'by.status.o', cast(count(*) filter (where o_orderstatus = 'O') as varchar) from orders")
def summary_long(spark, sf):
    s = F.col("o_orderstatus")
    row = read(spark, sf, "orders").agg(F.count("*").alias("n"), F.struct(F.struct(F.count_if(s == "F").alias("f"), F.count_if(s == "O").alias("o")).alias("status"), F.collect_set(s).alias("names")).alias("by"))
    return records.long_summary(row)


@query("ledger_check", "select 'c' || c_custkey as name, case c_custkey % 7 when 3 then 'missing' when 4 then 'changed' when 5 then 'unlisted' else 'same' end as state from customer")
def ledger_check(spark, sf):
    n = read(spark, sf, "customer")
    name, sha = F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.sha2("c_name", 256)
    sums = n.where("c_custkey % 7 <> 3").select(name.alias("name"), sha.alias("sha256"))
    ledger = n.where("c_custkey % 7 <> 5").select(F.concat(F.when(F.col("c_custkey") % 7 == 4, F.reverse(sha)).otherwise(sha), F.lit("  "), name).alias("value"))
    return records.ledger_check(sums, ledger)


@query("log_pairs", "select trim(split_part(role || '=' || text, '=', 1)) as key, count(*) as n from conversations group by 1")
def log_pairs(spark, sf):
    from millrace.operators import runtime

    lines = read(spark, sf, "conversations").select(F.concat_ws("=", "role", "text").alias("line"))
    return runtime.log_pairs(lines, "line").groupBy("key").agg(F.count("*").alias("n"))


@query("label_join", "select conv_id, turn, case when length(text) % 5 = 0 then 'MANUAL_REVIEW' when length(text) % 2 = 0 then 'PASS' else 'FAIL' end as status, case when length(text) % 5 = 0 then 'invalid' else 'valid' end as outcome from conversations")
def label_join(spark, sf):
    n = F.length("text")
    raw = F.when(n % 5 == 0, '{"status": "NO"}').otherwise(F.concat(F.lit('{"status": "'), F.when(n % 2 == 0, "PASS").otherwise("FAIL"), F.lit('", "issue_codes": ["a"], "rationale": "r"}')))
    c = verdicts.checked(read(spark, sf, "conversations").select("conv_id", "turn", raw.alias("raw")), "raw", ["a", "b"])
    return c.select("conv_id", "turn", F.coalesce("status", F.lit("MANUAL_REVIEW")).alias("status"), F.when(F.col("error").isNull(), "valid").otherwise("invalid").alias("outcome"))


@query("verdict_errors", "select case event_id % 6 when 0 then 'unknown status' when 1 then 'repeated issue code' when 2 then 'rationale too long' when 3 then 'not an object' when 4 then 'unknown issue code' end as error, case when event_id % 6 = 5 then 'FAIL' end as status, count(*) as n from events group by all")
def verdict_errors(spark, sf):
    k = F.col("event_id") % 6
    raw = (
        F.when(k == 0, '{"status": "GOOD", "issue_codes": [], "rationale": "r"}').when(k == 1, '{"status": "PASS", "issue_codes": ["a", "a"], "rationale": "r"}')
        .when(k == 2, F.concat(F.lit('{"status": "PASS", "issue_codes": [], "rationale": "'), F.repeat(F.lit("x"), F.lit(601)), F.lit('"}'))).when(k == 3, "PASS")
        .when(k == 4, '{"status": "PASS", "issue_codes": ["z"], "rationale": "r"}').otherwise('{"status": "FAIL", "issue_codes": ["b"], "rationale": "r"}')
    )
    c = verdicts.checked(read(spark, sf, "events").select(raw.alias("raw")), "raw", ["a", "b"])
    return c.groupBy("error", "status").agg(F.count("*").alias("n"))


@query("method_records", PLAN_SQL + """, o as (select trial_id, fault_class, trial_kind, length(trial_id) % 3 = 0 as telemetry, length(trial_id) % 2 = 0 as image from plan), r as (
 select trial_id, 'deterministic_telemetry_only' as method, telemetry as detected, false as review from o union all select trial_id, 'image_only_vlm', image, false from o union all select trial_id, 'telemetry_plus_vlm_no_repair', telemetry or image, false from o
 union all select trial_id, 'guarded_bounded_repair', telemetry or image, coalesce(fault_class = 'immutable', false) or (trial_kind = 'control' and (telemetry or image)) from o union all select trial_id, 'unconstrained_self_refinement', telemetry or image, false from o)
 select method, count(*) as n, count(*) filter (where detected) as detected, count(*) filter (where review) as reviews from r group by method""")
def method_records(spark, sf):
    """Five branches for each trial, each with its own derivation; every method has as many rows as there are trials."""
    n = F.length("trial_id")
    o = design.fault_plan(cases(spark, sf)).select("trial_id", "fault_class", "trial_kind", (n % 3 == 0).alias("telemetry"), (n % 2 == 0).alias("image"))
    either = F.col("telemetry") | F.col("image")
    flagged = F.coalesce(F.col("fault_class") == "immutable", F.lit(False)) | ((F.col("trial_kind") == "control") & either)
    branches = [("deterministic_telemetry_only", F.col("telemetry"), F.lit(False)), ("image_only_vlm", F.col("image"), F.lit(False)), ("telemetry_plus_vlm_no_repair", either, F.lit(False)), ("guarded_bounded_repair", either, flagged), ("unconstrained_self_refinement", either, F.lit(False))]
    each = o.select("trial_id", F.inline(F.array(*(F.struct(F.lit(m).alias("method"), d.alias("detected"), r.alias("review")) for m, d, r in branches))))
    return each.groupBy("method").agg(F.count("*").alias("n"), F.count_if("detected").alias("detected"), F.count_if("review").alias("reviews"))


@query("completion_audit", PLAN_SQL + """ select unnest(['seven trials a case', 'unique trials', 'three mutable faults a case', 'three immutable faults a case']) as "check", unnest([count(*) = 7 * any_value(c), count(*) = count(distinct trial_id), count(*) filter (where fault_class = 'mutable') = 3 * any_value(c), count(*) filter (where fault_class = 'immutable') = 3 * any_value(c)]) as ok from plan, (select count(*) as c from cases)""")
def completion_audit(spark, sf):
    from millrace.operators import funnel

    p = design.fault_plan(cases(spark, sf))
    counts = p.agg(F.count("*").alias("n"), F.count_distinct("trial_id").alias("u"), F.count_if(F.col("fault_class") == "mutable").alias("m"), F.count_if(F.col("fault_class") == "immutable").alias("i"), F.count_if(F.col("trial_kind") == "control").alias("c"))
    return funnel.conserved(counts, {"seven trials a case": F.expr("n = 7 * c"), "unique trials": F.expr("n = u"), "three mutable faults a case": F.expr("m = 3 * c"), "three immutable faults a case": F.expr("i = 3 * c")})


@query("topology_binding", "with t(topology, ego, other) as (values ('rear_end', 50.0::double, 30.0::double), ('intersection_crossing_turning', 40.0::double, 35.0::double), ('lane_change_side_swipe', 55.0::double, 50.0::double), ('head_on_centerline_intrusion', 60.0::double, 55.0::double)), c as (select o_orderkey, ['rear_end', 'intersection_crossing_turning', 'lane_change_side_swipe', 'head_on_centerline_intrusion', 'unknown'][o_orderkey % 5 + 1] as topology from orders) select o_orderkey, c.topology, ego, other, ego > other as ego_faster from c join t using (topology)")
def topology_binding(spark, sf):
    """Speeds by topology; what is no known topology is refused (dropped here, an error column in a job)."""
    profile = spark.createDataFrame([("rear_end", 50.0, 30.0), ("intersection_crossing_turning", 40.0, 35.0), ("lane_change_side_swipe", 55.0, 50.0), ("head_on_centerline_intrusion", 60.0, 55.0)], "topology string, ego double, other double")
    names = F.array(*map(F.lit, [*contracts.TOPOLOGIES, "unknown"]))
    o = read(spark, sf, "orders").select("o_orderkey", F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("topology"))
    return o.join(F.broadcast(profile), "topology").select("o_orderkey", "topology", "ego", "other", (F.col("ego") > F.col("other")).alias("ego_faster"))  # four rows


@query("guarded_report", "select l_orderkey, count(*) as repairs, count(*) filter (where l_returnflag = 'A') as rejected, case when max(l_tax) > 0.07 then 'fail' when count(*) filter (where l_returnflag = 'R') > 0 and count(*) filter (where l_returnflag = 'N') = 0 then 'manual_review' else 'pass' end as verdict from lineitem group by l_orderkey")
def guarded_report(spark, sf):
    """Repairs split into accepted and rejected; a deterministic failure overrides a claim, an inconsistent claim goes to review."""
    flag = F.col("l_returnflag")
    got = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("repairs"), F.count_if(flag == "A").alias("rejected"), (F.max("l_tax") > 0.07).alias("_fail"), ((F.count_if(flag == "R") > 0) & (F.count_if(flag == "N") == 0)).alias("_odd"))
    return got.select("l_orderkey", "repairs", "rejected", F.when(F.col("_fail"), "fail").when(F.col("_odd"), "manual_review").otherwise("pass").alias("verdict"))


@query("phenotype_check", "with f as (select l_orderkey, min(l_linenumber) as first_line from lineitem group by 1) select l_orderkey, max(case when l_linenumber = first_line then l_quantity end) as first_quantity, max(case when l_linenumber = first_line then l_quantity end) > 25 as verified from lineitem join f using (l_orderkey) group by 1")
def phenotype_check(spark, sf):
    """Whether an injected fault shows in the first state of its rerun."""
    li = read(spark, sf, "lineitem")
    got = li.groupBy("l_orderkey").agg(F.max_by("l_quantity", F.struct(-F.col("l_linenumber"), "l_quantity")).alias("first_quantity"))
    return got.withColumn("verified", F.col("first_quantity") > 25)
