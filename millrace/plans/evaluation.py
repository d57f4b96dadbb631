"""Queries of field tables and of assurance, fidelity and blind evaluation; orders and line items play trials at volume."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import assurance, contracts, metrics, resample, verdicts
from millrace.plans.base import read, registry

query, QUERIES, SQL = registry()

# -- field tables: parts are scenarios, their columns are fields ---------------------------------
FIELDS_SQL = """with f as (select p_partkey as scenario, path, value, case when path = 'brand' then 'observed' when path = 'size' then 'defaulted' when path in ('price', 'type') then 'inferred' else 'unknown' end as provenance, path <> 'type' as has_value
 from (select p_partkey, p_brand as brand, cast(p_size as varchar) as size, cast(cast(floor(p_retailprice) as bigint) as varchar) as price, p_type as type from part) unpivot (value for path in (brand, size, price, type))),
i as (select p_partkey as scenario, k as ord, case (p_partkey + k) % 5 when 0 then 'brand' when 1 then 'size' when 2 then 'price' when 3 then 'type' else 'nowhere' end as path, 'v' || k as value from part, range(4) r(k)),
j as (select i.*, f.provenance, case when f.path is null or provenance not in ('inferred', 'defaulted') then 'rejected' when not has_value then 'invalid repair path' end as bad from i left join f using (scenario, path)),
b as (select *, coalesce(sum(case when bad is null then 1 else 0 end) over (partition by scenario order by ord rows between unbounded preceding and 1 preceding), 0) as used from j),
o as (select *, case when used >= 2 then case when row_number() over (partition by scenario, used >= 2 order by ord) = 1 then 'limit reached' else 'not judged' end else coalesce(bad, 'accepted') end as outcome from b),
l as (select scenario, path, arg_max(value, ord) as new from o where outcome = 'accepted' group by all)
"""


def lines(spark, sf, dealt=False):
    """Line items, one row for each order and line number; dealt: by order, for steps that all go by order."""
    li = read(spark, sf, "lineitem")
    if dealt:  # a fixed number of parts: merged ones of small files are many times larger in the memory of a task
        li = li.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    return li.groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")))


LINES_SQL = "(select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey, min(l_quantity) as l_quantity, min(l_returnflag) as l_returnflag from lineitem group by l_orderkey, l_linenumber)"


def fields(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("scenario"), F.col("p_brand").alias("brand"), F.col("p_size").cast("string").alias("size"), F.floor("p_retailprice").cast("string").alias("price"), F.col("p_type").alias("type"))
    f = p.unpivot(["scenario"], ["brand", "size", "price", "type"], "path", "value")
    source = F.when(F.col("path") == "brand", "observed").when(F.col("path") == "size", "defaulted").when(F.col("path").isin("price", "type"), "inferred").otherwise("unknown")
    return f.withColumn("provenance", source).withColumn("has_value", F.col("path") != "type")


def instructions(spark, sf):
    k = (F.col("scenario") + F.col("ord")) % 5
    i = read(spark, sf, "part").select(F.col("p_partkey").alias("scenario"), F.explode(F.array(*map(F.lit, range(4)))).alias("ord"))
    return i.withColumn("path", F.when(k == 0, "brand").when(k == 1, "size").when(k == 2, "price").when(k == 3, "type").otherwise("nowhere")).withColumn("value", F.concat(F.lit("v"), F.col("ord").cast("string")))


@query("field_mutability", FIELDS_SQL + "select path, case when provenance in ('inferred', 'defaulted') then 'mutable' when provenance = 'observed' then 'immutable' else 'review' end as mutability, count(*) as n from f group by all")
def field_mutability(spark, sf):
    return fields(spark, sf).groupBy("path", contracts.mutability(F.col("provenance")).alias("mutability")).agg(F.count("*").alias("n"))


@query("guarded_patch_outcomes", FIELDS_SQL + "select scenario, ord, path, outcome from o")
def guarded_patch_outcomes(spark, sf):
    return contracts.guarded_patch(fields(spark, sf), instructions(spark, sf), 2)[1].select("scenario", "ord", "path", "outcome")


@query("guarded_patch_fields", FIELDS_SQL + "select scenario, path, coalesce(new, value) as value, case when new is not null then 'defaulted' else provenance end as provenance from f left join l using (scenario, path)")
def guarded_patch_fields(spark, sf):
    return contracts.guarded_patch(fields(spark, sf), instructions(spark, sf), 2)[0].select("scenario", "path", "value", "provenance")


@query("unguarded_patch", FIELDS_SQL + "select scenario, count(*) as edits, count(*) filter (where provenance is null or provenance not in ('inferred', 'defaulted')) as unsafe_edits from (select * from j where ord < 3) group by scenario")
def unguarded_patch(spark, sf):
    return contracts.unguarded_patch(fields(spark, sf), instructions(spark, sf))


@query("restoration_check", FIELDS_SQL + "select scenario, count(new) filter (where new <> value) as differing, count(new) filter (where new <> value) = 0 as exact from f left join l using (scenario, path) group by scenario")
def restoration_check(spark, sf):
    f = fields(spark, sf)
    return contracts.restored(f, contracts.guarded_patch(f, instructions(spark, sf), 2)[0])


@query("fault_injection", FIELDS_SQL + "select scenario, 'price' as path, cast(value as double) as was, cast(value as double) + greatest(5.0, abs(cast(value as double)) * 0.5) as now from f where path = 'price'")
def fault_injection(spark, sf):
    return contracts.injected(fields(spark, sf), {"brand": 0, "price": 1, "size": 2})


@query("map_archetypes", "select doc_id, case when contains(text, 'ation') then 'intersection' when contains(text, 'keit') or contains(text, 'eau') then 'multi_lane' when contains(text, 'the') then 'straight_road' else 'unknown' end as archetype, case when contains(text, 'ation') then 'Town05' when contains(text, 'keit') or contains(text, 'eau') then 'Town04' else 'Town01' end as map from documents")
def map_archetypes(spark, sf):
    kind, place = contracts.archetype(F.col("text"), [("intersection", ("ation",), "Town05"), ("multi_lane", ("keit", "eau"), "Town04"), ("straight_road", ("the",), "Town01")])
    return read(spark, sf, "documents").select("doc_id", kind.alias("archetype"), place.alias("map"))


@query("contract_actors", "with n as (select o_orderkey as g, l_linenumber as k, 'vehicle_' || l_linenumber as node_id, l_returnflag as label, l_suppkey from orders join " + LINES_SQL + " on o_orderkey = l_orderkey), e as (select g, arg_min(l_suppkey % 3 + 1, k) as a, arg_min(l_suppkey % 4 + 1, k) as b from n where l_suppkey % 2 = 0 group by g) select n.g, node_id, case when k = a then 'ego' when k = b then 'target' else 'other' end as role, case when k = a then 8.0::double else 3.0::double end as speed_mps from n left join e using (g)")
def contract_actors(spark, sf):
    li = lines(spark, sf).select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("k"), F.col("l_returnflag").alias("label"), "l_suppkey")
    li = li.join(read(spark, sf, "orders").select(F.col("o_orderkey").alias("g")), "g")
    node = lambda n: F.concat(F.lit("vehicle_"), n.cast("string"))
    edges = li.select("g", F.col("k").alias("edge_ord"), node(F.col("l_suppkey") % 3 + 1).alias("source"), node(F.col("l_suppkey") % 4 + 1).alias("target"), (F.col("l_suppkey") % 2 == 0).alias("supported"))
    return contracts.actors(li.select("g", node(F.col("k")).alias("node_id"), "label"), edges, "g").select("g", "node_id", "role", "speed_mps")


@query("event_sequence", """with e as (select user_id, event_id, event_type as kind, case when event_id % 5 <> 0 then event_id % 50 end as s from events), h as (select distinct user_id from e where kind = 'error') select user_id, event_id, cast(row_number() over (partition by user_id order by coalesce(s, 1000000000000), 'ev' || event_id) as int) as "order" from e where user_id in (select user_id from h)""")
def event_sequence(spark, sf):
    e = read(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "collision").otherwise("move").alias("kind"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 50).alias("source_start"))
    return contracts.event_sequence(e.withColumn("number", F.col("event_id")).withColumn("event_id", F.concat(F.lit("ev"), F.col("event_id").cast("string"))), "user_id").select("user_id", F.col("number").alias("event_id"), "order")


@query("contract_status", """with g as (select c_custkey, case when c_custkey % 6 = 0 then ['contract requires at least two vehicle actors', 'note'] else [] end as notes, c_acctbal < 0 as claim, c_mktsegment = 'BUILDING' as c, c_custkey % 5 as actors, c_nationkey > 2 as hit from customer),
 i as (select *, list_filter(notes || [case when claim then 'claim' end, case when c then 'c' end, case when actors < 2 then 'contract requires at least two vehicle actors' end, case when not hit then 'hit' end], lambda x: x is not null) as all_ from g)
 select c_custkey, case when actors < 2 then 'blocked' when len(all_) > 0 then 'needs_review' else 'needs_defaults' end as status, len(list_distinct(all_)) as issues from i""")
def contract_status(spark, sf):
    k = F.col("c_custkey")
    g = read(spark, sf, "customer").select("c_custkey", F.when(k % 6 == 0, F.array(F.lit("contract requires at least two vehicle actors"), F.lit("note"))).otherwise(F.array().cast("array<string>")).alias("notes"), (F.col("c_acctbal") < 0).alias("party_claim"), F.when(F.col("c_mktsegment") == "BUILDING", "C_reextract_or_review").otherwise("A_minimum_grounded").alias("tier"), (k % 5).alias("actor_count"), (F.col("c_nationkey") > 2).alias("has_collision"))
    return contracts.status(g).select("c_custkey", "status", F.size("review_issues").cast("long").alias("issues"))


@query("contract_problems", "with p as (select l_orderkey as g, l_linenumber as ord, l_suppkey % 7 as actor, l_quantity as step, lag(l_quantity) over (partition by l_orderkey order by l_linenumber) as prev from " + LINES_SQL + "), a as (select g, count(actor) <> count(distinct actor) as t, bool_or(actor = 6) as u, bool_or(coalesce(step <= prev, false)) as d from p group by g) select g, array_to_string(list_filter([case when t then 'repeated actor id' end, case when u then 'unknown actor' end, case when d then 'event order does not ascend' end, case when g % 9 = 0 then 'tier C' end], lambda x: x is not null), ',') as problems from a")
def contract_problems(spark, sf):
    p = lines(spark, sf).select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("ord"), (F.col("l_suppkey") % 7).alias("actor"), F.col("l_quantity").alias("step"))
    head = p.select("g").distinct().withColumn("tier", F.when(F.col("g") % 9 == 0, "C_x").otherwise("A_x"))
    return contracts.problems(head, p.withColumn("known", F.col("actor") != 6), "g").select("g", F.array_join("problems", ",").alias("problems"))


TRACE_SQL = "with t as (select l_orderkey as scenario, l_linenumber as iteration, c as \"constraint\", case when c = 'collision' then l_suppkey % 4 <> 0 else l_partkey % 3 <> 0 end as passed from " + LINES_SQL + ", (values ('collision'), ('lane')) v(c)), r as (select *, coalesce(bool_or(passed) over (partition by scenario, \"constraint\" order by iteration rows between unbounded preceding and 1 preceding), false) and not passed as regressed from t)"


def trace(spark, sf):
    li = lines(spark, sf, dealt=True).select(F.col("l_orderkey").alias("scenario"), F.col("l_linenumber").alias("iteration"), "l_suppkey", "l_partkey", F.explode(F.array(F.lit("collision"), F.lit("lane"))).alias("constraint"))
    return li.select("scenario", "iteration", "constraint", F.when(F.col("constraint") == "collision", F.col("l_suppkey") % 4 != 0).otherwise(F.col("l_partkey") % 3 != 0).alias("passed"))


@query("patch_regressions", TRACE_SQL + " select scenario, iteration, count(*) filter (where regressed) as regressions from r group by all")
def patch_regressions(spark, sf):
    return contracts.regressions(trace(spark, sf)).groupBy("scenario", "iteration").agg(F.count_if("regressed").alias("regressions"))


@query("trace_outcomes", TRACE_SQL + ", e as (select scenario, iteration, case when bool_or(regressed) then 'regression' when bool_and(passed) then 'passed' when bool_or(\"constraint\" = 'collision' and not passed) then 'observed_failure' when iteration >= 3 then 'limit' end as o from r group by scenario, iteration) select scenario, min(iteration) as iteration, arg_min(o, iteration) as outcome from e where o is not null group by scenario")
def trace_outcomes(spark, sf):
    return contracts.terminal(trace(spark, sf), 3)


@query("post_repair_regression", "with i as " + LINES_SQL + ", a as (select l_orderkey as g, l_linenumber as c from i where l_returnflag = 'A'), b as (select l_orderkey as g, l_linenumber as c from i where l_returnflag = 'A' and l_quantity > 10) select g, count(*) as lost from (select * from a except select * from b) group by g")
def post_repair_regression(spark, sf):
    a = lines(spark, sf).where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("c"), "l_quantity")
    return a.join(a.where("l_quantity > 10").select("g", "c"), ["g", "c"], "left_anti").groupBy("g").agg(F.count("*").alias("lost"))


@query("promotion_audit", "select count(*) filter (where o_orderpriority like '5%' and o_orderstatus = 'F') as promoted, count(*) filter (where o_orderstatus = 'O') as not_executed from orders")
def promotion_audit(spark, sf):
    return read(spark, sf, "orders").agg(F.count_if(F.col("o_orderpriority").startswith("5") & (F.col("o_orderstatus") == "F")).alias("promoted"), F.count_if(F.col("o_orderstatus") == "O").alias("not_executed"))


# -- assurance: line items are trials by method --------------------------------------------------
TRIAL_SQL = """with t as (select l_shipdate, l_orderkey, case l_linenumber % 5 when 0 then 'm0' when 1 then 'm1' when 2 then 'm2' when 3 then 'm3' else 'm4' end as method, case when l_suppkey % 7 = 0 then 'control' else 'fault' end as trial_kind, case when l_suppkey % 7 <> 0 then 'f' || l_suppkey % 6 end as fault_type,
 l_linestatus = 'O' or l_partkey % 2 = 0 as completed, case when l_partkey % 10 = 0 then null when l_partkey % 10 = 1 then false else true end as verified, l_quantity > 20 as detected, l_discount > 0.08 as review, l_tax > 0.04 as trig, cast(l_quantity as int) % 4 as iters, l_extendedprice > 20000 as passed,
 l_returnflag = 'R' and l_tax > 0.06 as reg, l_returnflag = 'A' as att, l_returnflag = 'A' and l_quantity < 45 as rej from lineitem), e as (select * from t where completed and coalesce(verified, true))
"""


def trial_rows(spark, sf):
    c = F.col
    m = c("l_linenumber") % 5
    fault = c("l_suppkey") % 7 != 0
    return read(spark, sf, "lineitem").select(
        F.concat(F.lit("m"), m.cast("string")).alias("method"), F.when(fault, "fault").otherwise("control").alias("trial_kind"), F.when(fault, F.concat(F.lit("f"), (c("l_suppkey") % 6).cast("string"))).alias("fault_type"),
        F.when((c("l_linestatus") == "O") | (c("l_partkey") % 2 == 0), "completed").otherwise("failed").alias("execution_status"), F.when(c("l_partkey") % 10 == 1, False).when(c("l_partkey") % 10 != 0, True).alias("injection_verified"),
        (c("l_quantity") > 20).alias("detected"), (c("l_discount") > 0.08).alias("manual_review"), (c("l_tax") > 0.04).alias("repair_triggered"), (c("l_quantity").cast("int") % 4).alias("repair_iterations"), (c("l_extendedprice") > 20000).alias("post_repair_passed"),
        ((c("l_returnflag") == "R") & (c("l_tax") > 0.06)).alias("post_repair_regression"), (c("l_returnflag") == "A").alias("immutable_edit_attempted"), ((c("l_returnflag") == "A") & (c("l_quantity") < 45)).alias("immutable_edit_rejected"),
    )


@query("assurance_summary", TRIAL_SQL + """, g as (select method, fault_type, count(*) as n, count(*) filter (where trial_kind = 'fault' and detected) as tp, count(*) filter (where trial_kind = 'fault' and not detected) as fn, count(*) filter (where trial_kind <> 'fault' and detected) as fp, count(*) filter (where trial_kind <> 'fault' and not detected) as tn,
 count(*) filter (where review) as reviews, count(*) filter (where trig) as triggered, count(*) filter (where trig and passed) as repaired, count(*) filter (where reg) as regressions, round(avg(iters) filter (where trig), 9) as mean_iterations, count(*) filter (where att) as immutable_attempts, count(*) filter (where rej) as immutable_rejections, count(*) filter (where att and not rej) as unsafe_edits
 from e group by grouping sets ((method), (fault_type), ()))
 select *, round(tp / nullif(tp + fp, 0), 9) as precision, round(tp / nullif(tp + fn, 0), 9) as recall, round(case when tp > 0 then 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) end, 9) as f1, round(fn / nullif(tp + fn, 0), 9) as faults_missed_rate, round(fp / nullif(tn + fp, 0), 9) as clean_rejected_rate,
 round(repaired / nullif(triggered, 0), 9) as repair_pass_rate, round(reviews / nullif(n, 0), 9) as review_rate from g""")
def assurance_summary(spark, sf):
    return assurance.summary(trial_rows(spark, sf), [["method"], ["fault_type"], []])


@query("fidelity_checks", """with f as (select case when o_orderkey % 4 = 0 then null else o_totalprice > 50000 end as compiled, o_orderstatus <> 'P' as ran, case when o_orderstatus = 'F' then o_custkey % 2 = 0 end as hard from orders) select "check", passed, assessed, round(passed / nullif(assessed, 0), 9) as rate from (select 'compiled' as "check", count(*) filter (where compiled) as passed, count(compiled) as assessed from f union all select 'ran', count(*) filter (where ran), count(ran) from f union all select 'hard', count(*) filter (where hard), count(hard) from f)""")
def fidelity_checks(spark, sf):
    return assurance.check_rates(fidelity(spark, sf), ["compiled", "ran", "hard"])


def fidelity(spark, sf):
    o = read(spark, sf, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice") > 50000).alias("compiled"), (F.col("o_orderstatus") != "P").alias("ran"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") % 2 == 0).alias("hard"))


@query("replay_pairs", "with p as (select o_custkey, o_orderdate, count(*) as n, min(o_orderstatus) = max(o_orderstatus) and min(o_shippriority) = max(o_shippriority) as core, count(*) filter (where h <> '') = 2 and count(distinct h) = 1 as hash from (select o_custkey, date_trunc('year', o_orderdate) as o_orderdate, o_orderstatus, substr(o_orderpriority, 1, 1) as o_shippriority, case when o_orderkey % 3 = 0 then '' else o_orderstatus end as h from orders) group by 1, 2) select count(*) as pairs, count(*) filter (where core) as core_equal, count(*) filter (where hash) as hash_equal from p where n = 2")
def replay_pairs(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", F.date_trunc("year", "o_orderdate").alias("y"), "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("p"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("h"))
    return assurance.replay_pairs(o, ["o_custkey", "y"], ["o_orderstatus", "p"], "h")


@query("fidelity_strata", "with f as (select o_orderpriority, o_orderstatus, coalesce(o_totalprice > 50000 and o_orderkey % 4 <> 0, false) and o_orderstatus <> 'P' as good from orders), u as (select 'o_orderpriority' as field, o_orderpriority as value, good from f union all select 'o_orderstatus', o_orderstatus, good from f) select field, value, count(*) as n, round(count(*) filter (where good) / count(*), 9) as all_passed_rate from u group by all")
def fidelity_strata(spark, sf):
    return assurance.strata(fidelity(spark, sf), ["o_orderpriority", "o_orderstatus"], ["compiled", "ran"])


@query("failure_taxonomy", "select event_type as reason, count(*) as n from events where value > 30 group by 1")
def failure_taxonomy(spark, sf):
    return read(spark, sf, "events").where("value > 30").groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"))


# -- blind evaluation: events are calls ----------------------------------------------------------
CALL_SQL = "with c as (select event_id, user_id % 30 as cluster, event_id % 3 as seed, case event_id % 4 when 0 then 'm0' when 1 then 'm1' when 2 then 'm2' else 'm3' end as method, event_type in ('error', 'click') as fault, case when value > 40 then 'FAIL' when value > 8 then 'PASS' when value > 2 then 'MANUAL_REVIEW' end as status, event_type from events)"


def calls(spark, sf):
    v = F.col("value")
    e = read(spark, sf, "events")
    return e.select("event_id", (F.col("user_id") % 30).alias("cluster"), (F.col("event_id") % 3).alias("seed"), F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string")).alias("method"), F.col("event_type").isin("error", "click").alias("fault"), F.when(v > 40, "FAIL").when(v > 8, "PASS").when(v > 2, "MANUAL_REVIEW").alias("status"), "event_type")


FULL_SQL = """{k}, faults, clean, tp, fn, tn, fp, reviews, round(tp / nullif(tp + fp, 0), 9) as precision, round(tp / nullif(faults, 0), 9) as recall, round(tn / nullif(clean, 0), 9) as specificity, round((tp / nullif(faults, 0) + tn / nullif(clean, 0)) / 2, 9) as balanced_accuracy,
 round(case when tp > 0 then 2 * (tp / (tp + fp)) * (tp / faults) / (tp / (tp + fp) + tp / faults) end, 9) as f1, round(fn / nullif(faults, 0), 9) as faults_passed_rate, round(fp / nullif(clean, 0), 9) as clean_failed_rate, round((faults + clean - reviews) / (faults + clean), 9) as coverage, round(reviews / (faults + clean), 9) as review_rate
 from (select {k}, count(*) filter (where fault) as faults, count(*) filter (where not fault) as clean, count(*) filter (where fault and status = 'FAIL') as tp, count(*) filter (where fault and status = 'PASS') as fn, count(*) filter (where not fault and status = 'PASS') as tn, count(*) filter (where not fault and status = 'FAIL') as fp, count(*) filter (where coalesce(status, '') not in ('PASS', 'FAIL')) as reviews from c group by {k})"""


@query("blind_metrics", CALL_SQL + " select " + FULL_SQL.format(k="method"))
def blind_metrics(spark, sf):
    return metrics.full_denominators(calls(spark, sf), ["method"], F.col("fault"), F.col("status"))


@query("blind_metrics_by_seed", CALL_SQL + " select " + FULL_SQL.format(k="seed, method"))
def blind_metrics_by_seed(spark, sf):
    return metrics.full_denominators(calls(spark, sf), ["seed", "method"], F.col("fault"), F.col("status"))


@query("repeat_consensus", "with c as (select conv_id, role, case when length(text) % 5 = 0 then 'broken' when length(text) % 2 = 0 then 'PASS' else 'FAIL' end as s from conversations), g as (select conv_id, role, count(*) as n, count(distinct s) as k, count(*) filter (where s <> 'broken') as v, min(s) as s from c group by all) select conv_id, role, case when n = 2 and v = 2 and k = 1 then s else 'MANUAL_REVIEW' end as consensus, case when n <> 2 or v <> 2 then 'incomplete' when k = 1 then 'exact' else 'disagreement' end as agreement, n as answers from g")
def repeat_consensus(spark, sf):
    n = F.length("text")
    c = read(spark, sf, "conversations").select("conv_id", "role", F.when(n % 5 == 0, "broken").when(n % 2 == 0, "PASS").otherwise("FAIL").alias("status"))
    return verdicts.repeat_consensus(c, ["conv_id", "role"], "status", 2)


@query("per_fault_summary", CALL_SQL + " select event_type, count(*) as n, count(*) filter (where status = 'FAIL') as fails, count(*) filter (where status = 'PASS') as passes, count(*) filter (where coalesce(status, 'MANUAL_REVIEW') = 'MANUAL_REVIEW') as reviews, round(count(*) filter (where status = 'PASS') / count(*), 9) as passed_rate from c where fault group by event_type")
def per_fault_summary(spark, sf):
    s = F.col("status")
    return calls(spark, sf).where("fault").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(s == "FAIL").alias("fails"), F.count_if(s == "PASS").alias("passes"), F.count_if(F.coalesce(s, F.lit("MANUAL_REVIEW")) == "MANUAL_REVIEW").alias("reviews"), F.round(F.count_if(s == "PASS") / F.count("*"), 9).alias("passed_rate"))


BOOT_SQL = CALL_SQL + """, k as (select cluster, count(*) filter (where fault and status = 'FAIL') as tp, count(*) filter (where fault) as faults from c group by cluster), n as (select *, row_number() over (order by cluster) - 1 as at_, count(*) over () as n from k),
 g as (select r.replicate, unnest(range((select count(*) from k))) as i from range(200) r(replicate)), d as (select replicate, tp, faults from g join n on n.at_ = cast('0x' || substr(md5('5|' || replicate || '|' || i), 1, 8) as bigint) % n.n)"""


def cluster_cells(spark, sf):
    return calls(spark, sf).groupBy("cluster").agg(F.count_if(F.col("fault") & (F.col("status") == "FAIL")).alias("tp"), F.count_if("fault").alias("faults"))


@query("cluster_bootstrap", BOOT_SQL + " select replicate, cast(sum(tp) as bigint) as tp, cast(sum(faults) as bigint) as faults from d group by replicate")
def cluster_bootstrap(spark, sf):
    return resample.cluster_bootstrap(cluster_cells(spark, sf), "cluster", ["tp", "faults"], 200, 5)


@query("cluster_bootstrap_interval", BOOT_SQL + ", s as (select replicate, sum(tp) / sum(faults) as recall from d group by replicate) select count(recall) as replicates, round(quantile_cont(recall, 0.025), 9) as low, round(quantile_cont(recall, 0.975), 9) as high from s")
def cluster_bootstrap_interval(spark, sf):
    r = cluster_bootstrap(spark, sf).select(F.try_divide(F.col("tp").cast("double"), F.col("faults").cast("double")).alias("r"))
    return r.agg(F.count("r").alias("replicates"), F.round(F.percentile("r", 0.025), 9).alias("low"), F.round(F.percentile("r", 0.975), 9).alias("high"))


_NINE = "tp / nullif(tp + fp, 0) as precision, tp / nullif(faults, 0) as recall, tn / nullif(clean, 0) as specificity, (tp / nullif(faults, 0) + tn / nullif(clean, 0)) / 2 as balanced_accuracy, case when tp > 0 then 2 * (tp / (tp + fp)) * (tp / faults) / (tp / (tp + fp) + tp / faults) end as f1, fn / nullif(faults, 0) as faults_passed_rate, fp / nullif(clean, 0) as clean_failed_rate, (faults + clean - reviews) / (faults + clean) as coverage, reviews / (faults + clean) as review_rate"


@query("cluster_bootstrap_metrics", CALL_SQL + """, k as (select cluster, count(*) filter (where fault) as faults, count(*) filter (where not fault) as clean, count(*) filter (where fault and status = 'FAIL') as tp, count(*) filter (where fault and status = 'PASS') as fn, count(*) filter (where not fault and status = 'PASS') as tn, count(*) filter (where not fault and status = 'FAIL') as fp, count(*) filter (where coalesce(status, '') not in ('PASS', 'FAIL')) as reviews from c group by cluster),
 n as (select *, row_number() over (order by cluster) - 1 as at_, count(*) over () as n from k), g as (select r.replicate, unnest(range((select count(*) from k))) as i from range(10000) r(replicate)),
 d as (select replicate, sum(faults) as faults, sum(clean) as clean, sum(tp) as tp, sum(fn) as fn, sum(tn) as tn, sum(fp) as fp, sum(reviews) as reviews from g join n on n.at_ = cast('0x' || substr(md5('11|' || replicate || '|' || i), 1, 8) as bigint) % n.n group by replicate), x as (select """ + _NINE + """ from d),
 u as (unpivot x on columns(*) into name metric value value) select metric, round(quantile_cont(value, 0.025), 9) as low, round(quantile_cont(value, 0.975), 9) as high, count(*) as valid_replicates from u group by metric""")
def cluster_bootstrap_metrics(spark, sf):
    """Nine metrics over ten thousand replicates of the clusters."""
    s, fault = F.col("status"), F.col("fault")
    sums = {"faults": fault, "clean": ~fault, "tp": fault & (s == "FAIL"), "fn": fault & (s == "PASS"), "tn": ~fault & (s == "PASS"), "fp": ~fault & (s == "FAIL"), "reviews": ~F.coalesce(s.isin("FAIL", "PASS"), F.lit(False))}
    cells = calls(spark, sf).groupBy("cluster").agg(*(F.count_if(t).alias(n) for n, t in sums.items()))
    return resample.cluster_intervals(cells, "cluster", 10_000, 11).select("metric", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "valid_replicates")


@query("paired_sign_flip")
def paired_sign_flip(spark, sf):
    c = calls(spark, sf).where("status in ('PASS', 'FAIL')").withColumn("right", ((F.col("status") == "FAIL") == F.col("fault")).cast("double"))
    by = c.groupBy("cluster").pivot("method", ["m0", "m1", "m2", "m3"]).agg(F.avg("right"))
    pairs = F.array(*(F.struct(F.lit(f"m{i}").alias("l"), F.lit(f"m{j}").alias("r"), (F.col(f"m{i}") - F.col(f"m{j}")).alias("d")) for i in range(4) for j in range(i + 1, 4)))
    return resample.sign_flips(by.select(F.explode(pairs).alias("p")).select("p.*").where("d is not null"), ["l", "r"], "d", 10_000, 3)


@query("execution_audit", "select user_id % 3 as seed, count(*) as calls, count(distinct event_id % 700) as requests, count(*) - count(distinct event_id % 700) as repeated, count(distinct event_id % 700) - 700 as drift from events group by 1")
def execution_audit(spark, sf):
    c = read(spark, sf, "events").select((F.col("user_id") % 3).alias("seed"), (F.col("event_id") % 700).alias("request"))
    return assurance.execution_audit(c, 700)


@query("leakage_values", "select doc_id, count(*) as hits from (select doc_id from documents where contains(text, 'Licensed under') union all select doc_id from documents where regexp_matches(text, '(?i)api_key') union all select doc_id from documents where regexp_matches(text, 'AKIA[A-Z0-9]+')) group by doc_id")
def leakage_values(spark, sf):
    flat = read(spark, sf, "documents").select("doc_id", F.lit("$").alias("path"), F.lit("").alias("name"), F.col("text").alias("value"))
    return assurance.leakage(flat, "doc_id", {"license": "Licensed under", "key": "(?i)api_key", "access": "AKIA[A-Z0-9]+"}).groupBy("doc_id").agg(F.count("*").alias("hits"))


@query("leakage_keys", "select event_id, '$.k' as path from events where json_exists(props, '$.k')")
def leakage_keys(spark, sf):
    e = read(spark, sf, "events").select("event_id", "props")
    return assurance.leakage(assurance.flattened(e, "event_id", "props"), "event_id", keys=["k"]).select("event_id", "path")


@query("leakage_paths", r"select page_id from pages where regexp_matches(url, '(?i)(?:^|[/_.-])(?:fr|clean(?:bundle)?|injection)(?:$|[/_.-])')")
def leakage_paths(spark, sf):
    return read(spark, sf, "pages").where(F.col("url").rlike(assurance.FORBIDDEN_PATH.replace("fault|oracle", "fr"))).select("page_id")


@query("sanitised_actors", "select s_nationkey, s_suppkey, 'ACTOR_' || row_number() over (partition by s_nationkey order by s_suppkey) as neutral from supplier")
def sanitised_actors(spark, sf):
    return assurance.sanitised_actors(read(spark, sf, "supplier"), "s_nationkey", "s_suppkey")


@query("trial_assembly", "with m as (select o_orderkey as trial_id, o_custkey as slot_id from orders), r as (select l_orderkey as trial_id, list_sort(list(distinct l_shipmode)) as failed, max(l_partkey) % 4 as k from (select l_orderkey, l_returnflag as l_shipmode, l_partkey from lineitem where l_quantity > 30) group by 1), c as (select c_custkey as slot_id, c_nationkey % 4 as k from customer) select m.trial_id, r.trial_id is not null as verified, r.k is distinct from c.k as binding_mismatch, coalesce(array_to_string(failed, ','), '') as failed from m left join r using (trial_id) left join c using (slot_id)")
def trial_assembly(spark, sf):
    m = read(spark, sf, "orders").select(F.col("o_orderkey").alias("trial_id"), F.col("o_custkey").alias("slot_id"))
    r = read(spark, sf, "lineitem").where("l_quantity > 30").groupBy(F.col("l_orderkey").alias("trial_id")).agg(F.collect_set("l_returnflag").alias("failed"), (F.max("l_partkey") % 4).alias("keyframes"), F.lit(True).alias("verified"))
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("slot_id"), (F.col("c_nationkey") % 4).alias("keyframes"))
    return assurance.trials(m, r, c).select("trial_id", "verified", "binding_mismatch", F.array_join("failed", ",").alias("failed"))
