"""Queries of sampling, allocation and experiment design."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import design, sampling
from millrace.plans.base import read, registry

query, QUERIES, SQL = registry()


@query("first_n_per_tier", "select source, doc_id, cast(rank as int) as rank, request_order from (select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as rank, case source when 'src3' then 0 when 'src1' then 1 when 'src7' then 2 end as request_order from documents) where rank <= case source when 'src3' then 5 when 'src1' then 9 when 'src7' then 2 else 0 end")
def first_n_per_tier(spark, sf):
    d = read(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return sampling.first_n(d, "source", [F.desc("n_chars"), F.col("doc_id")], {"src3": 5, "src1": 9, "src7": 2}).select("source", "doc_id", "rank", "request_order")


@query("request_shortfall", """select c as "check", coalesce(n, 0) >= asked as ok from (values ('src3', 5), ('src1', 900000000), ('none', 1)) v(c, asked) left join (select source, count(*) as n from documents group by source) on source = c""")
def request_shortfall(spark, sf):
    return sampling.shortfall(read(spark, sf, "documents"), "source", {"src3": 5, "src1": 900_000_000, "none": 1})


_DRAW = "sha256({} || '|' || {})"


@query("stratified_sample", "with r as (select c_mktsegment, c_custkey, row_number() over (partition by c_mktsegment order by sha256('42|' || c_custkey), c_custkey) as rn, count(*) over (partition by c_mktsegment) as population from customer) select c_mktsegment, c_custkey, cast(rn as int) as draw, population, least(population, 25) as sampled, round(population / least(population, 25), 9) as weight from r where rn <= 25")
def stratified_sample(spark, sf):
    s = sampling.stratified(read(spark, sf, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 25, 42)
    return s.select("c_mktsegment", "c_custkey", "draw", "population", "sampled", F.round("weight", 9).alias("weight"))


_ALLOC = """with g as (select {key} as k, count(*) as size from {table} group by 1), t as (select sum(size) as total from g), f as (select k, size, {n} * size // total as fl, {n} * size % total as rest, total from g, t),
 r as (select *, row_number() over (order by rest desc, size desc, k desc) as rn, least({n}, total) - sum(fl) over () as free from f)"""


@query("largest_remainder", _ALLOC.format(key="c_nationkey", table="customer", n=101) + " select k as c_nationkey, size, cast(fl + case when rn <= free then 1 else 0 end as bigint) as places from r")
def largest_remainder(spark, sf):
    groups = read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("size"))
    return sampling.allocated(groups, "c_nationkey", "size", 101)


@query("semantic_review_set", """with d as (select d.doc_id, d.lang, case when quality = 1 and toxic = 0 then 'ACCEPT' when quality = 0 then 'REJECT' else 'UNRESOLVED' end as label from documents d left join labels l on d.doc_id = l.doc_id),
 o as (select *, lang || '|' || label as grp from d where label <> 'ACCEPT'), g as (select grp as k, count(*) as size from o group by 1), t as (select sum(size) as total from g), f as (select k, size, 60 * size // total as fl, 60 * size % total as rest, total from g, t),
 r as (select k, fl + case when row_number() over (order by rest desc, size desc, k desc) <= least(60, total) - sum(fl) over () then 1 else 0 end as places from f),
 s as (select o.*, row_number() over (partition by grp order by sha256('7|' || doc_id), doc_id) as rn from o)
 select doc_id, label, 'all' as why from d where label = 'ACCEPT' union all select doc_id, label, 'sample' from s join r on grp = k where rn <= places""")
def semantic_review_set(spark, sf):
    return sampling.review_set(gold(spark, sf), "label", "lang", "doc_id", 60, 7)


def gold(spark, sf):
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "ACCEPT").when(F.col("quality") == 0, "REJECT").otherwise("UNRESOLVED")
    return read(spark, sf, "documents").select("doc_id", "lang", "source").join(read(spark, sf, "labels"), "doc_id", "left").select("doc_id", "lang", "source", label.alias("label"))


@query("blinded_tasks", "select doc_id, length(text) as n, cast(null as varchar) as label, cast(null as varchar) as annotator_id from documents where lang = 'es'")
def blinded_tasks(spark, sf):
    """Only allow-listed fields, and a blank annotation."""
    none = F.lit(None).cast("string")
    return read(spark, sf, "documents").where("lang = 'es'").select("doc_id", F.length("text").cast("long").alias("n"), none.alias("label"), none.alias("annotator_id"))


@query("comparator_predictions", "select doc_id, method, case when method = 'rule_only' and lang in ('fr', 'de') then null when method = 'hybrid' and lang = 'es' then null when n_chars % 3 = 0 then 'accept' else 'reject' end as prediction from documents, (values ('rule_only'), ('hybrid')) m(method)")
def comparator_predictions(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang", "n_chars").withColumn("method", F.explode(F.array(F.lit("rule_only"), F.lit("hybrid"))))
    abstains = ((F.col("method") == "rule_only") & F.col("lang").isin("fr", "de")) | ((F.col("method") == "hybrid") & (F.col("lang") == "es"))
    return d.select("doc_id", "method", F.when(~abstains, F.when(F.col("n_chars") % 3 == 0, "accept").otherwise("reject")).alias("prediction"))


@query("cyclic_donors", "with p as (select o_custkey, o_orderkey, o_orderpriority, row_number() over (partition by o_custkey order by o_orderkey) - 1 as at, count(*) over (partition by o_custkey) as n from orders) select a.o_custkey, a.o_orderkey, b.o_orderkey as donor, substr(a.o_orderpriority, 1, 1) <> substr(b.o_orderpriority, 1, 1) as other_cluster from p a join p b on a.o_custkey = b.o_custkey and (a.at + 2) % a.n = b.at")
def cyclic_donors(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("c"))
    return sampling.cyclic_donors(o, "o_custkey", "o_orderkey", "c", 2)


@query("opaque_ids", "select s_suppkey, 'ART_' || upper(substr(sha256('trial|' || s_suppkey || '|' || s_name), 1, 20)) as opaque_id from supplier")
def opaque_ids(spark, sf):
    return read(spark, sf, "supplier").select("s_suppkey", sampling.opaque_id("ART_", "trial", F.col("s_suppkey"), F.col("s_name")).alias("opaque_id"))


@query("seeded_permutation", "select turn, conv_id, cast(row_number() over (partition by turn order by sha256('11|' || turn || '|' || conv_id), conv_id) as int) as position from (select distinct turn, conv_id from conversations)")
def seeded_permutation(spark, sf):
    return sampling.permuted(read(spark, sf, "conversations").select("turn", "conv_id").distinct(), "turn", "conv_id", 11)


@query("clean_controls", "select s_nationkey, min(s_suppkey) as s_suppkey, count(*) = 1 as one_per_slot from supplier where s_acctbal > 5000 group by s_nationkey")
def clean_controls(spark, sf):
    return read(spark, sf, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"), (F.count("*") == 1).alias("one_per_slot"))


CASES_SQL = "cases as (select 'C' || lpad(cast(c_custkey as varchar), 10, '0') as slot_id, case c_custkey % 4 when 0 then 'rear_end' when 1 then 'intersection_crossing_turning' when 2 then 'lane_change_side_swipe' else 'head_on_centerline_intrusion' end as topology, case when c_custkey // 4 % 2 = 0 then 'rule' else 'model' end as route from customer)"


def cases(spark, sf):
    """Every customer as a case of a design."""
    k = F.col("c_custkey")
    topology = F.when(k % 4 == 0, "rear_end").when(k % 4 == 1, "intersection_crossing_turning").when(k % 4 == 2, "lane_change_side_swipe").otherwise("head_on_centerline_intrusion")
    return read(spark, sf, "customer").select(F.concat(F.lit("C"), F.lpad(k.cast("string"), 10, F.lit("0"))).alias("slot_id"), topology.alias("topology"), F.when(F.floor(k / 4) % 2 == 0, "rule").otherwise("model").alias("route"))


@query("design_balance", f"""with {CASES_SQL}, c as (select topology, route, count(*) as n, grouping_id(topology, route) as g from cases group by cube (topology, route))
 select coalesce(topology, '*') || '/' || coalesce(route, '*') as "check", n = (select count(*) from cases) // case g when 3 then 1 when 1 then 4 when 2 then 2 else 8 end as ok from c union all select 'unique slots', count(slot_id) = count(distinct slot_id) from cases""")
def design_balance(spark, sf):
    c = cases(spark, sf)
    n = c.count()
    return design.balance(c, design.Design(slots=n, per_topology=n // 4, per_route=n // 2, per_cell=n // 8))


NUMBERED_SQL = f"with {CASES_SQL}, n as (select *, row_number() over (order by slot_id) - 1 as case_no, coalesce(lead(slot_id) over (order by slot_id), first_value(slot_id) over (order by slot_id)) as nxt from cases)"


@query("fidelity_schedule", NUMBERED_SQL + " select slot_id || '_s' || (100 + 10 * case_no + k) || '_r' || r as run_id, slot_id, cast(100 + 10 * case_no + k as bigint) as seed, cast(r as int) as repeat_index from n, range(2) a(k), range(1, 3) b(r)")
def fidelity_schedule(spark, sf):
    return design.schedule(cases(spark, sf))


PLAN_SQL = NUMBERED_SQL + """, f(fault_no, fault_type, fault_class, disposition) as (values (0, 'actor_target_swap', 'immutable', 'manual_review'), (1, 'required_collision_omission', 'mutable', 'repair'), (2, 'event_order_violation', 'immutable', 'manual_review'),
 (3, 'speed_pose_perturbation', 'mutable', 'repair'), (4, 'map_lane_mismatch', 'mutable', 'repair'), (5, 'mismatched_keyframes', 'immutable', 'manual_review')),
 plan as (select slot_id || '__control' as trial_id, slot_id, 'control' as trial_kind, null as fault_type, null as fault_class, 'accept' as disposition, null as donor, null as variant from n
 union all select slot_id || '__' || fault_type, slot_id, 'fault', fault_type, fault_class, disposition, case when fault_type = 'mismatched_keyframes' then nxt end, (case_no + fault_no) % 2 from n, f)"""


@query("fault_plan", PLAN_SQL + " select trial_id, slot_id, trial_kind, fault_type, fault_class, disposition, donor, cast(variant as int) as variant from plan")
def fault_plan(spark, sf):
    return design.fault_plan(cases(spark, sf)).select("trial_id", "slot_id", "trial_kind", "fault_type", "fault_class", "disposition", "donor", "variant")


@query("evaluation_grid", PLAN_SQL + ", m(method) as (values ('deterministic_telemetry_only'), ('image_only_vlm'), ('telemetry_plus_vlm_no_repair'), ('guarded_bounded_repair'), ('unconstrained_self_refinement')) select method, trial_kind, fault_class, count(*) as n from plan, m group by all")
def evaluation_grid(spark, sf):
    return design.evaluation_grid(design.fault_plan(cases(spark, sf))).groupBy("method", "trial_kind", "fault_class").agg(F.count("*").alias("n"))


@query("plan_readiness", "select blockers, ready, count(*) as n from (select array_to_string(list_filter([case when s_acctbal < 0 then 'no balance' end, case when s_nationkey < 5 then 'route open' end, case when s_suppkey % 10 = 0 then 'unconfirmed' end], lambda x: x is not null), ',') as blockers, s_acctbal >= 0 and s_nationkey >= 5 and s_suppkey % 10 <> 0 as ready from supplier) group by all")
def plan_readiness(spark, sf):
    b = design.blockers(read(spark, sf, "supplier"), {"no balance": F.col("s_acctbal") < 0, "route open": F.col("s_nationkey") < 5, "unconfirmed": F.col("s_suppkey") % 10 == 0})
    return b.select(F.array_join("blockers", ",").alias("blockers"), "ready").groupBy("blockers", "ready").agg(F.count("*").alias("n"))


@query("replicate_plan", "with e as (select c_custkey, row_number() over (order by c_custkey) as pos, count(*) over () as n from customer), k as (select c_custkey, 2000 // n + case when pos <= 2000 % n then 1 else 0 end as k from e), r as (select c_custkey, unnest(range(1, k + 1)) as replicate from k) select c_custkey, cast(replicate as int) as replicate, cast((row_number() over (order by replicate, c_custkey) - 1) % 12 as int) as worker from r")
def replicate_plan(spark, sf):
    return design.replicate_plan(read(spark, sf, "customer"), "c_custkey", 2000, 12)
