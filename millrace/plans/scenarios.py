"""Queries of contracts compiled from the graphs of whole documents: fields, problems, guarded repairs, reports, bounded loops."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import blind, faults, graphs, scenarios
from millrace.plans.base import read, registry, spread
from millrace.plans.extraction import PROSE
from millrace.plans.relations import GRAPH_SQL
from millrace.sources.scratch import stored

query, QUERIES, SQL = registry()

PLACES = [("intersection", ("keit ", "tionen "), "Town05"), ("multi_lane", ("ation", "ment"), "Town04"), ("straight_road", ("and",), "Town01")]

# Contracts of the graphs as extracted; tier C where 9 divides n_chars.
CONTRACT_SQL = GRAPH_SQL + """,
kd as (select doc_id, start + verb as at_, 'collision_event_' || clause as id, 'vehicle_collision' as kind, quote from c union all select doc_id, start, 'maneuver_event_' || n, kind, quote from mv),
sq as (select kd.*, row_number() over (partition by doc_id order by at_, id) as step from kd join fi using (doc_id)),
nv as (select doc_id, count(*) as actors from nodes group by doc_id),
ar as (select doc_id, n_chars, case when n_chars % 9 = 0 then 'C_reextract_or_review' else 'A_minimum_grounded' end as tier, case when contains(text, 'keit ') or contains(text, 'tionen ') then 'intersection' when contains(text, 'ation') or contains(text, 'ment') then 'multi_lane' when contains(text, 'and') then 'straight_road' else 'unknown' end as archetype from documents),
ac as (select n.doc_id, n.ord, label, 'vehicle_' || (n.ord + 1) as actor_id, case when 'vehicle_' || (n.ord + 1) = fi.agent then 'ego' when 'vehicle_' || (n.ord + 1) = fi.target then 'target' else 'other' end as role from nodes n left join fi using (doc_id)),
fd as (select doc_id, 'actors.' || ord || '.vehicle_type' as path, label as value, 'observed' as provenance, 0.8 as confidence, true as has_value from ac
 union all select doc_id, 'actors.' || ord || '.blueprint', case when contains(lower(label), 'suv') then 'suv' else 'generic' end, 'defaulted', 0.6, true from ac union all select doc_id, 'actors.' || ord || '.lane_position', 'lane_relative', 'defaulted', 0.5, true from ac
 union all select doc_id, 'actors.' || ord || '.initial_speed_mps', case when role = 'ego' then '8.0' else '3.0' end, 'defaulted', 0.4, true from ac
 union all select doc_id, 'map_binding.archetype', archetype, case when archetype = 'unknown' then 'unknown' else 'inferred' end, case when archetype = 'unknown' then 0.2 else 0.7 end, true from ar
 union all select doc_id, 'map_binding.map', case archetype when 'intersection' then 'Town05' when 'multi_lane' then 'Town04' else 'Town01' end, 'defaulted', 0.5, true from ar
 union all select doc_id, 'topology', case archetype when 'intersection' then 'intersection_crossing_turning' when 'multi_lane' then 'lane_change_side_swipe' else 'unknown' end, case when archetype in ('intersection', 'multi_lane') then 'inferred' else 'unknown' end, case when archetype in ('intersection', 'multi_lane') then 0.55 else 0.0 end, true from ar
 union all select doc_id, 'event_sequence.' || (step - 1) || '.description', case when kind = 'vehicle_collision' then 'required collision between grounded actors' else 'grounded pre-collision event: ' || kind end, 'observed', case when kind = 'vehicle_collision' then 0.9 else 0.8 end, true from sq
 union all select doc_id, 'collision_constraints.0', null, 'observed', 1.0, false from fi),
pc as (select distinct doc_id from c where """ + "contains(quote, 'idiot') or contains(quote, 'Licensed')" + """),
iss as (select hd.doc_id, tier, list_distinct(flags || case when pc.doc_id is not null then ['collision is grounded only in a party claim'] else [] end || case when tier[1] = 'C' then ['Tier C cannot be promoted automatically'] else [] end || case when coalesce(actors, 0) < 2 then ['contract requires at least two vehicle actors'] else [] end
 || case when fi.doc_id is null then ['grounded collision agent/target is missing'] else [] end) as issues, coalesce(actors, 0) as actors, fi.doc_id is not null as crashed from hd join ar using (doc_id) left join nv using (doc_id) left join fi using (doc_id) left join pc using (doc_id)),
stt as (select *, case when actors < 2 then 'blocked' when len(issues) > 0 then 'needs_review' else 'needs_defaults' end as status from iss)
"""


def contract(spark, sf, *kept):
    """The contracts of all documents; kept names the tables that are read several times."""
    d = spread(read(spark, sf, "documents").select("doc_id", "text", "source", "n_chars"), "doc_id")
    d = d.withColumn("tier", F.when(F.col("n_chars") % 9 == 0, "C_reextract_or_review").otherwise("A_minimum_grounded"))
    g = graphs.extracted(d, "doc_id", "text", "source", PROSE)
    c = scenarios.compiled(g, d, "doc_id", "text", "tier", PLACES)
    return c._replace(**{name: stored(getattr(c, name)) for name in kept})


@query("contract_fields", CONTRACT_SQL + "select doc_id, path, value, provenance, cast(confidence as double) as confidence, has_value from fd")
def contract_fields(spark, sf):
    return contract(spark, sf).fields.select("doc_id", "path", "value", "provenance", "confidence", "has_value")


@query("contract_heads", CONTRACT_SQL + """, ip as (select doc_id, 'actors.' || actor_id || '.vehicle_type' as path from ac union all select doc_id, 'event_sequence.' || (step - 1) || '.description' from sq union all select doc_id, 'collision_constraints.0' from fi),
il as (select doc_id, md5(string_agg(path, ',' order by path)) as immutable, count(*) as paths from ip group by doc_id)
select doc_id, tier, status, array_to_string(list_sort(issues), '|') as issues, coalesce(immutable, md5('')) as immutable, coalesce(paths, 0) as paths,
 array_to_string(case when actors < 2 then ['at least two actors are required'] else [] end || case when tier[1] = 'C' then ['Tier C is review-only and cannot be compiled'] else [] end || case when status <> 'needs_defaults' then ['contract status is ' || status] else [] end, '|') as problems from stt left join il using (doc_id)""")
def contract_heads(spark, sf):
    """Status, review issues, immutable paths and problems of the contract of every document."""
    c = contract(spark, sf, "heads", "actors", "fields")
    paths = F.col("immutable_paths")
    return c.heads.join(scenarios.problems(c, "doc_id"), "doc_id").select("doc_id", "tier", "status", F.array_join(F.array_sort("review_issues"), "|").alias("issues"), F.md5(F.array_join(paths, ",")).alias("immutable"), F.size(paths).cast("long").alias("paths"), F.array_join("problems", "|").alias("problems"))


# Six instructions a document: a constraint, a speed, a blueprint (empty where 3 divides doc_id), a map, a topology, a lane.
_ASKED = "[{'o': 0, 'path': 'collision_constraints.0', 'value': 'x'}, {'o': 1, 'path': 'actors.0.initial_speed_mps', 'value': cast(n_chars as varchar)}, {'o': 2, 'path': 'actors.1.blueprint', 'value': case when doc_id % 3 = 0 then '' else 'bus' end}, {'o': 3, 'path': 'topology', 'value': 'rear_end'}, {'o': 4, 'path': 'map_binding.map', 'value': case when doc_id % 5 = 0 then null else 'Town07' end}, {'o': 5, 'path': 'actors.9.lane_position', 'value': 'left'}]"


def instructions(d):
    k = F.col("doc_id")
    rows = [(F.lit("collision_constraints.0"), F.lit("x")), (F.lit("actors.0.initial_speed_mps"), F.col("n_chars").cast("string")), (F.lit("actors.1.blueprint"), F.when(k % 3 == 0, "").otherwise("bus")),
            (F.lit("topology"), F.lit("rear_end")), (F.lit("map_binding.map"), F.when(k % 5 != 0, "Town07")), (F.lit("actors.9.lane_position"), F.lit("left"))]
    return d.select("doc_id", F.posexplode(F.array(*(F.struct(p.alias("path"), v.alias("value")) for p, v in rows))).alias("ord", "i")).select("doc_id", "ord", "i.path", "i.value")


@query("guarded_repair", CONTRACT_SQL + f""", ask as (select doc_id, unnest({_ASKED}, recursive := true) from ar),
jd as (select ask.doc_id, o, ask.path, ask.value, coalesce(provenance in ('inferred', 'defaulted'), false) and coalesce(has_value, false) as ok from ask left join fd on fd.doc_id = ask.doc_id and fd.path = ask.path),
ru as (select *, coalesce(sum(ok::int) over (partition by doc_id order by o rows between unbounded preceding and 1 preceding), 0) as n from jd), rl as (select *, coalesce(sum((n >= 3)::int) over (partition by doc_id order by o rows between unbounded preceding and 1 preceding), 0) as late from ru),
nt as (select doc_id, o, path, value, ok and n < 3 as applied, case when n >= 3 then 'repair limit reached' when ok then 'applied repair: ' || path else 'rejected immutable/observed repair: ' || path end as note from rl where late = 0),
ro as (select distinct doc_id from nt where applied and ((path = 'actors.1.blueprint' and value = '') or (path = 'map_binding.map' and value is null))),
gn as (select doc_id, string_agg(note, '|' order by o) || case when doc_id in (select doc_id from ro) then '|repair rollback: contract validation regressed' else '' end as notes from nt group by doc_id),
ch as (select fd.doc_id, string_agg(fd.path || '=' || coalesce(nt.value, 'null'), '|' order by fd.path) as changed from fd join nt on nt.doc_id = fd.doc_id and nt.path = fd.path and applied where fd.doc_id not in (select doc_id from ro) group by fd.doc_id)
select doc_id, notes, coalesce(changed, '') as changed from gn left join ch using (doc_id)""")
def guarded_repair(spark, sf):
    """Notes of six instructions for every contract, and what its fields are changed to after limit and roll-back."""
    c = contract(spark, sf, *scenarios.Contract._fields)
    done, notes = scenarios.repaired(c, instructions(read(spark, sf, "documents")), "doc_id")
    was = c.fields.select("doc_id", "path", F.struct("value", "provenance").alias("_was"))
    new = F.struct("value", "provenance")
    asked = F.col("path").isin("actors.0.initial_speed_mps", "actors.1.blueprint", "topology", "map_binding.map")
    changed = done.fields.where(asked).join(was, ["doc_id", "path"]).where(~new.eqNullSafe(F.col("_was"))).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("path", F.lit("="), F.coalesce("value", F.lit("null"))))), "|").alias("changed"))
    return notes.join(changed, "doc_id", "left").select("doc_id", F.array_join("notes", "|").alias("notes"), F.coalesce("changed", F.lit("")).alias("changed"))


# A conversation is the record of the loop of the document of its number: a turn is a round, its text's length tells what came out.
ROUND_SQL = """, rd as (select conv_id as doc_id, turn as it, length(text) as l from conversations where turn <= 3),
rs as (select doc_id, it, 'lane' as name, l % 13 > 1 as passed from rd union all select doc_id, it, 'speed', l % 11 > 0 from rd union all select doc_id, it, 'collision', l % 2 = 0 from rd where l % 17 > 0),
rp as (select doc_id, it, unnest(case when l % 9 = 0 then [] when l % 4 = 0 then [{'o': 0, 'path': 'collision_constraints.0', 'value': 'x'}] when l % 4 = 1 then [{'o': 0, 'path': 'topology.unknown', 'value': 'x'}, {'o': 1, 'path': 'actors.0.initial_speed_mps', 'value': cast(l % 3 as varchar)}]
 when l % 4 = 2 then [{'o': 0, 'path': 'actors.0.lane_position', 'value': 'lane_relative'}] else [{'o': 0, 'path': 'map_binding.map', 'value': 'Town0' || (l % 3 + 4)}] end, recursive := true) from rd)"""


def _told(name, passed):
    return F.struct(F.lit(name).alias("name"), passed.alias("passed"))


def rounds(spark, sf):
    """reports, repairs and results, with doc_id for the conversation."""
    r = read(spark, sf, "conversations").where("turn <= 3").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("iteration"), F.length("text").alias("l"))
    n = F.col("l")
    reports = r.select("doc_id", "iteration", (n % 7 == 0).alias("passed"), F.when(n % 5 == 0, F.array(F.lit("collision_target"))).when(n % 6 == 1, F.array(F.lit("pose"))).otherwise(F.array().cast("array<string>")).alias("failures"), (n % 19 == 0).alias("manual_review"), F.array().cast("array<string>").alias("notes"))
    one = lambda p, v: F.struct(F.lit(p).alias("path"), v.alias("value"))
    x = F.lit("x")
    asked = F.when(n % 9 == 0, F.array().cast("array<struct<path:string,value:string>>")).when(n % 4 == 0, F.array(one("collision_constraints.0", x))).when(n % 4 == 1, F.array(one("topology.unknown", x), one("actors.0.initial_speed_mps", (n % 3).cast("string")))).when(n % 4 == 2, F.array(one("actors.0.lane_position", F.lit("lane_relative")))).otherwise(F.array(one("map_binding.map", F.concat(F.lit("Town0"), (n % 3 + 4).cast("string")))))
    repairs = r.select("doc_id", "iteration", F.posexplode(asked).alias("ord", "i")).select("doc_id", "iteration", "ord", "i.path", "i.value")
    told = F.array_compact(F.array(_told("lane", n % 13 > 1), _told("speed", n % 11 > 0), F.when(n % 17 > 0, _told("collision", n % 2 == 0))))
    results = r.select("doc_id", "iteration", F.inline(told))
    return reports, repairs, results


@query("guarded_reports", CONTRACT_SQL + ROUND_SQL + """, r0 as (select * from rd where it = 0), rj as (select rp.doc_id, o, rp.path, coalesce(provenance in ('inferred', 'defaulted'), false) as ok from rp left join fd on fd.doc_id = rp.doc_id and fd.path = rp.path where it = 0),
ra as (select doc_id, coalesce(list(path order by o) filter (where ok), []) as accepted, coalesce(list('provenance guard rejected repair path: ' || path order by o) filter (where not ok), []) as guard from rj group by doc_id),
rb as (select doc_id, list('deterministic:' || name order by name) as bad from rs where it = 0 and not passed group by doc_id),
rr as (select r0.doc_id, l % 7 = 0 as passed, case when l % 5 = 0 then ['collision_target'] when l % 6 = 1 then ['pose'] else [] end as failures, l % 19 = 0 as review, coalesce(accepted, []) as accepted, coalesce(guard, []) as guard, coalesce(bad, []) as bad, coalesce(len(issues) > 0, false) as issue from r0 left join ra using (doc_id) left join rb using (doc_id) left join stt using (doc_id)),
ry as (select *, guard || case when not passed and len(failures) = 0 then ['consistency guard: passed=false had no concrete failure entry'] else [] end as notes from rr)
select doc_id, case when len(bad) > 0 then false else passed end as passed, array_to_string(failures || bad, '|') as failures, array_to_string(accepted, '|') as accepted, cast(len(guard) as int) as rejected, review or len(bad) > 0 or len(failures) > 0 or issue or len(notes) > 0 as manual_review, array_to_string(notes, '|') as notes from ry""")
def guarded_reports(spark, sf):
    """The first round of every loop after the guards: failures, accepted repairs, review and notes."""
    first = lambda df: df.where("iteration = 0").drop("iteration")
    r = scenarios.guarded_report(contract(spark, sf, "heads"), *map(first, rounds(spark, sf)), "doc_id")
    return r.select("doc_id", "passed", *(F.array_join(c, "|").alias(c) for c in ("failures", "accepted")), "rejected", "manual_review", F.array_join("notes", "|").alias("notes"))


@query("assurance_endings", CONTRACT_SQL.replace("with e as", "with recursive e as", 1) + ROUND_SQL + """, rj as (select rp.doc_id, it, o, rp.path, rp.value, fd.value as was, provenance from rp join fd on fd.doc_id = rp.doc_id and fd.path = rp.path and provenance in ('inferred', 'defaulted') and has_value),
rf as (select doc_id, it, arg_min({'path': path, 'value': value, 'was': was, 'p': provenance}, o) as fix from rj group by doc_id, it), rk as (select doc_id, it, true as asked from rp group by doc_id, it), rg as (select doc_id, it, list(name) as good from rs where passed group by doc_id, it),
ra as (select rd.doc_id, it, l % 7 = 0 as passed, l % 5 = 0 and fi.doc_id is not null as hit, coalesce(asked, false) as asked, coalesce(good, []) as good, fix from rd left join rf using (doc_id, it) left join rk using (doc_id, it) left join rg using (doc_id, it) left join fi using (doc_id)),
lo as (select doc_id, cast(-1 as bigint) as it, cast([] as varchar[]) as before, cast([] as varchar[]) as lost, map([]::varchar[], []::varchar[]) as patches, cast(null as varchar) as ended from (select distinct doc_id from rd)
 union all select doc_id, it, list_distinct(before || good), lost, case when len(lost) > 0 then map([]::varchar[], []::varchar[]) when ended is not null then patches else map_concat(patches, map([fix.path], [fix.value])) end, ended from (
 select *, case when len(lost) > 0 then 'repair regressed previously passing constraints' when passed then 'passed' when hit then 'observed collision constraint cannot be repaired' when it >= 3 or not asked then 'repair limit reached or no bounded repair is available'
 when fix is null or case when len(map_extract(patches, fix.path)) > 0 then map_extract(patches, fix.path)[1] = fix.value else fix.p = 'defaulted' and fix.was = fix.value end then 'repair was rejected by provenance guard' end as ended
 from (select lo.doc_id, ra.it, before, good, patches, list_sort(list_filter(before, lambda b: not list_contains(good, b))) as lost, passed, hit, asked, fix from lo join ra on ra.doc_id = lo.doc_id and ra.it = lo.it + 1 where lo.ended is null))),
la as (select doc_id, max(it) as it from lo group by doc_id)
select doc_id, case when ended is null then 'open' when ended = 'passed' then 'passed' else 'manual_review' end as status, case when ended <> 'passed' then ended end as reason, cast(it + 1 as int) as rounds, array_to_string(lost, '|') as regressed,
 array_to_string(list_sort(list_transform(map_entries(patches), lambda x: x.key || '=' || x.value)), '|') as patches from lo join la using (doc_id, it)""")
def assurance_endings(spark, sf):
    """How the loop of every conversation's rounds ends over the contract of its document."""
    done = scenarios.assurance_loop(contract(spark, sf), *rounds(spark, sf), "doc_id")
    return done.select("doc_id", "status", "reason", "rounds", F.array_join("regressed", "|").alias("regressed"), F.array_join(F.transform("patches", lambda x: F.concat(x["key"], F.lit("="), x["value"])), "|").alias("patches"))


# -- controlled faults: six for every contract; the conversation of a document's number is the record of its run, the next document lends its frames
KINDS = [faults.OMISSION, faults.SPEED_POSE, faults.MAP_LANE, faults.SWAP, faults.ORDER, faults.FRAMES]


def faulty(spark, sf):
    c = contract(spark, sf, "actors", "fields")
    t = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("turn"), F.length("text").alias("l"))
    even = F.col("turn") % 2 == 0
    named = F.when(even, "vehicle_1").otherwise("vehicle_2").alias("actor_id"), F.when(even, "vehicle_2").otherwise("vehicle_3").alias("other_actor_id")
    results = t.where("turn < 3").select("doc_id", F.element_at(F.array(*map(F.lit, ("collision_target", "event_order", "lane"))), F.col("turn") + 1).alias("name"), (F.col("l") % 2 == 0).alias("passed"), F.lit("e").alias("expected"), F.col("l").cast("string").alias("observed"), F.lit(None).cast("string").alias("reason"))
    runs = faults.Runs(t.select("doc_id", F.col("turn").alias("n"), *named), results, t.select("doc_id", F.col("turn").alias("pos"), F.format_string("f%d_%d", "turn", "l").alias("path")))
    plan = read(spark, sf, "documents").select("doc_id", F.explode(F.array(*map(F.lit, KINDS))).alias("fault_type"))
    plan = plan.select(F.concat(F.col("doc_id").cast("string"), F.lit("__"), "fault_type").alias("trial_id"), "doc_id", "fault_type", F.when(F.col("doc_id") % 2 == 0, "speed").otherwise("pose").alias("variant"), (F.col("doc_id") + 1).alias("donor"))
    return c, faults.injected(c, runs, plan, "doc_id")


FAULT_SQL = CONTRACT_SQL + """, bst as (select doc_id, arg_min(ord, case role when 'ego' then 0 when 'target' then 1 else 3 end * 100000 + ord) as ord from ac group by doc_id),
ev as (select doc_id, list('event_' || step || '_' || kind order by step) as events from sq group by doc_id), kf as (select conv_id as doc_id, list(('f' || turn || '_' || length(text)) order by turn) as frames from conversations group by conv_id),
cf as (select ar.doc_id, archetype, bst.ord, case when bst.ord is null then null when role = 'ego' then 8.0::double else 3.0::double end as speed, fi.agent, fi.target, case when len(events) >= 2 then events else ['runtime_initial_state', 'runtime_required_collision'] end as events, coalesce(len(events), 0) >= 2 as grounded, coalesce(kf.frames, []) as frames, coalesce(k2.frames, []) as lent,
 case archetype when 'intersection' then 'Town05' when 'multi_lane' then 'Town04' else 'Town01' end as town, case when ar.doc_id % 2 = 0 then 'speed' else 'pose' end as variant from ar left join bst using (doc_id) left join ac on ac.doc_id = ar.doc_id and ac.ord = bst.ord left join fi on fi.doc_id = ar.doc_id left join ev on ev.doc_id = ar.doc_id left join kf on kf.doc_id = ar.doc_id left join kf k2 on k2.doc_id = ar.doc_id + 1),
lg as (select doc_id, 'required_collision_omission' as fault_type, 'actors.' || ord || '.lane_position' as path, 'lane_relative' as oracle, 'collision_omission_fault' as injected, cast(null as varchar) as basis, case when ord is null then 'no mutable causal field is available to induce collision omission' end as error from cf
 union all select doc_id, 'speed_pose_perturbation', 'actors.' || ord || case variant when 'speed' then '.initial_speed_mps' else '.lane_position' end, case variant when 'speed' then cast(speed as varchar) else 'lane_relative' end, case variant when 'speed' then cast(speed + greatest(5.0::double, speed / 2) as varchar) else 'pose_perturbation_fault' end, variant,
 case when ord is null and variant = 'speed' then 'no mutable speed field is available' when ord is null then 'no mutable lane-position field is available' end from cf
 union all select doc_id, 'map_lane_mismatch', case when agent is not null then 'actors.' || ord || '.lane_position' else 'map_binding.map' end, case when agent is not null then 'lane_relative' else town end, case when agent is not null then 'map_lane_mismatch_fault' when town = 'Town01' then 'Town05' when town = 'Town05' then 'Town04' else 'Town01' end, null, null from cf
 union all select doc_id, 'actor_target_swap', 'collision_constraints.0', agent || ',' || target, target || ',' || agent, null, case when agent is null then 'actor-target swap requires a collision constraint' when len(frames) = 0 then 'immutable fault materialization requires clean keyframes' end from cf
 union all select doc_id, 'event_order_violation', 'event_sequence', array_to_string(events, ','), array_to_string(list_reverse(events), ','), case when grounded then 'grounded_contract_events' else 'runtime_event_order_constraint' end, case when len(frames) = 0 then 'immutable fault materialization requires clean keyframes' end from cf
 union all select doc_id, 'mismatched_keyframes', 'simulation_result.keyframes', array_to_string(frames, ','), array_to_string(lent, ','), null, null from cf)
"""


@query("fault_ledger", FAULT_SQL + "select doc_id || '__' || fault_type as trial_id, case when error is null then path end as path, case when error is null then md5(oracle) end as oracle_value, case when error is null then md5(injected) end as injected_value, basis, error from lg")
def fault_ledger(spark, sf):
    """What each of six faults changes in the contract or run of every document, or why it cannot be made."""
    return faulty(spark, sf)[1].ledger.select("trial_id", "path", F.md5("oracle_value").alias("oracle_value"), F.md5("injected_value").alias("injected_value"), "basis", "error")


@query("fault_tables", FAULT_SQL + """, ok as (select * from lg where error is null), cl as (select conv_id as doc_id, turn, case when turn % 2 = 0 then 'vehicle_1' else 'vehicle_2' end as a, case when turn % 2 = 0 then 'vehicle_2' else 'vehicle_3' end as t from conversations)
select 'fields' as part, fault_type, count(*) as n, count(*) filter (where fault_type in ('required_collision_omission', 'speed_pose_perturbation', 'map_lane_mismatch') and fd.path = ok.path and fd.value is distinct from ok.injected) as changed from ok join fd using (doc_id) group by all
union all select 'collisions', fault_type, count(*), count(*) filter (where fault_type = 'actor_target_swap' and least(a, t) = least(fi.agent, fi.target) and greatest(a, t) = greatest(fi.agent, fi.target)) from ok join cl using (doc_id) left join fi using (doc_id) where fault_type in ('actor_target_swap', 'event_order_violation', 'mismatched_keyframes') group by all
union all select 'results', fault_type, count(*), count(*) filter (where put) from (select fault_type, false as put from ok join cl using (doc_id) where fault_type in ('actor_target_swap', 'event_order_violation', 'mismatched_keyframes') and turn < 3 and not (fault_type = 'actor_target_swap' and turn = 0) and not (fault_type = 'event_order_violation' and turn = 1) union all select fault_type, true from ok where fault_type in ('actor_target_swap', 'event_order_violation')) group by all
union all select 'keyframes', fault_type, count(*), count(*) filter (where fault_type = 'mismatched_keyframes') from ok join cl on cl.doc_id = case when fault_type = 'mismatched_keyframes' then ok.doc_id + 1 else ok.doc_id end where fault_type in ('actor_target_swap', 'event_order_violation', 'mismatched_keyframes') group by all""")
def fault_tables(spark, sf):
    """Rows of every linked table after the faults, and how many of them the faults have changed, by fault type."""
    f = faulty(spark, sf)[1]
    kind = F.split_part("trial_id", F.lit("__"), F.lit(2)).alias("fault_type")
    part = lambda name, df, changed: df.groupBy(F.lit(name).alias("part"), "fault_type").agg(F.count("*").alias("n"), F.count_if(changed).alias("changed"))
    swapped = f.collisions.select("*", kind)
    return (
        part("fields", f.fields.select("*", kind), ~F.col("value").eqNullSafe(F.col("clean")))
        .unionByName(part("collisions", swapped, F.when(F.col("n") % 2 == 0, F.col("actor_id") != "vehicle_1").otherwise(F.col("actor_id") != "vehicle_2")))
        .unionByName(part("results", f.results.select("*", kind), F.coalesce(F.startswith("reason", F.lit("controlled")), F.lit(False))))
        .unionByName(part("keyframes", f.keyframes.select("*", kind), F.col("fault_type") == faults.FRAMES))
    )


# Reruns: the turns of the document's conversation tell what was seen; the user of its number has the first states.
@query("fault_phenotypes", FAULT_SQL + """, rr as (select conv_id as doc_id, bool_or(length(text) % 3 = 0) as hit, bool_and(length(text) % 4 <> 1) as lane from conversations group by conv_id), s0 as (select user_id as doc_id, arg_min(value, event_id) as speed from events group by user_id),
ph as (select lg.*, hit, lane, s0.speed from lg left join rr using (doc_id) left join s0 using (doc_id) where error is null and fault_type in ('required_collision_omission', 'speed_pose_perturbation', 'map_lane_mismatch'))
select doc_id || '__' || fault_type as trial_id, fault_type, case when basis = 'speed' then abs(speed - cast(injected as double)) < abs(speed - cast(oracle as double)) when fault_type = 'required_collision_omission' then not hit else not lane end as verified from ph""")
def fault_phenotypes(spark, sf):
    """Whether the rerun of each contract fault shows it."""
    c, f = faulty(spark, sf)
    n = F.length("text")
    seen = read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.bool_or(n % 3 == 0).alias("actor_target_correct"), F.bool_and(n % 4 != 1).alias("lane_topology_valid"))
    trials = f.ledger.where("error is null").select("trial_id", "doc_id", "path")
    first = read(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("at"), F.col("value").alias("speed"))
    own = trials.where(F.endswith("path", F.lit("initial_speed_mps"))).withColumn("ord", F.split_part("path", F.lit("."), F.lit(2)).try_cast("int")).join(c.actors, ["doc_id", "ord"])
    states = own.select("trial_id", "doc_id", "actor_id").join(first, "doc_id").select("trial_id", "at", "actor_id", "speed")
    return faults.phenotypes(f.ledger, c.actors, trials.select("trial_id", "doc_id").join(seen, "doc_id").drop("doc_id"), states, "doc_id").select("trial_id", "fault_type", "verified")


# -- blind material ------------------------------------------------------------------------------
def hidden(c):
    """The contract with a marker in the lane of its first actor where 4 divides the key, and a foreign lane where it leaves 1."""
    k = F.col("doc_id") % 4
    lane = F.col("path") == "actors.0.lane_position"
    value = F.when(lane & (k == 0), "pose_perturbation fault").when(lane & (k == 1), "bus lane").otherwise(F.col("value"))
    return c._replace(fields=c.fields.withColumn("value", value))


BLIND_SQL = CONTRACT_SQL + """, vr as (select doc_id, 'actors' as section, ord, 'actor_id' as field, format('actor_{:02d}', ord + 1) as value from ac union all select doc_id, 'actors', ord, 'role', role from ac union all select doc_id, 'actors', ord, 'vehicle_type', label from ac
 union all select doc_id, 'actors', ord, 'blueprint', case when contains(lower(label), 'suv') then 'suv' else 'generic' end from ac union all select doc_id, 'actors', ord, 'lane_position', case when ord = 0 and doc_id % 4 < 2 then 'unrecognized_reference' else 'lane_relative' end from ac
 union all select doc_id, 'actors', ord, 'initial_speed_mps', case when role = 'ego' then '8.0' else '3.0' end from ac union all select doc_id, 'map', 0, 'map.archetype', archetype from ar union all select doc_id, 'map', 0, 'map.runtime_map', value from fd where path = 'map_binding.map' union all select doc_id, 'map', 0, 'topology', value from fd where path = 'topology'
 union all select doc_id, 'events', step, unnest(['event_id', 'order', 'kind', 'actor_id', 'target_id']), unnest([format('event_{:02d}', step), cast(step as varchar), case when kind = 'vehicle_collision' then 'collision' else kind end, (select format('actor_{:02d}', ord + 1) from ac where ac.doc_id = sq.doc_id and actor_id = fi.agent), case when kind = 'vehicle_collision' then (select format('actor_{:02d}', ord + 1) from ac where ac.doc_id = sq.doc_id and actor_id = fi.target) end]) from sq join fi using (doc_id)
 union all select doc_id, 'collision_constraints', 0, unnest(['actor_id', 'target_id', 'required']), unnest([(select format('actor_{:02d}', ord + 1) from ac where ac.doc_id = fi.doc_id and actor_id = fi.agent), (select format('actor_{:02d}', ord + 1) from ac where ac.doc_id = fi.doc_id and actor_id = fi.target), 'true']) from fi)
"""


@query("sanitised_views", BLIND_SQL + "select doc_id, section, cast(ord as int) as ord, field, value from vr")
def sanitised_views(spark, sf):
    """What may be seen of every contract: allow-listed fields, neutral ids, no markers."""
    return blind.sanitised(hidden(contract(spark, sf, "actors", "fields")), "doc_id").rows.select("doc_id", "section", "ord", "field", "value")


@query("mutability_classes", BLIND_SQL + """select doc_id, 'actors.' || format('actor_{:02d}', ord + 1) || '.' || f as field, case when f = 'vehicle_type' then 'immutable' else 'mutable' end as class from ac, unnest(['vehicle_type', 'blueprint', 'lane_position', 'initial_speed_mps']) u(f)
 union all select doc_id, replace(replace(path, 'map_binding.map', 'map.runtime_map'), 'map_binding', 'map'), case when provenance = 'unknown' then 'review' else 'mutable' end from fd where path in ('map_binding.archetype', 'map_binding.map', 'topology')
 union all select doc_id, 'events.' || format('event_{:02d}', step), 'immutable' from sq union all select doc_id, 'collision_constraints', 'immutable' from fi""")
def mutability_classes(spark, sf):
    return blind.sanitised(contract(spark, sf, "actors", "fields"), "doc_id").mutability


# A user's events are the telemetry of the document of its number, a conversation's turns its images; the next number lends both.
# Payloads of some documents are broken, and found: no classes in the guarded one (11 leaves 3), images in the control without (5), no shuffled images' text (7), a method gone (9).
@query("information_budgets", CONTRACT_SQL + """, im as (select conv_id as doc_id, count(*) as n from conversations group by conv_id), bd as (select ar.doc_id, ar.doc_id % 11 as k, coalesce(im.n, 0) as own, coalesce(i2.n, 0) as other from ar left join im using (doc_id) left join im i2 on i2.doc_id = ar.doc_id + 1),
pm as (select doc_id, k, code, cast(n as int) as keys, cast(i as int) as images from (select doc_id, k, unnest(['M00', 'M01', 'M02', 'M03', 'M04', 'M05', 'M06', 'M07']) as code, unnest([1, 1, 2, 3, case when k = 7 then 0 else 1 end, 2, 3, case when k = 3 then 3 else 4 end]) as n, unnest([0, own, 0, own, other, 0, case when k = 5 then own + 1 else 0 end, own]) as i from bd) where not (k = 9 and code = 'M02'))
select doc_id, string_agg(code || ':' || keys || ':' || images, '|' order by code) as budgets, case k when 3 then 'guarded budget must add exactly mutability_classes' when 5 then 'no-image control is not fusion evidence with images removed' when 7 then 'image-shuffled textual budget differs from image-only'
 when 9 then 'method set mismatch|fusion evidence is not the exact image/text plus telemetry union|telemetry-shuffled field budget differs from telemetry-only' else '' end as violations from pm group by doc_id, k""")
def information_budgets(spark, sf):
    """Number of evidence keys and images of eight methods for every contract, and the invariants that broken payloads violate."""
    views = stored(blind.evidence(blind.sanitised(contract(spark, sf, "actors", "fields"), "doc_id"), "doc_id"))  # read by shapes and by violations
    runs = read(spark, sf, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.to_json(F.struct(F.count("*").alias("samples"), F.min("value").alias("low"), F.max("value").alias("high"))).alias("summary"))
    shots = read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.format_string("A%d/F%02d", "conv_id", "turn"))).alias("own"))
    lent = lambda df, of, name: df.select((F.col("doc_id") - 1).alias("doc_id"), F.col(of).alias(name))
    telemetry = runs.join(lent(runs, "summary", "shuffled"), "doc_id", "full_outer")
    images = shots.join(lent(shots, "own", "shuffled_images"), "doc_id", "full_outer")
    k, method = F.col("doc_id") % 11, F.col("method")
    kept = F.when((k == 3) & (method == "guarded_blind_loop"), F.map_filter("evidence", lambda n, _: n != "mutability_classes")).when((k == 7) & (method == "image_shuffled"), F.map_filter("evidence", lambda n, _: F.lit(False))).otherwise(F.col("evidence"))
    own = F.element_at(F.collect_list(F.when(method == "image_only_vlm", F.col("images"))).over(Window.partitionBy("doc_id")), 1)
    given = blind.payloads(views, telemetry, images, "doc_id").withColumn("_own", own).where(~((k == 9) & (method == "telemetry_only"))).withColumn("evidence", kept)
    given = given.withColumn("images", F.when((k == 5) & (method == "no_image_fusion_prompt"), F.concat("_own", F.array(F.lit("more")))).otherwise(F.col("images"))).drop("_own")
    shape = blind.shapes(given, "doc_id").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "code", F.size("evidence_keys").cast("string"), F.col("image_count").cast("string")))), "|").alias("budgets"))
    return shape.join(blind.violations(given, "doc_id"), "doc_id").select("doc_id", "budgets", F.array_join("violations", "|").alias("violations"))
