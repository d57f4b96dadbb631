"""Scenario contracts as linked tables: compiled from graphs, validated, repaired with roll-back, broken on purpose and judged in a bounded loop.

A contract is five tables that share a key: heads (tier, status, immutable_paths,
review_issues, collision_sensor), actors (ord, actor_id, role), steps (ord, event_id, kind,
actor_id, target_id, step), limits (ord, actor_id, target_id, provenance) and fields (path,
value, provenance, confidence, evidence_ids, has_value), the last one long: a row for each
value that a repair can name. Values are strings.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import contracts, spans
from millrace.operators.graphs import Graph
from millrace.sources.scratch import stored

#: Topologies by archetype with their confidence, and the texts of problems, notes and endings.
TOPOLOGY = {"intersection": "intersection_crossing_turning", "multi_lane": "lane_change_side_swipe"}
PROBLEMS = {
    "twice": "actor IDs must be unique", "few": "at least two actors are required", "stranger": "collision constraint references an unknown actor", "same": "collision actor and target must differ",
    "order": "event order must be unique and ascending", "map": "map binding is missing", "sensor": "collision sensor is required", "tier": "Tier C is review-only and cannot be compiled",
}
REJECTED, INVALID, APPLIED, LIMIT, ROLLBACK = "rejected immutable/observed repair: ", "invalid repair path: ", "applied repair: ", "repair limit reached", "repair rollback: contract validation regressed"
GUARD, INCONSISTENT = "provenance guard rejected repair path: ", "consistency guard: passed=false had no concrete failure entry"
ENDINGS = {
    "regressed": "repair regressed previously passing constraints", "observed": "observed collision constraint cannot be repaired",
    "limit": "repair limit reached or no bounded repair is available", "guard": "repair was rejected by provenance guard",
}
PASSED, REVIEW = "passed", "manual_review"


class Contract(NamedTuple):
    heads: DataFrame
    actors: DataFrame
    steps: DataFrame
    limits: DataFrame
    fields: DataFrame


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _nothing() -> Column:
    return F.array().cast("array<string>")


# -- compilation ---------------------------------------------------------------------------------
def compiled(graph: Graph, docs: DataFrame, key: str, text: str, tier: str, places=contracts.ARCHETYPES) -> Contract:
    """The contract of every graph. Texts are read once, for their archetype."""
    hit = (F.col("relation") == "collides_with") & F.col("supported")
    first = graph.edges.where(hit).groupBy(key).agg(F.min_by(F.struct("source", "target", "provenance", "evidence_ids", "confidence"), "edge_ord").alias("e")).select(key, "e.*")
    first = stored(first.withColumnsRenamed({"source": "agent", "target": "other", "provenance": "_p", "evidence_ids": "_ev", "confidence": "_sure"}))
    vehicles = graph.nodes.where("type = 'vehicle'").join(first.select(key, "agent", "other"), key, "left")
    role = F.when(F.col("node_id") == F.col("agent"), "ego").when(F.col("node_id") == F.col("other"), "target").otherwise("other")
    actors = vehicles.select(key, "ord", F.col("node_id").alias("actor_id"), role.alias("role"), "label", "evidence_ids")

    events = graph.nodes.where("type = 'event'").select(key, "node_id", F.col("label").alias("kind"), "source_start", "evidence_ids")
    w = Window.partitionBy(key).orderBy(F.coalesce("source_start", F.lit(contracts.LATE)), "node_id")
    numbered = first.join(events, key, "left").withColumn("step", F.row_number().over(w))
    bare = F.col("node_id").isNull()  # a collision without events of its own
    crash = bare | (F.col("kind") == "vehicle_collision")
    told = F.when(crash, "required collision between grounded actors").otherwise(F.concat(F.lit("grounded pre-collision event: "), "kind"))
    steps = stored(numbered.select(
        key, (F.col("step") - 1).alias("ord"), F.when(bare, "event_collision_1").otherwise(F.concat(F.lit("event_"), F.col("step").cast("string"), F.lit("_"), "kind")).alias("event_id"),
        F.when(crash, "collision").otherwise(F.col("kind")).alias("kind"), F.col("agent").alias("actor_id"), F.when(crash, F.col("other")).alias("target_id"), "step", told.alias("description"),
        F.when(bare, F.col("_p")).otherwise("observed").alias("provenance"), F.when(bare, F.col("_sure")).when(crash, 0.9).otherwise(0.8).alias("confidence"),
        F.when(bare, F.col("_ev")).otherwise(F.col("evidence_ids")).alias("evidence_ids"), (~bare & (F.size("evidence_ids") > 0)).alias("cites"),
    ))
    limits = first.select(key, F.lit(0).alias("ord"), F.col("agent").alias("actor_id"), F.col("other").alias("target_id"), F.col("_p").alias("provenance"), F.col("_ev").alias("evidence_ids"))

    kind, place = contracts.archetype(F.col(text), places)
    bound = docs.select(key, F.col(tier).alias("tier"), kind.alias("archetype"), place.alias("map"))
    known = F.col("archetype") != "unknown"
    topology = F.coalesce(*(F.when(F.col("archetype") == a, t) for a, t in TOPOLOGY.items()), F.lit("unknown"))
    fit = F.col("archetype").isin(*TOPOLOGY)

    def field(path, value, provenance, sure, evidence=None, has=True):
        text_of = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(path.alias("path"), text_of(value).cast("string").alias("value"), text_of(provenance).alias("provenance"), text_of(sure).cast("double").alias("confidence"), (_nothing() if evidence is None else evidence).alias("evidence_ids"), F.lit(has).alias("has_value"))

    each = lambda df, *made: df.select(key, F.inline(F.array(*made)))
    at = lambda name: F.concat(F.lit("actors."), F.col("ord").cast("string"), F.lit("." + name))
    fields = _union([
        each(
            actors, field(at("vehicle_type"), F.col("label"), F.when(F.size("evidence_ids") > 0, "observed").otherwise("inferred"), 0.8, F.col("evidence_ids")),
            field(at("blueprint"), contracts.blueprint(F.col("label")), "defaulted", 0.6), field(at("lane_position"), "lane_relative", "defaulted", 0.5),
            field(at("initial_speed_mps"), F.when(F.col("role") == "ego", contracts.EGO_SPEED).otherwise(contracts.OTHER_SPEED), "defaulted", 0.4),
        ),
        each(  # the texts are read once for all three, and the archetype told once
            bound.select(key, spans.once(archetype=F.col("archetype"), map=F.col("map"))), field(F.lit("map_binding.archetype"), F.col("archetype"), F.when(known, "inferred").otherwise("unknown"), F.when(known, 0.7).otherwise(0.2)),
            field(F.lit("map_binding.map"), F.col("map"), "defaulted", 0.5), field(F.lit("topology"), topology, F.when(fit, "inferred").otherwise("unknown"), F.when(fit, 0.55).otherwise(0.0)),
        ),
        each(steps, field(F.concat(F.lit("event_sequence."), F.col("ord").cast("string"), F.lit(".description")), F.col("description"), F.col("provenance"), F.col("confidence"), F.col("evidence_ids"))),
        each(limits, field(F.lit("collision_constraints.0"), None, F.col("provenance"), 1.0, F.col("evidence_ids"), has=False)),
    ])

    fixed = _union([
        actors.where(F.size("evidence_ids") > 0).select(key, F.concat(F.lit("actors."), "actor_id", F.lit(".vehicle_type")).alias("path")),
        steps.where("cites").select(key, F.concat(F.lit("event_sequence."), F.col("ord").cast("string"), F.lit(".description")).alias("path")),
        limits.where("provenance = 'observed'").select(key, F.lit("collision_constraints.0").alias("path")),
    ])
    paths = fixed.groupBy(key).agg(F.array_sort(F.collect_set("path")).alias("immutable_paths"))
    claims = events.where("kind = 'vehicle_collision'").select(key, F.explode("evidence_ids").alias("evidence_id")).join(graph.evidence.where("legal_status = 'party_claim'").select(key, "evidence_id"), [key, "evidence_id"], "left_semi").select(key).distinct().withColumn("party_claim", F.lit(True))
    m = graph.heads.select(key, F.concat("critical_unresolved", "review_required").alias("notes")).join(bound.select(key, "tier"), key)
    m = m.join(actors.groupBy(key).agg(F.count("*").alias("actor_count")), key, "left").join(first.select(key, F.lit(True).alias("has_collision")), key, "left").join(claims, key, "left").join(paths, key, "left")
    m = m.fillna({"actor_count": 0, "has_collision": False, "party_claim": False})
    heads = contracts.status(m).select(key, "tier", "status", F.coalesce("immutable_paths", _nothing()).alias("immutable_paths"), "review_issues", F.lit(True).alias("collision_sensor"))
    return Contract(heads, actors.drop("label", "evidence_ids"), steps.select(key, "ord", "event_id", "kind", "actor_id", "target_id", "step"), limits.drop("evidence_ids"), fields)


def problems(c: Contract, key: str) -> DataFrame:
    """key, problems: what keeps each contract from being compiled, in the order of the checks."""
    ids = c.actors.groupBy(key).agg(F.count("*").alias("_n"), F.count_distinct("actor_id").alias("_d"))
    empty = F.coalesce(F.col("value"), F.lit("")) == ""
    owner = F.split_part("path", F.lit("."), F.lit(2)).try_cast("int")
    bare = c.fields.where(F.col("path").rlike("^actors[.][0-9]+[.]blueprint$") & empty).withColumn("ord", owner).join(c.actors.select(key, "ord", "actor_id"), [key, "ord"])
    bare = bare.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "actor_id"))), lambda x: F.concat(x["actor_id"], F.lit(": blueprint is missing"))).alias("_bare"))
    known = c.actors.select(key, "actor_id").distinct()
    ends = c.limits.select(key, "ord", F.explode(F.array("actor_id", "target_id")).alias("actor_id"))
    strange = ends.join(known, [key, "actor_id"], "left_anti").groupBy(key).agg(F.lit(True).alias("_strange"))
    same = c.limits.groupBy(key).agg(F.bool_or(F.col("actor_id") == F.col("target_id")).alias("_same"))
    w = Window.partitionBy(key).orderBy("ord")
    order = c.steps.select(key, (F.col("step") <= F.lag("step").over(w)).alias("_down")).groupBy(key).agg(F.bool_or(F.coalesce("_down", F.lit(False))).alias("_order"))
    maps = c.fields.where("path = 'map_binding.map'").groupBy(key).agg(F.bool_and(~empty).alias("_map"))
    m = c.heads
    for part in (ids, bare, strange, same, order, maps):
        m = m.join(part, key, "left")
    test = lambda when, name: F.when(when, F.lit(PROBLEMS[name]))
    yes = lambda c_: F.coalesce(F.col(c_), F.lit(False))
    n = F.coalesce("_n", F.lit(0))
    found = F.concat(
        F.array_compact(F.array(test(n != F.coalesce("_d", F.lit(0)), "twice"), test(n < 2, "few"))), F.coalesce("_bare", _nothing()),
        F.array_compact(F.array(
            test(yes("_strange"), "stranger"), test(yes("_same"), "same"), test(yes("_order"), "order"), test(~yes("_map"), "map"), test(~F.col("collision_sensor"), "sensor"), test(F.col("tier").startswith("C_"), "tier"),
            F.when(F.col("status").isin("blocked", REVIEW_STATUS), F.concat(F.lit("contract status is "), "status")),
        )),
    )
    return m.select(key, found.alias("problems"))


REVIEW_STATUS = "needs_review"


# -- repair --------------------------------------------------------------------------------------
def judged(c: Contract, instructions: DataFrame, key: str) -> DataFrame:
    """instructions (key, ord, path, value) with verdict: accepted, rejected (unknown, not mutable or immutable paths) or invalid (no value there)."""
    fixed = c.heads.select(key, F.explode("immutable_paths").alias("path"), F.lit(True).alias("_fixed"))
    there = c.fields.select(key, "path", F.col("provenance").alias("_p"), F.col("has_value").alias("_v"), F.col("value").alias("was"))
    m = instructions.join(there, [key, "path"], "left").join(fixed, [key, "path"], "left")
    free = F.coalesce(contracts.mutability(F.col("_p")) == contracts.MUTABLE, F.lit(False)) & F.col("_fixed").isNull()
    return m.withColumn("verdict", F.when(~free, "rejected").when(~F.coalesce("_v", F.lit(False)), "invalid").otherwise("accepted")).withColumnRenamed("_p", "provenance").drop("_v", "_fixed")


def repaired(c: Contract, instructions: DataFrame, key: str, most: int = 3) -> tuple[Contract, DataFrame]:
    """The contract after at most ``most`` accepted instructions in order, and the notes of each key that has instructions.

    A rejected or invalid instruction uses up nothing; the one after the last accepted only
    notes the limit, and later ones are not judged. A contract that has a problem after its
    repair which it did not have before is rolled back whole.
    """
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    seen = judged(c, instructions, key).withColumn("_n", F.coalesce(F.sum((F.col("verdict") == "accepted").cast("int")).over(w), F.lit(0)))
    seen = seen.withColumn("_late", F.coalesce(F.sum((F.col("_n") >= most).cast("int")).over(w), F.lit(0))).where("_late = 0")
    note = F.when(F.col("_n") >= most, LIMIT).otherwise(F.concat(F.when(F.col("verdict") == "rejected", REJECTED).when(F.col("verdict") == "invalid", INVALID).otherwise(APPLIED), F.coalesce("path", F.lit(""))))
    told = stored(seen.select(key, "ord", "path", "value", ((F.col("verdict") == "accepted") & (F.col("_n") < most)).alias("applied"), note.alias("note")))
    last = told.where("applied").groupBy(key, "path").agg(F.max_by(F.struct("value"), "ord").alias("_new"))
    new = c._replace(fields=_with(c.fields, last, key))
    touched = told.where("applied").select(key).distinct()
    own = lambda x: Contract(*(t.join(touched, key, "left_semi") for t in x))
    before = problems(own(c), key).withColumnRenamed("problems", "_before")
    worse = stored(problems(own(new), key).join(before, key).where(F.size(F.array_except("problems", "_before")) > 0).select(key))
    kept = c._replace(fields=_with(c.fields, last.join(worse, key, "left_anti"), key))
    notes = told.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "note"))), lambda x: x["note"]).alias("notes"))
    notes = notes.join(worse.withColumn("_w", F.lit(True)), key, "left").select(key, F.when(F.col("_w"), F.concat("notes", F.array(F.lit(ROLLBACK)))).otherwise(F.col("notes")).alias("notes"), F.coalesce("_w", F.lit(False)).alias("rolled_back"))
    return kept, notes


def _with(fields: DataFrame, last: DataFrame, key: str) -> DataFrame:
    """fields with new values (key, path, _new struct<value>), which count as defaulted; a new value may be null."""
    m = fields.join(last, [key, "path"], "left")
    new = F.col("_new").isNotNull()
    return m.withColumn("value", F.when(new, F.col("_new.value")).otherwise(F.col("value"))).withColumn("provenance", F.when(new, "defaulted").otherwise(F.col("provenance"))).drop("_new")


# -- judging a run -------------------------------------------------------------------------------
def guarded_report(c: Contract, reports: DataFrame, repairs: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Reports (key, passed, manual_review, failures, notes) after the guards.

    key, passed, failures, accepted, rejected, manual_review, notes. Repairs (key, ord, path,
    value) of immutable or unknown fields are taken out and noted; a constraint of results
    (key, name, passed) that fails overrides the report and is listed; a failure that names nothing goes to review.
    """
    split = judged(c, repairs, key).withColumn("_ok", F.col("verdict") != "rejected")
    parts = split.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_ok"), F.struct("ord", "path")))), lambda x: x["path"]).alias("accepted"),
        F.transform(F.array_sort(F.collect_list(F.when(~F.col("_ok"), F.struct("ord", "path")))), lambda x: F.concat(F.lit(GUARD), x["path"])).alias("_guard"),
    )
    bad = results.where("passed = false").groupBy(key).agg(F.transform(F.array_sort(F.collect_list("name")), lambda n: F.concat(F.lit("deterministic:"), n)).alias("_bad"))
    m = reports.join(parts, key, "left").join(bad, key, "left").join(c.heads.select(key, (F.size("review_issues") > 0).alias("_issues")), key, "left")
    listed = lambda name: F.coalesce(F.col(name), _nothing())
    failed, odd = F.size(listed("_bad")) > 0, F.coalesce(~F.col("passed"), F.lit(False)) & (F.size(listed("failures")) == 0)
    guard = F.concat(listed("_guard"), F.when(odd, F.array(F.lit(INCONSISTENT))).otherwise(_nothing()))
    return m.select(
        key, F.when(failed, False).otherwise(F.col("passed")).alias("passed"), F.concat(listed("failures"), listed("_bad")).alias("failures"), listed("accepted").alias("accepted"), F.size(listed("_guard")).alias("rejected"),
        (F.coalesce("manual_review", F.lit(False)) | failed | odd | (F.size(listed("failures")) > 0) | F.coalesce("_issues", F.lit(False)) | (F.size(guard) > 0)).alias("manual_review"), F.concat(listed("notes"), guard).alias("notes"),
    )


def assurance_loop(c: Contract, reports: DataFrame, repairs: DataFrame, results: DataFrame, key: str, most: int = 3) -> DataFrame:
    """How the recorded rounds of each contract end: key, status, reason, rounds, regressed, patches (path and value, empty after a regression).

    reports (key, iteration, passed, failures), repairs (key, iteration, ord, path, value) and
    results (key, iteration, name, passed) of iterations 0 to ``most``. An ordered fold whose
    state is what passed so far and what has been patched: a regression ends the loop and
    takes all patches back, then a pass ends it, a failed observed collision, the last
    iteration or one without repairs, and a repair that the guard lets change nothing. One repair a round.
    A record that stops before any of these is left open.
    """
    first = judged(c, repairs.where(F.col("iteration") <= most), key).where("verdict = 'accepted'").groupBy(key, "iteration").agg(F.min_by(F.struct("path", "value", "was", "provenance"), "ord").alias("fix"))
    asked = repairs.groupBy(key, "iteration").agg(F.lit(True).alias("asked"))
    good = results.where("passed").groupBy(key, "iteration").agg(F.collect_set("name").alias("good"))
    observed = c.limits.where("provenance = 'observed'").select(key).distinct().withColumn("observed", F.lit(True))
    m = reports.where(F.col("iteration") <= most)
    for part in (first, asked, good):
        m = m.join(part, [key, "iteration"], "left")
    m = m.join(observed, key, "left").select(
        key, "iteration", F.coalesce("passed", F.lit(False)).alias("passed"), F.coalesce(F.array_contains("failures", "collision_target") & F.col("observed"), F.lit(False)).alias("hit"),
        F.coalesce("asked", F.lit(False)).alias("asked"), F.coalesce("good", _nothing()).alias("good"), "fix",
    )
    rounds = m.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("iteration", "passed", "hit", "asked", "good", "fix"))).alias("rounds"))  # most + 1 at most
    none = F.lit(None).cast("string")
    kind = "struct<ended:string,rounds:int,before:array<string>,regressed:array<string>,patches:map<string,string>>"
    start = F.struct(none.alias("ended"), F.lit(0).alias("rounds"), _nothing().alias("before"), _nothing().alias("regressed"), F.create_map().cast("map<string,string>").alias("patches")).cast(kind)

    def step(s, r):
        lost = F.array_sort(F.array_except(s["before"], r["good"]))
        path, value = r["fix"]["path"], r["fix"]["value"]
        now = F.when(F.map_contains_key(s["patches"], path), s["patches"][path].eqNullSafe(value)).otherwise((r["fix"]["provenance"] == "defaulted") & r["fix"]["was"].eqNullSafe(value))
        idle = r["fix"].isNull() | F.coalesce(now, F.lit(False))
        end = F.when(F.size(lost) > 0, "regressed").when(r["passed"], "passed").when(r["hit"], "observed").when((r["iteration"] >= most) | ~r["asked"], "limit").when(idle, "guard")
        kept = F.map_filter(s["patches"], lambda k, _: ~k.eqNullSafe(path))
        patches = F.when(F.size(lost) > 0, F.create_map().cast("map<string,string>")).when(end.isNotNull(), s["patches"]).otherwise(F.map_concat(kept, F.create_map(F.coalesce(path, F.lit("")), value)))
        new = F.struct(end.alias("ended"), (s["rounds"] + 1).alias("rounds"), F.array_union(s["before"], r["good"]).alias("before"), lost.alias("regressed"), patches.alias("patches")).cast(kind)
        return F.when(s["ended"].isNotNull(), s).otherwise(new)

    done = rounds.select(key, F.aggregate("rounds", start, step).alias("s"))
    ended = F.col("s.ended")
    reason = F.coalesce(*(F.when(ended == k, t) for k, t in ENDINGS.items()))
    status = F.when(ended == "passed", PASSED).when(ended.isNotNull(), REVIEW).otherwise("open")
    return done.select(key, status.alias("status"), reason.alias("reason"), F.col("s.rounds").alias("rounds"), F.col("s.regressed").alias("regressed"), F.array_sort(F.map_entries("s.patches")).alias("patches"))
