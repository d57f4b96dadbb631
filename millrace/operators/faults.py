"""Controlled faults in contracts and in the records of their runs, a ledger of each, and whether a rerun shows them.

A plan row (trial_id, key, fault_type, variant, donor) changes several linked tables at once:
fields of the contract (omission, speed or pose, map or lane), or collisions, constraint
results and keyframes of the run (swapped roles, reversed events, another run's frames). Runs
are tables that share the contract's key: collisions (n, actor_id, other_actor_id), results
(name, passed, expected, observed, reason) and keyframes (pos, path). Values are strings,
lists joined by commas.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import contracts
from millrace.operators.scenarios import Contract
from millrace.sources.scratch import stored

#: Fault types, what they write, and why one cannot be made.
OMISSION, SPEED_POSE, MAP_LANE, SWAP, ORDER, FRAMES = "required_collision_omission", "speed_pose_perturbation", "map_lane_mismatch", "actor_target_swap", "event_order_violation", "mismatched_keyframes"
WRITES = {"omission": "collision_omission_fault", "pose": "pose_perturbation_fault", "map": "map_lane_mismatch_fault"}
NEXT_MAP = {"Town01": "Town05", "Town05": "Town04"}
ERRORS = {
    "omission": "no mutable causal field is available to induce collision omission", "speed": "no mutable speed field is available", "pose": "no mutable lane-position field is available", "map": "no mutable map or lane field is available",
    "number": "speed fault requires a numeric value at ", "pair": "actor-target swap requires a collision constraint", "donor": "mismatched keyframes require a donor bundle", "self": "keyframe donor must be a different scenario",
    "frames": "immutable fault materialization requires clean keyframes",
}
RUNTIME_ORDER = ["runtime_initial_state", "runtime_required_collision"]
REASONS = {"collision_target": "controlled actor-target swap fault", "event_order": "controlled event-order reversal fault"}


class Runs(NamedTuple):
    collisions: DataFrame
    results: DataFrame
    keyframes: DataFrame


class Faulty(NamedTuple):
    ledger: DataFrame
    fields: DataFrame
    collisions: DataFrame
    results: DataFrame
    keyframes: DataFrame


def targets(c: Contract, key: str) -> DataFrame:
    """key, omission, speed, pose, map: the mutable field (path, was) that each contract fault takes first, null where there is none.

    Actors of the collision come first, then the ego actor, then any, each by number; an
    omission takes lanes before speeds, a map fault the map where no lane of the collision is free.
    """
    free = c.fields.where(contracts.mutability(F.col("provenance")) == contracts.MUTABLE).select(key, "path", F.col("value").alias("was"))
    part = lambda n: F.split_part("path", F.lit("."), F.lit(n))
    own = free.where(F.col("path").rlike("^actors[.][0-9]+[.](lane_position|initial_speed_mps)$")).withColumns({"ord": part(2).try_cast("int"), "lane": part(3) == "lane_position"})
    pair = c.limits.where("ord = 0").select(key, F.col("actor_id").alias("_a"), F.col("target_id").alias("_t"))
    m = own.join(c.actors.select(key, "ord", "actor_id", "role"), [key, "ord"]).join(pair, key, "left")
    hit = F.when(F.col("actor_id") == F.col("_a"), 0).when(F.col("actor_id") == F.col("_t"), 1)
    ego = F.col("role") == "ego"
    lane, of_actor = F.col("lane"), F.when(hit.isNotNull(), hit).when(ego, 2).otherwise(3)
    late = F.when(ego, 4).otherwise(5)  # speeds of an omission: the collision's actors have no precedence
    ranks = {"omission": F.when(lane, of_actor).otherwise(late), "speed": F.when(~lane, of_actor), "pose": F.when(lane, of_actor), "map": F.when(lane & hit.isNotNull(), hit)}
    each = m.select(key, "path", "was", "ord", *(rank.alias(need) for need, rank in ranks.items()))
    towns = free.where("path = 'map_binding.map'").select(key, "path", "was", F.lit(0).alias("ord"), *(F.lit(9 if need == "map" else None).cast("int").alias(need) for need in ranks))
    took = lambda need: F.min_by(F.struct("path", "was"), F.when(F.col(need).isNotNull(), F.struct(need, "ord"))).alias(need)
    return each.unionByName(towns).groupBy(key).agg(*map(took, ranks))


def injected(c: Contract, runs: Runs, plan: DataFrame, key: str) -> Faulty:
    """The linked tables of every trial after its fault, and the ledger: path, oracle_value, injected_value, basis, error.

    Fields keep their value before the fault as ``clean``.
    A trial whose fault cannot be made has an error and no change.
    """
    kind, variant = F.col("fault_type"), F.coalesce("variant", F.lit("speed"))
    need = F.when(kind == OMISSION, "omission").when(kind == SPEED_POSE, variant).when(kind == MAP_LANE, "map")
    pair = c.limits.where("ord = 0").select(key, F.col("actor_id").alias("_a"), F.col("target_id").alias("_t"))
    order = c.steps.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "event_id"))), lambda x: x["event_id"]).alias("_events"))
    frames = runs.keyframes.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"]).alias("_frames"))
    lent = frames.withColumnsRenamed({key: "donor", "_frames": "_lent"})
    # all that a key has beside it in one join each, without another deal in between; the donor's frames come last
    m = plan.withColumn("need", need).join(targets(c, key), key, "left").join(pair, key, "left").join(order, key, "left").join(frames, key, "left").join(lent, "donor", "left")
    m = m.withColumn("_took", F.coalesce(*(F.when(F.col("need") == n, F.col(n)) for n in ("omission", "speed", "pose", "map")))).withColumns({"path": F.col("_took.path"), "was": F.col("_took.was")})
    lane, was = F.endswith("path", F.lit("lane_position")), F.col("was").try_cast("double")
    town = F.coalesce(*(F.when(F.col("was") == a, b) for a, b in NEXT_MAP.items()), F.lit("Town01"))
    of_field = (
        F.when(F.col("need") == "omission", F.when(lane, WRITES["omission"]).otherwise("0.0")).when(F.col("need") == "speed", (was + F.greatest(F.lit(5.0), F.abs(was) * 0.5)).cast("string"))
        .when(F.col("need") == "pose", WRITES["pose"]).when(F.col("need") == "map", F.when(lane, WRITES["map"]).otherwise(town))
    )
    events = F.when(F.coalesce(F.size("_events"), F.lit(0)) >= 2, F.col("_events")).otherwise(F.array(*map(F.lit, RUNTIME_ORDER)))
    ends = lambda a, b: F.concat_ws(",", a, b)
    bare = F.coalesce(F.size("_frames"), F.lit(0)) == 0
    error = (
        F.when(need.isNotNull() & F.col("path").isNull(), F.coalesce(*(F.when(F.col("need") == n, ERRORS[n]) for n in ("omission", "speed", "pose", "map"))))
        .when((F.col("need") == "speed") & was.isNull(), F.concat(F.lit(ERRORS["number"]), "path")).when((kind == SWAP) & F.col("_a").isNull(), ERRORS["pair"])
        .when((kind == FRAMES) & F.col("donor").isNull(), ERRORS["donor"]).when((kind == FRAMES) & (F.col("donor") == F.col(key)), ERRORS["self"]).when(kind.isin(SWAP, ORDER) & bare, ERRORS["frames"])
    )
    path = F.when(kind == SWAP, "collision_constraints.0").when(kind == ORDER, "event_sequence").when(kind == FRAMES, "simulation_result.keyframes").otherwise(F.col("path"))
    oracle = F.when(kind == SWAP, ends("_a", "_t")).when(kind == ORDER, F.array_join(events, ",")).when(kind == FRAMES, F.array_join(F.coalesce("_frames", F.array().cast("array<string>")), ",")).otherwise(F.col("was"))
    now = F.when(kind == SWAP, ends("_t", "_a")).when(kind == ORDER, F.array_join(F.reverse(events), ",")).when(kind == FRAMES, F.array_join(F.coalesce("_lent", F.array().cast("array<string>")), ",")).otherwise(of_field)
    basis = F.when(kind == ORDER, F.when(F.coalesce(F.size("_events"), F.lit(0)) >= 2, "grounded_contract_events").otherwise("runtime_event_order_constraint")).when(kind == SPEED_POSE, variant)
    ok = error.isNull()
    ledger = stored(m.select("trial_id", key, "fault_type", "donor", F.when(ok, path).alias("path"), F.when(ok, oracle).alias("oracle_value"), F.when(ok, now).alias("injected_value"), basis.alias("basis"), error.alias("error"), "_a", "_t"))
    done = ledger.where("error is null").select("trial_id", key, "fault_type", "donor", F.col("path").alias("_path"), "oracle_value", "injected_value", "_a", "_t")

    trial = done.select("trial_id", key, "_path", "injected_value", F.col("fault_type").isin(OMISSION, SPEED_POSE, MAP_LANE).alias("_own"))
    fields = trial.join(c.fields, key).withColumns({"clean": F.col("value"), "value": F.when(F.col("_own") & (F.col("path") == F.col("_path")), F.col("injected_value")).otherwise(F.col("value"))}).drop("_path", "injected_value", "_own", key)
    run = done.where(F.col("fault_type").isin(SWAP, ORDER, FRAMES))
    met = run.select("trial_id", key, "fault_type", "_a", "_t").join(runs.collisions, key)
    turned = (F.col("fault_type") == SWAP) & (F.array_sort(F.array("actor_id", "other_actor_id")) == F.array_sort(F.array("_a", "_t")))
    collisions = met.select("trial_id", "n", F.when(turned, F.col("other_actor_id")).otherwise(F.col("actor_id")).alias("actor_id"), F.when(turned, F.col("actor_id")).otherwise(F.col("other_actor_id")).alias("other_actor_id"))
    name = F.when(F.col("fault_type") == SWAP, "collision_target").when(F.col("fault_type") == ORDER, "event_order")
    put = run.where(F.col("fault_type") != FRAMES).select("trial_id", name.alias("name"), F.lit(False).alias("passed"), F.col("oracle_value").alias("expected"), F.col("injected_value").alias("observed"))
    put = put.withColumn("reason", F.coalesce(*(F.when(F.col("name") == n, r) for n, r in REASONS.items())))
    kept = run.select("trial_id", key, name.alias("_put")).join(runs.results, key).where("_put is null or name <> _put").select("trial_id", "name", "passed", "expected", "observed", "reason")
    source = F.when(F.col("fault_type") == FRAMES, F.col("donor")).otherwise(F.col(key))
    keyframes = run.select("trial_id", source.alias(key)).join(runs.keyframes, key).select("trial_id", "pos", "path")
    return Faulty(ledger.drop("_a", "_t"), fields, collisions, reduce(DataFrame.unionByName, [kept, put]), keyframes)


def phenotypes(ledger: DataFrame, actors: DataFrame, reruns: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """trial_id, observed, verified: whether a rerun (trial_id, actor_target_correct, lane_topology_valid) shows the contract fault of each trial.

    A changed speed shows if the actor's first state (trial_id, at, actor_id, speed) is nearer
    to the injected than to the clean value. What has no rerun or no state is null.
    """
    m = ledger.where(F.col("error").isNull() & F.col("fault_type").isin(OMISSION, SPEED_POSE, MAP_LANE)).join(reruns, "trial_id", "left")
    by_speed = (F.col("fault_type") == SPEED_POSE) & (F.col("basis") == "speed")
    first = states.groupBy("trial_id", "actor_id").agg(F.min_by("speed", "at").alias("_speed"))
    m = m.withColumn("ord", F.when(by_speed, F.split_part("path", F.lit("."), F.lit(2)).try_cast("int"))).join(actors.select(key, "ord", "actor_id"), [key, "ord"], "left").join(first, ["trial_id", "actor_id"], "left")
    near = lambda c: F.abs(F.col("_speed") - F.col(c).try_cast("double"))
    flag = F.when(F.col("fault_type") == OMISSION, F.col("actor_target_correct")).otherwise(F.col("lane_topology_valid"))
    shown = F.when(by_speed, near("injected_value") < near("oracle_value")).otherwise(~flag)
    return m.select("trial_id", "fault_type", F.when(by_speed, F.col("_speed").cast("string")).otherwise(flag.cast("string")).alias("observed"), shown.alias("verified"))
