"""Blind material of contracts: allow-listed views with neutral actor ids, and the evidence budgets of eight methods with their invariants.

A view is long: a row for each section, place and field. Nothing passes that is not listed
here by section and field, so a new field of a contract stays hidden until it is allowed.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import contracts
from millrace.operators.assurance import FORBIDDEN_TEXT
from millrace.operators.scenarios import Contract

#: Lane references that may be seen, what stands for others, and methods with their codes.
LANES = ["lane_relative", "same_lane", "adjacent_lane", "left_lane", "right_lane", "centerline", "intersection_approach"]
HIDDEN = "unrecognized_reference"
METHODS = {
    "text_only_contract": "M00", "image_only_vlm": "M01", "telemetry_only": "M02", "telemetry_plus_image": "M03", "image_shuffled": "M04", "telemetry_shuffled": "M05", "no_image_fusion_prompt": "M06", "guarded_blind_loop": "M07",
}
VIOLATIONS = {
    "methods": "method set mismatch", "union": "fusion evidence is not the exact image/text plus telemetry union", "fusion_images": "fusion and image-only image budgets differ",
    "shuffled_image": "image-shuffled textual budget differs from image-only", "shuffled_telemetry": "telemetry-shuffled field budget differs from telemetry-only",
    "no_image": "no-image control is not fusion evidence with images removed", "guard_more": "guarded budget adds information beyond mutability classes", "guard_delta": "guarded budget must add exactly mutability_classes",
    "guard_images": "guarded and fusion image budgets differ",
}
ACTOR_FIELDS = ["vehicle_type", "blueprint", "lane_position", "initial_speed_mps"]
VISUAL_FIELDS = ["actor_id", "role", "vehicle_type", "lane_position"]


class Views(NamedTuple):
    rows: DataFrame
    mutability: DataFrame
    actors: DataFrame


def safe(value: Column, lane: bool = False) -> Column:
    """value, or HIDDEN where it holds a forbidden pattern or, as a lane, is no reference on the list."""
    marked = reduce(lambda a, b: a | b, [value.rlike(p) for p in FORBIDDEN_TEXT.values()])
    return F.when(marked | (~value.isin(*LANES) if lane else F.lit(False)), HIDDEN).otherwise(value)


def sanitised(c: Contract, key: str) -> Views:
    """rows (section, ord, field, value), mutability (field, class) and actors (actor_id, neutral) of every contract."""
    neutral = c.actors.select(key, "ord", "actor_id", "role", F.format_string("actor_%02d", F.col("ord") + 1).alias("neutral"))
    row = lambda df, section, n, field, value: df.select(key, F.lit(section).alias("section"), n.cast("int").alias("ord"), field.alias("field"), value.cast("string").alias("value"))
    part = lambda n: F.split_part("path", F.lit("."), F.lit(n))
    own = c.fields.where(F.col("path").rlike(rf"^actors[.][0-9]+[.]({'|'.join(ACTOR_FIELDS)})$")).withColumns({"ord": part(2).try_cast("int"), "field": part(3)}).join(neutral.select(key, "ord", "neutral"), [key, "ord"])
    seen = F.when(F.col("field") == "lane_position", safe(F.col("value"), lane=True)).otherwise(safe(F.col("value")))
    names = {"map_binding.archetype": "map.archetype", "map_binding.map": "map.runtime_map", "topology": "topology"}
    of_map = F.coalesce(*(F.when(F.col("path") == a, b) for a, b in names.items()))
    bound = c.fields.where(F.col("path").isin(*names)).withColumn("field", of_map)
    order = Window.partitionBy(key).orderBy("step", "ord")
    ends = lambda df, name: df.join(neutral.select(key, F.col("actor_id").alias(name), F.col("neutral").alias(f"_{name}")), [key, name], "left")
    steps = ends(ends(c.steps.withColumn("n", F.row_number().over(order)), "actor_id"), "target_id")
    event = F.format_string("event_%02d", "n")
    limits = ends(ends(c.limits, "actor_id"), "target_id")
    each = lambda df, section, n, values: df.select(key, F.lit(section).alias("section"), n.cast("int").alias("ord"), F.inline(F.array(*(F.struct(F.lit(f).alias("field"), v.cast("string").alias("value")) for f, v in values.items()))))
    rows = reduce(DataFrame.unionByName, [
        each(neutral, "actors", F.col("ord"), {"actor_id": F.col("neutral"), "role": safe(F.col("role"))}), row(own, "actors", F.col("ord"), F.col("field"), seen),
        row(bound, "map", F.lit(0), F.col("field"), safe(F.col("value"))),
        each(steps, "events", F.col("n"), {"event_id": event, "order": F.col("step"), "kind": safe(F.col("kind")), "actor_id": F.col("_actor_id"), "target_id": F.col("_target_id")}),
        each(limits, "collision_constraints", F.col("ord"), {"actor_id": F.col("_actor_id"), "target_id": F.col("_target_id"), "required": F.lit(True)}),
    ])
    kind = contracts.mutability(F.col("provenance")).alias("class")
    told = c.fields.where(F.col("path").rlike(r"^event_sequence[.][0-9]+[.]description$")).withColumn("ord", part(2).try_cast("int")).join(steps.select(key, "ord", "n"), [key, "ord"])
    fixed = c.limits.groupBy(key).agg(F.every(F.col("provenance") == "observed").alias("_all"))
    mutability = reduce(DataFrame.unionByName, [
        own.select(key, F.concat_ws(".", F.lit("actors"), "neutral", "field").alias("field"), kind), bound.select(key, "field", kind), told.select(key, F.concat(F.lit("events."), event).alias("field"), kind),
        fixed.select(key, F.lit("collision_constraints").alias("field"), F.when(F.col("_all"), contracts.IMMUTABLE).otherwise(contracts.REVIEW).alias("class")),
    ])
    return Views(rows, mutability, neutral.select(key, "actor_id", "neutral"))


def evidence(views: Views, key: str) -> DataFrame:
    """key and the digests of what a method may be shown: contract, visual_expectations, expected_constraints, mutability_classes."""
    r = views.rows
    shown = F.concat_ws("\u0001", "section", F.col("ord").cast("string"), "field", F.coalesce("value", F.lit("\u0002")))
    digest = lambda when: F.sha2(F.array_join(F.array_sort(F.collect_list(F.when(when, shown))), "\n"), 256)
    topology, limits, events = F.col("field") == "topology", F.col("section") == "collision_constraints", F.col("section") == "events"
    visual = topology | limits | ((F.col("section") == "actors") & F.col("field").isin(*VISUAL_FIELDS))
    got = r.groupBy(key).agg(digest(F.lit(True)).alias("contract"), digest(visual).alias("visual_expectations"), digest(topology | limits | events).alias("expected_constraints"))
    classes = views.mutability.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\u0001", "field", "class"))), "\n"), 256).alias("mutability_classes"))
    return got.join(classes, key, "left")


def payloads(shown: DataFrame, telemetry: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """key, method, code, evidence (a map of what is shown), images: eight rows a contract.

    shown is the result of evidence(); telemetry (key, summary, shuffled) and images (key,
    own, shuffled_images) carry a donor's material beside the contract's own.
    """
    m = shown.join(telemetry, key, "left").join(images, key, "left")
    held = lambda **of: F.create_map(*(x for k, c in of.items() for x in (F.lit(k), F.col(c))))
    visual, facts = {"visual_expectations": "visual_expectations"}, {"expected_constraints": "expected_constraints", "telemetry_summary": "summary"}
    none = F.array().cast("array<string>")
    own, other = F.coalesce("own", none), F.coalesce("shuffled_images", none)
    budget = {
        "text_only_contract": (held(contract="contract"), none), "image_only_vlm": (held(**visual), own), "telemetry_only": (held(**facts), none), "telemetry_plus_image": (held(**visual, **facts), own),
        "image_shuffled": (held(**visual), other), "telemetry_shuffled": (held(**facts | {"telemetry_summary": "shuffled"}), none), "no_image_fusion_prompt": (held(**visual, **facts), none),
        "guarded_blind_loop": (held(**visual, **facts, mutability_classes="mutability_classes"), own),
    }
    rows = F.array(*(F.struct(F.lit(n).alias("method"), F.lit(METHODS[n]).alias("code"), e.alias("evidence"), i.alias("images")) for n, (e, i) in budget.items()))
    return m.select(key, F.inline(rows))


def violations(given: DataFrame, key: str) -> DataFrame:
    """key, violations: the invariants between the methods' payloads that do not hold, in their order."""
    by = given.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("method", F.struct("evidence", "images")))).alias("m"), F.count("*").alias("n"))
    seen = lambda name: F.array_sort(F.map_entries(F.col("m")[name]["evidence"]))
    keys = lambda name: F.array_sort(F.map_keys(F.col("m")[name]["evidence"]))
    images = lambda name: F.col("m")[name]["images"]
    apart = lambda a, b: ~a.eqNullSafe(b)
    image, facts, fusion, guarded, bare = "image_only_vlm", "telemetry_only", "telemetry_plus_image", "guarded_blind_loop", "no_image_fusion_prompt"
    both = F.array_sort(F.array_union(seen(image), seen(facts)))
    rest = F.filter(seen(guarded), lambda e: e["key"] != "mutability_classes")
    checks = {
        "methods": (F.col("n") != len(METHODS)) | apart(F.array_sort(F.map_keys("m")), F.array(*map(F.lit, sorted(METHODS)))),
        "union": apart(seen(fusion), both), "fusion_images": apart(images(fusion), images(image)), "shuffled_image": apart(seen("image_shuffled"), seen(image)), "shuffled_telemetry": apart(keys("telemetry_shuffled"), keys(facts)),
        "no_image": apart(seen(bare), seen(fusion)) | (F.coalesce(F.size(images(bare)), F.lit(0)) > 0), "guard_more": apart(rest, seen(fusion)),
        "guard_delta": apart(F.array_except(keys(guarded), keys(fusion)), F.array(F.lit("mutability_classes"))), "guard_images": apart(images(guarded), images(fusion)),
    }
    return by.select(key, F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(True)), F.lit(VIOLATIONS[n])) for n, t in checks.items()))).alias("violations"))


def shapes(given: DataFrame, key: str) -> DataFrame:
    """key, code, evidence_keys, image_count, evidence_bytes of each payload."""
    size = F.aggregate(F.map_entries("evidence"), F.lit(0), lambda n, e: n + F.octet_length(e["key"]) + F.coalesce(F.octet_length(e["value"]), F.lit(0)))
    return given.select(key, "code", F.array_sort(F.map_keys("evidence")).alias("evidence_keys"), F.size("images").alias("image_count"), size.alias("evidence_bytes"))
