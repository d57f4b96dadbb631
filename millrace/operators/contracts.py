"""Field tables compiled from graphs and patched under guard. Fields are long: scenario, path, value, provenance, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Maps by archetype, words that tell an archetype, model fallbacks, topologies with speeds.
ARCHETYPES = [("intersection", ("교차로", "사거리", "삼거리"), "Town05"), ("multi_lane", ("차로", "차선변경", "진로변경"), "Town04"), ("straight_road", ("직진", "도로"), "Town01")]
UNKNOWN_MAP = "Town01"
BLUEPRINTS = [("truck", ("트럭", "화물")), ("bus", ("버스",)), ("suv", ("suv", "스포티지", "쏘렌토"))]
TOPOLOGIES = ["rear_end", "intersection_crossing_turning", "lane_change_side_swipe", "head_on_centerline_intrusion"]
MUTABLE, IMMUTABLE, REVIEW = "mutable", "immutable", "review"
LATE = 10**12
#: Default speeds in metres a second, and the texts of review issues.
EGO_SPEED, OTHER_SPEED = 8.0, 3.0
ISSUES = {"claim": "collision is grounded only in a party claim", "tier": "Tier C cannot be promoted automatically", "actors": "contract requires at least two vehicle actors", "collision": "grounded collision agent/target is missing"}


def any_of(text: Column, words) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def archetype(text: Column, table=ARCHETYPES) -> tuple[Column, Column]:
    """Archetype and map of the first row of the table one of whose words occurs."""
    kind = place = F
    for name, words, town in table:
        kind, place = kind.when(any_of(text, words), name), place.when(any_of(text, words), town)
    return kind.otherwise("unknown"), place.otherwise(UNKNOWN_MAP)


def blueprint(label: Column, table=BLUEPRINTS) -> Column:
    out = F
    for name, words in table:
        out = out.when(any_of(F.lower(label), words), name)
    return out.otherwise("generic")


def first_edge(edges: DataFrame, key: str) -> DataFrame:
    """key, agent, target of the first supported collision edge in edge order."""
    return edges.where(F.col("supported")).groupBy(key).agg(F.min_by(F.struct("source", "target"), "edge_ord").alias("e")).select(key, F.col("e.source").alias("agent"), F.col("e.target").alias("other"))


def actors(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """nodes with role (ego, target, other) by the first collision edge, blueprint and default speed."""
    m = nodes.join(first_edge(edges, key), key, "left")
    role = F.when(F.col("node_id") == F.col("agent"), "ego").when(F.col("node_id") == F.col("other"), "target").otherwise("other")
    return m.select(key, "node_id", "label", role.alias("role"), blueprint(F.col("label")).alias("blueprint"), F.when(role == "ego", EGO_SPEED).otherwise(OTHER_SPEED).alias("speed_mps"))


def event_sequence(events: DataFrame, key: str) -> DataFrame:
    """events of graphs that hold a collision, numbered from 1 by (place or last, id)."""
    hit = events.groupBy(key).agg(F.bool_or(F.col("kind") == "collision").alias("_hit"))
    w = Window.partitionBy(key).orderBy(F.coalesce("source_start", F.lit(LATE)), "event_id")
    return events.join(hit.where("_hit"), key, "left_semi").withColumn("order", F.row_number().over(w))


def status(graphs: DataFrame) -> DataFrame:
    """graphs (notes, party_claim, tier, actor_count, has_collision) with review issues and status; 'ready' is never given here."""
    issues = F.array_distinct(F.concat("notes", F.array_compact(F.array(
        F.when(F.col("party_claim"), F.lit(ISSUES["claim"])), F.when(F.col("tier").startswith("C"), F.lit(ISSUES["tier"])),
        F.when(F.col("actor_count") < 2, F.lit(ISSUES["actors"])), F.when(~F.col("has_collision"), F.lit(ISSUES["collision"])),
    ))))
    return graphs.withColumn("review_issues", issues).withColumn("status", F.when(F.col("actor_count") < 2, "blocked").when(F.size("review_issues") > 0, "needs_review").otherwise("needs_defaults"))


def problems(contracts: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """key, problems: repeated actor ids, events of unknown actors, orders that do not ascend, tier C."""
    w = Window.partitionBy(key).orderBy("ord")
    steps = parts.withColumn("_down", F.col("step") <= F.lag("step").over(w))
    got = steps.groupBy(key).agg((F.count("actor") != F.count_distinct("actor")).alias("_twice"), F.bool_or(~F.col("known")).alias("_unknown"), F.bool_or(F.coalesce("_down", F.lit(False))).alias("_order"))
    m = contracts.join(got, key, "left")
    return m.select(key, F.array_compact(F.array(F.when(F.col("_twice"), F.lit("repeated actor id")), F.when(F.col("_unknown"), F.lit("unknown actor")), F.when(F.col("_order"), F.lit("event order does not ascend")), F.when(F.col("tier").startswith("C"), F.lit("tier C")))).alias("problems"))


def mutability(provenance: Column) -> Column:
    return F.when(provenance.isin("inferred", "defaulted"), MUTABLE).when(provenance == "observed", IMMUTABLE).otherwise(REVIEW)


def guarded_patch(fields: DataFrame, instructions: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Patched fields and one outcome for each instruction.

    Instructions stand in order ``ord``. Unknown paths and those that are not mutable are
    rejected; mutable paths that hold no value are invalid; neither uses up anything. At most
    ``most`` are accepted: the next instruction reaches the limit and later ones are not judged.
    """
    seen = instructions.join(fields.select("scenario", "path", F.col("provenance").alias("_p"), F.col("has_value").alias("_v")), ["scenario", "path"], "left")
    kind = F.when(F.coalesce(mutability(F.col("_p")) != MUTABLE, F.lit(True)), "rejected").when(~F.coalesce("_v", F.lit(False)), "invalid repair path").otherwise("accepted")
    w = Window.partitionBy("scenario").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    judged = seen.withColumn("_k", kind).withColumn("_n", F.coalesce(F.sum((F.col("_k") == "accepted").cast("int")).over(w), F.lit(0)))
    past = judged.withColumn("_past", (F.col("_n") >= most).cast("int"))
    late = past.withColumn("_late", F.coalesce(F.sum("_past").over(w), F.lit(0)))
    outcome = late.select("scenario", "ord", "path", "value", F.when(F.col("_past") == 0, F.col("_k")).when(F.col("_late") == 0, "limit reached").otherwise("not judged").alias("outcome"))
    last = outcome.where("outcome = 'accepted'").groupBy("scenario", "path").agg(F.max_by(F.struct("value"), "ord").alias("_new"))
    m = fields.join(last, ["scenario", "path"], "left")
    new = F.col("_new").isNotNull()  # an accepted value may be null
    patched = m.withColumn("value", F.when(new, F.col("_new.value")).otherwise(F.col("value"))).withColumn("provenance", F.when(new, "defaulted").otherwise(F.col("provenance"))).drop("_new")
    return patched, outcome


def unguarded_patch(fields: DataFrame, instructions: DataFrame, most: int = 3) -> DataFrame:
    """scenario, edits, unsafe_edits: the first instructions, whatever they touch."""
    w = Window.partitionBy("scenario").orderBy("ord")
    first = instructions.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    m = first.join(fields.select("scenario", "path", "provenance"), ["scenario", "path"], "left")
    return m.groupBy("scenario").agg(F.count("*").alias("edits"), F.count_if(F.coalesce(mutability(F.col("provenance")) != MUTABLE, F.lit(True))).alias("unsafe_edits"))


def restored(clean: DataFrame, patched: DataFrame) -> DataFrame:
    """scenario, differing, exact: whether every path has its clean value again."""
    m = clean.select("scenario", "path", F.col("value").alias("_a")).join(patched.select("scenario", "path", F.col("value").alias("_b")), ["scenario", "path"], "full_outer")
    return m.groupBy("scenario").agg(F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("differing")).withColumn("exact", F.col("differing") == 0)


def injected(fields: DataFrame, priority: dict[str, int]) -> DataFrame:
    """scenario, path, was, now: the first mutable numeric field by priority, raised by the larger of 5 and half of it."""
    rank = F.coalesce(*(F.when(F.col("path") == p, n) for p, n in priority.items()))
    free = fields.withColumn("_r", rank).where(F.col("_r").isNotNull() & (mutability(F.col("provenance")) == MUTABLE))
    first = free.groupBy("scenario").agg(F.min_by(F.struct("path", "value"), F.struct("_r", "path")).alias("f"))
    was = F.col("f.value").try_cast("double")
    return first.select("scenario", F.col("f.path").alias("path"), was.alias("was"), (was + F.greatest(F.lit(5.0), F.abs(was) * 0.5)).alias("now"))


def regressions(trace: DataFrame) -> DataFrame:
    """trace (scenario, iteration, constraint, passed) with regressed: it passed before and fails now."""
    w = Window.partitionBy("scenario", "constraint").orderBy("iteration").rowsBetween(Window.unboundedPreceding, -1)
    return trace.withColumn("regressed", F.coalesce(F.bool_or("passed").over(w), F.lit(False)) & ~F.coalesce("passed", F.lit(True)))


def terminal(trace: DataFrame, most: int) -> DataFrame:
    """scenario, iteration, outcome: the first iteration that ends a trace - regression, then pass, then observed failure, then the limit."""
    each = regressions(trace).groupBy("scenario", "iteration").agg(F.bool_or("regressed").alias("_reg"), F.every(F.coalesce("passed", F.lit(False))).alias("_all"), F.bool_or((F.col("constraint") == "collision") & ~F.coalesce("passed", F.lit(True))).alias("_hit"))
    end = F.when(F.col("_reg"), "regression").when(F.col("_all"), "passed").when(F.col("_hit"), "observed_failure").when(F.col("iteration") >= most, "limit")
    done = each.withColumn("outcome", end).where("outcome is not null")
    return done.groupBy("scenario").agg(F.min("iteration").alias("iteration"), F.min_by("outcome", "iteration").alias("outcome"))
