"""Cascade and funnel: slices, incremental runs, stage merges, readiness, coverage, conservation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

A_TIER, B_TIER, C_TIER = "A_minimum_grounded", "B_defaults_needed", "C_reextract_or_review"


def sliced(df: DataFrame, key: str, first: int, limit: int) -> DataFrame:
    """Rows first .. first + limit - 1 in the order of key."""
    return df.orderBy(key).offset(first - 1).limit(limit)


def unseen(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key), key, "left_anti")


def resumed(tasks: DataFrame, old: DataFrame, fresh: DataFrame, key: str, value: str, domain: list[str]) -> DataFrame:
    """Every task with its old valid value, else the fresh one; origin tells which."""
    kept = old.where(F.col(value).isin(domain)).select(key, F.col(value).alias("_old"))
    new = fresh.join(kept, key, "left_anti").select(key, F.col(value).alias("_new"))
    met = tasks.select(key).join(kept, key, "left").join(new, key, "left")
    return met.select(key, F.coalesce("_old", "_new").alias(value), F.when(F.col("_old").isNotNull(), "kept").when(F.col("_new").isNotNull(), "fresh").otherwise("missing").alias("origin"))


def merged(rules: DataFrame, answers: DataFrame, key: str, label: str, answer: str, ambiguous: str = "ambiguous") -> DataFrame:
    """The rule's label unless ambiguous, then the answer's; a missing answer stays ambiguous."""
    met = rules.join(answers.select(key, F.col(answer).alias("_answer")), key, "left")
    unsure = F.col(label) == ambiguous
    return met.withColumn("final_label", F.when(unsure, F.coalesce("_answer", F.lit(ambiguous))).otherwise(F.col(label))).withColumn("stage", F.when(~unsure, "rule").when(F.col("_answer").isNotNull(), "answer").otherwise("unanswered")).drop("_answer")


def nonempty(col: Column) -> Column:
    return F.coalesce(col != "", F.lit(False))


def readiness(vehicle: Column, trajectory: Column, *road: Column) -> Column:
    grounded = nonempty(vehicle) & nonempty(trajectory)
    context = F.greatest(*(nonempty(r) for r in road)) if len(road) > 1 else nonempty(road[0])
    return F.when(grounded & context, A_TIER).when(grounded, B_TIER).otherwise(C_TIER)


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, filled, percent: one pass over df."""
    counted = df.agg(F.count("*").alias("_n"), *(F.count_if(nonempty(F.col(c).cast("string"))).alias(c) for c in columns))
    return counted.unpivot(["_n"], columns, "field", "filled").select("field", "filled", F.round(F.when(F.col("_n") > 0, 100 * F.col("filled") / F.col("_n")).otherwise(0.0), 2).alias("percent"))


def distributions(df: DataFrame, columns: list[str], missing: str = "missing") -> DataFrame:
    """measure, value, n for each column in one aggregation over grouping sets."""
    filled = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in columns))
    grouped = filled.groupingSets([[c] for c in columns], *columns).agg(F.grouping_id().alias("_g"), F.count("*").alias("n"))
    which = {c: (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i)) for i, c in enumerate(columns)}
    measure, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c, g in which.items():
        measure, value = F.when(F.col("_g") == g, c).otherwise(measure), F.when(F.col("_g") == g, F.col(c)).otherwise(value)
    return grouped.select(measure.alias("measure"), value.alias("value"), "n")


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """stage, n, percent of all; the total is summed over the counted stages, so rows are labelled once."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # a row for each stage
    return n.select(F.col(label).alias("stage"), "n", F.round(100 * F.col("n") / total, 3).alias("percent"))


def conserved(counts: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, ok from one row of counts."""
    row = counts.select(*(c.alias(n) for n, c in checks.items()))
    return row.unpivot([], list(checks), "check", "ok")


def require(checks: DataFrame) -> None:
    """Raise where a check table holds a row that is not true."""
    bad = [r[0] for r in checks.where(~F.coalesce("ok", F.lit(False))).select("check").limit(20).collect()]
    if bad:
        raise ValueError("checks failed: " + ", ".join(map(str, bad)))


#: Fields of a record's parsed part and of the rule's summary that a request carries.
PARSED_FIELDS = ["accident_trajectory", "vehicle_type", "location", "road_type", "weather_or_environment"]
RULE_FIELDS = ["label", "score", "reason", "matched_positive_keywords", "matched_negative_keywords", "matched_patterns"]


def payloads(records: DataFrame, key: str, rule: str, routed: str) -> DataFrame:
    """key, payload: one JSON request for each record whose rule label is ``routed``; a field that a record lacks is null in it.

    records: key, input_file, source_text, source_mode, parsed (a struct, or none) and the rule's struct.
    """
    kinds = {f.name: f.dataType for f in records.schema}
    parts = {f.name for f in kinds["parsed"].fields} if "parsed" in kinds else set()
    held = lambda n: F.col(n) if n in kinds else F.lit(None).cast("string")
    parsed = F.struct(*((F.col("parsed")[n] if n in parts else F.lit(None).cast("string")).alias(n) for n in PARSED_FIELDS))
    summary = F.struct(*(F.col(rule)[n].alias(n) for n in RULE_FIELDS))
    body = F.struct(*(held(n).alias(n) for n in ("input_file", "source_text", "source_mode")), parsed.alias("parsed"), summary.alias("rule_summary"))
    return records.where(F.col(rule)["label"] == routed).select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def run_report(results: DataFrame, status: str, label: str, seconds: str, labels: list[str]) -> DataFrame:
    """One row: selected, processed, skipped, success, failed, a count of each label, elapsed, mean_seconds (null if nothing was processed).

    status is ok, error or skipped; seconds of skipped rows do not count.
    """
    s = F.col(status)
    done = s.isin("ok", "error")
    spent = F.sum(F.when(done, F.col(seconds)))
    got = results.agg(
        F.count("*").alias("selected"), F.count_if(done).alias("processed"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s == "ok").alias("success"), F.count_if(s == "error").alias("failed"),
        *(F.count_if(F.col(label) == x).alias(x) for x in labels), F.round(F.coalesce(spent, F.lit(0.0)), 4).alias("elapsed"),
    )
    return got.withColumn("mean_seconds", F.round(F.try_divide("elapsed", "processed"), 4))


def routed_table(df: DataFrame, label: str, outcome: str, routed: str) -> DataFrame:
    """outcome, n, percent_of_routed, percent_of_all: where the rows that the rules left open end."""
    n = df.groupBy(label, outcome).agg(F.count("*").alias("_n"))
    # a row for each label and outcome: summed over these, so rows are labelled once
    w = Window.partitionBy(F.lit(0))
    n = n.withColumns({"_all": F.sum("_n").over(w), "_routed": F.sum(F.when(F.col(label) == routed, F.col("_n"))).over(w)})
    return n.where(F.col(label) == routed).select(F.col(outcome).alias("outcome"), F.col("_n").alias("n"), F.round(100 * F.col("_n") / F.col("_routed"), 3).alias("percent_of_routed"), F.round(100 * F.col("_n") / F.col("_all"), 3).alias("percent_of_all"))
