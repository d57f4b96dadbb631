"""Assurance, fidelity and blind evaluation: eligibility, grouping sets, replay pairs, leakage, audits."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 9


def eligible(df: DataFrame) -> DataFrame:
    """Completed rows whose injection is verified; a missing verification counts as verified."""
    return df.where((F.col("execution_status") == "completed") & F.coalesce("injection_verified", F.lit(True)))


def _div(a, b):
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), DIGITS)


def summary(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Detection, repair and guard figures by each set of columns, in one pass over grouping sets; empty denominators give null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    fault, found = F.col("trial_kind") == "fault", F.coalesce("detected", F.lit(False))
    n = F.count_if
    got = eligible(df).groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        F.count("*").alias("n"), n(fault & found).alias("tp"), n(fault & ~found).alias("fn"), n(~fault & found).alias("fp"), n(~fault & ~found).alias("tn"),
        n("manual_review").alias("reviews"), n("repair_triggered").alias("triggered"), n(F.col("repair_triggered") & F.coalesce("post_repair_passed", F.lit(False))).alias("repaired"),
        n("post_repair_regression").alias("regressions"), F.round(F.avg(F.when(F.col("repair_triggered"), F.col("repair_iterations"))), DIGITS).alias("mean_iterations"),
        n("immutable_edit_attempted").alias("immutable_attempts"), n("immutable_edit_rejected").alias("immutable_rejections"), n(F.col("immutable_edit_attempted") & ~F.col("immutable_edit_rejected")).alias("unsafe_edits"),
    )
    c = F.col
    p, r = F.try_divide(c("tp").cast("double"), c("tp") + c("fp")), F.try_divide(c("tp").cast("double"), c("tp") + c("fn"))
    return got.withColumns({
        "precision": F.round(p, DIGITS), "recall": F.round(r, DIGITS), "f1": F.round(F.when(p + r > 0, 2 * p * r / (p + r)), DIGITS), "faults_missed_rate": _div(c("fn"), c("tp") + c("fn")),
        "clean_rejected_rate": _div(c("fp"), c("tn") + c("fp")), "repair_pass_rate": _div(c("repaired"), c("triggered")), "review_rate": _div(c("reviews"), c("n")),
    })


def check_rates(df: DataFrame, checks: list[str]) -> DataFrame:
    """check, passed, assessed, rate: null is not assessed."""
    long = df.select(*(F.col(c).cast("int").alias(c) for c in checks)).unpivot([], checks, "check", "ok")
    got = long.groupBy("check").agg(F.coalesce(F.sum("ok"), F.lit(0)).alias("passed"), F.count("ok").alias("assessed"))
    return got.withColumn("rate", _div(F.col("passed"), F.col("assessed")))


def replay_pairs(df: DataFrame, keys: list[str], metrics: list[str], digest: str) -> DataFrame:
    """pairs, core_equal, hash_equal: groups of exactly two; an empty hash equals nothing."""
    alike = [F.min(m).eqNullSafe(F.max(m)) & ((F.count(m) == 2) | (F.count(m) == 0)) for m in metrics]
    core = alike[0]
    for a in alike[1:]:
        core = core & a
    same = (F.count_if(F.coalesce(F.col(digest), F.lit("")) != "") == 2) & (F.count_distinct(digest) == 1)
    pairs = df.groupBy(*keys).agg(F.count("*").alias("_n"), core.alias("_core"), same.alias("_hash")).where("_n = 2")
    return pairs.agg(F.count("*").alias("pairs"), F.count_if("_core").alias("core_equal"), F.count_if("_hash").alias("hash_equal"))


def strata(df: DataFrame, fields: list[str], checks: list[str]) -> DataFrame:
    """field, value, n, all_passed_rate for each field, in one aggregation."""
    good = F.lit(True)
    for c in checks:
        good = good & F.coalesce(c, F.lit(False))
    got = df.withColumn("_good", good).groupingSets([[F.col(f)] for f in fields], *fields).agg(F.grouping_id().alias("_g"), F.count("*").alias("n"), F.count_if("_good").alias("_ok"))
    name = value = F
    for i, f in enumerate(fields):
        g = (1 << len(fields)) - 1 - (1 << (len(fields) - 1 - i))
        name, value = name.when(F.col("_g") == g, f), value.when(F.col("_g") == g, F.col(f).cast("string"))
    return got.select(name.alias("field"), value.alias("value"), "n", _div(F.col("_ok"), F.col("n")).alias("all_passed_rate"))


def trials(materialised: DataFrame, reruns: DataFrame, clean: DataFrame) -> DataFrame:
    """Trials with their rerun: binding_mismatch where the keyframe digest is not the clean one, failed constraints sorted."""
    m = materialised.join(reruns.select("trial_id", F.col("failed").alias("_f"), F.col("keyframes").alias("_k"), F.col("verified").alias("_v")), "trial_id", "left").join(clean.select("slot_id", F.col("keyframes").alias("_c")), "slot_id", "left")
    return m.select("trial_id", "slot_id", F.coalesce("_v", F.lit(False)).alias("verified"), (~F.col("_k").eqNullSafe(F.col("_c"))).alias("binding_mismatch"), F.array_sort(F.coalesce("_f", F.array().cast("array<string>"))).alias("failed"))


#: What must not show in material that is meant to be blind.
FORBIDDEN_KEYS = ["faulttype", "faultclass", "trialkind", "expecteddisposition", "oraclevalue", "oraclecontract", "oracleresult", "cleancontractsha256", "cleanresultsha256", "cleanbundlepath", "cleancounterpart", "cleanreference", "faultmanifest", "injectionreason", "injectedvalue", "groundtruth", "isfault", "expectedlabel", "deterministicfailurereason", "failurereason"]
FORBIDDEN_TEXT = {
    "map_lane_mismatch_marker": r"(?i)map[\s_-]*lane[\s_-]*mismatch[\s_-]*fault", "collision_omission_marker": r"(?i)collision[\s_-]*omission[\s_-]*fault", "pose_perturbation_marker": r"(?i)pose[\s_-]*perturbation[\s_-]*fault",
    "controlled_actor_target_marker": r"(?i)controlled\s+actor[\s_-]*target\s+fault", "controlled_event_order_marker": r"(?i)controlled\s+event[\s_-]*order\s+fault", "fault_type_field_text": r"(?i)\bfault[\s_-]*type\b",
    "trial_kind_field_text": r"(?i)\btrial[\s_-]*kind\b", "expected_disposition_field_text": r"(?i)\bexpected[\s_-]*disposition\b", "oracle_value_field_text": r"(?i)\boracle[\s_-]*value\b",
    "clean_reference_text": r"(?i)\bclean[\s_-]*(?:contract|bundle|reference|counterpart|keyframe|result|hash)", "injection_reason_text": r"(?i)\binjection[\s_-]*reason\b", "deterministic_failure_reason_text": r"(?i)\bdeterministic[\s_-]*failure[\s_-]*reason\b",
}
FORBIDDEN_PATH = r"(?i)(?:^|[/_.-])(?:fault|oracle|clean(?:bundle|contract|reference|counterpart)?|trial[\s_-]*kind|expected[\s_-]*disposition|ground[\s_-]*truth|injection)(?:$|[/_.-])"


def flattened(df: DataFrame, key: str, document: str) -> DataFrame:
    """key, path, name, value: every key and scalar of nested JSON, of any depth; text that is no JSON is one value."""

    def walk(value, path: str, name: str) -> Iterator[tuple[str, str, str | None]]:
        stack = [(value, path, name)]
        while stack:
            v, p, n = stack.pop()
            if isinstance(v, dict):
                for k, x in v.items():
                    yield f"{p}.{k}", k, None
                    stack.append((x, f"{p}.{k}", k))
            elif isinstance(v, list):
                stack += [(x, f"{p}[{i}]", n) for i, x in enumerate(v)]
            elif v is not None:
                yield p, n, str(v)

    def run(batches):
        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf[document], strict=True):
                try:
                    value = json.loads(text)
                except (TypeError, ValueError):
                    value = text
                out += [(k, p, n, v) for p, n, v in walk(value, "$", "")]
            yield pd.DataFrame(out, columns=[key, "path", "name", "value"])

    return df.select(key, document).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, path string, name string, value string")


def leakage(flat: DataFrame, key: str, patterns: dict[str, str] = FORBIDDEN_TEXT, keys: list[str] = FORBIDDEN_KEYS) -> DataFrame:
    """key, path, hit: forbidden keys (letters and digits only, lower case) and forbidden patterns in values."""
    by_key = flat.where(F.col("value").isNull() & F.regexp_replace(F.lower("name"), "[^a-z0-9]", "").isin(keys)).select(key, "path", F.lit("forbidden_key").alias("hit"))
    named = F.array_compact(F.array(*(F.when(F.col("value").rlike(p), F.lit(n)) for n, p in patterns.items())))
    return by_key.unionByName(flat.where(F.col("value").isNotNull()).select(key, "path", F.explode(named).alias("hit")))


def sanitised_actors(actors: DataFrame, scenario: str, actor: str) -> DataFrame:
    """scenario, actor, neutral id by position."""
    from pyspark.sql import Window

    return actors.select(scenario, actor, F.concat(F.lit("ACTOR_"), F.row_number().over(Window.partitionBy(scenario).orderBy(actor)).cast("string")).alias("neutral"))


def execution_audit(calls: DataFrame, expected: int) -> DataFrame:
    """seed, calls, requests, repeated, drift: duplicates of (seed, request) and distance from the expected denominator."""
    return calls.groupBy("seed").agg(F.count("*").alias("calls"), F.count_distinct("request").alias("requests")).withColumn("repeated", F.col("calls") - F.col("requests")).withColumn("drift", F.col("requests") - expected)


def fidelity_summary(df: DataFrame, status: str, checks: list[str], scenario: str, means: list[str], fallback: str) -> DataFrame:
    """One row over the completed runs: planned, completed, scenarios, passed, assessed and rate of each check, means, runs on a fallback map.

    A null check is not assessed; a mean leaves nulls out; a null or empty scenario is none.
    """
    done = F.col(status) == "completed"
    of = lambda c: F.when(done, F.col(c))
    parts = [F.count("*").alias("planned"), F.count_if(done).alias("completed"), F.count_distinct(F.nullif(of(scenario).cast("string"), F.lit(""))).alias("scenarios")]
    for c in checks:
        parts += [F.count_if(of(c)).alias(f"{c}_passed"), F.count(of(c)).alias(f"{c}_assessed")]
    got = df.agg(*parts, *(F.round(F.avg(of(c)), 6).alias(f"{c}_mean") for c in means), F.count_if(of(fallback)).alias("fallbacks"))
    return got.withColumns({f"{c}_rate": _div(F.col(f"{c}_passed"), F.col(f"{c}_assessed")) for c in checks})


def fidelity_strata(df: DataFrame, status: str, fields: list[str], checks: list[str], scenario: str, hard: str) -> DataFrame:
    """field, value, n, scenarios, full, full_rate, hard_rate of the completed runs by each field; null or empty values are "unspecified"."""
    full = F.lit(True)
    for c in checks:
        full = full & F.coalesce(c, F.lit(False))
    value = lambda f: F.coalesce(F.nullif(F.col(f).cast("string"), F.lit("")), F.lit("unspecified"))
    # counts first, by scenario: what is shuffled is a row for each value and scenario, however many runs it has
    long = df.where(F.col(status) == "completed").select(F.inline(F.array(*(F.struct(F.lit(f).alias("field"), value(f).alias("value")) for f in fields))), F.nullif(F.col(scenario).cast("string"), F.lit("")).alias("_s"), full.alias("_full"), F.col(hard).alias("_hard"))
    each = long.groupBy("field", "value", "_s").agg(F.count("*").alias("_n"), F.count_if("_full").alias("_ok"), F.count_if("_hard").alias("_h"), F.count("_hard").alias("_of"))
    got = each.groupBy("field", "value").agg(F.sum("_n").alias("n"), F.count("_s").alias("scenarios"), F.sum("_ok").alias("full"), F.sum("_h").alias("_h"), F.sum("_of").alias("_of"))
    return got.select("field", "value", "n", "scenarios", "full", _div(F.col("full"), F.col("n")).alias("full_rate"), _div(F.col("_h"), F.col("_of")).alias("hard_rate"))


def taxonomy(df: DataFrame, status: str, reason: str) -> DataFrame:
    """reason, n over the completed runs that name one."""
    return df.where((F.col(status) == "completed") & (F.coalesce(reason, F.lit("")) != "")).groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n"))


def hash_failures(calls: DataFrame, index: DataFrame) -> DataFrame:
    """Calls (seed, request_id, template_sha256, rendered_sha256) whose template or rendered request is not the approved one.

    index: request_id, approved_sha256 (as frozen), template_sha256 and rendered_sha256 (worked
    out again). A call of a request that the index lacks, or with a hash missing, fails.
    """
    known = index.select("request_id", F.col("approved_sha256").alias("approved"), F.col("template_sha256").alias("template_now"), F.col("rendered_sha256").alias("rendered_now"))
    met = calls.join(known, "request_id", "left")
    same = (F.col("template_now") == F.col("approved")) & (F.col("template_sha256") == F.col("template_now")) & (F.col("rendered_sha256") == F.col("rendered_now"))
    return met.where(~F.coalesce(same, F.lit(False))).select("seed", "request_id", "approved", "template_now", F.col("template_sha256").alias("template_recorded"), "rendered_now", F.col("rendered_sha256").alias("rendered_recorded"))


def denominator_failures(summary: DataFrame, n: int, faults: int, clean: int) -> DataFrame:
    """method, n, faults, clean of the methods that were not scored over the planned rows."""
    planned = (F.col("n") == n) & (F.col("faults") == faults) & (F.col("clean") == clean)
    return summary.where(~F.coalesce(planned, F.lit(False))).select("method", "n", "faults", "clean")


def call_audit(calls: DataFrame, index: DataFrame, summary: DataFrame, expected: int, n: int, faults: int, clean: int, hits: DataFrame) -> DataFrame:
    """One row: calls, templates, duplicates, hash_failures, leaks, denominators, preserved (calls without a verdict), retries, ok.

    calls also hold verdict and attempts; hits are leakage hits of the rendered requests.
    """
    each = calls.groupBy("seed", "request_id").agg(F.count("*").alias("_n"), F.count_if(~F.coalesce(F.col("verdict").isin("PASS", "FAIL", "MANUAL_REVIEW"), F.lit(False))).alias("_open"), F.sum(F.greatest(F.coalesce("attempts", F.lit(0)) - 1, F.lit(0))).alias("_more"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    got = each.groupBy("request_id").agg(F.sum("_n").alias("_n"), F.sum(F.col("_n") - 1).alias("_d"), F.sum("_open").alias("_open"), F.sum("_more").alias("_more"))
    got = got.agg(none(F.sum("_n")).alias("calls"), F.count("*").alias("templates"), none(F.sum("_d")).alias("duplicates"), none(F.sum("_open")).alias("preserved"), none(F.sum("_more")).alias("retries"))
    for name, found in {"hash_failures": hash_failures(calls, index), "leaks": hits, "denominators": denominator_failures(summary, n, faults, clean)}.items():
        got = got.crossJoin(found.agg(F.count("*").alias(name)))  # one row beside one row
    return got.withColumn("ok", (F.col("calls") == expected) & (F.col("duplicates") + F.col("hash_failures") + F.col("leaks") + F.col("denominators") == 0))
