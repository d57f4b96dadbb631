"""Gold labels: normalisation, id-set guards, annotator consensus, adjudication, field agreement, status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANONICAL = ["ACCEPT", "REJECT", "UNRESOLVED"]
#: Other spellings of the three labels.
ALIASES = {
    "accept": "ACCEPT", "accepted": "ACCEPT", "car_to_car": "ACCEPT", "reject": "REJECT", "rejected": "REJECT", "not_car_to_car": "REJECT",
    "unresolved": "UNRESOLVED", "uncertain": "UNRESOLVED", "abstain": "UNRESOLVED", "abstained": "UNRESOLVED",
}


def label_of(value: Column) -> Column:
    """The canonical label; null for what is missing or unknown (see bad_labels)."""
    text = F.trim(value.cast("string"))
    known = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.when(F.upper(text).isin(CANONICAL), F.upper(text)).otherwise(F.try_element_at(known, F.lower(text)))


def bad_labels(df: DataFrame, key: str, value: str, allow_missing: bool = False) -> DataFrame:
    """Rows whose label is unknown, or missing where that is not allowed."""
    missing = F.coalesce(F.trim(F.col(value).cast("string")), F.lit("")) == ""
    bad = label_of(F.col(value)).isNull() & (~missing if allow_missing else F.lit(True))
    return df.where(bad).select(key, F.col(value).alias("label"), F.when(missing, "missing").otherwise("unsupported").alias("error"))


def same_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """missing (in right), unexpected (only in right), ok: one row."""
    met = left.select(key, F.lit(1).alias("_l")).join(right.select(key, F.lit(1).alias("_r")), key, "full_outer")
    return met.agg(F.count_if(F.col("_r").isNull()).alias("missing"), F.count_if(F.col("_l").isNull()).alias("unexpected")).withColumn("ok", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, or that are no integers: a keyed read must refuse both."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col("key").cast("string").try_cast("bigint").isNull())


def hash_conflicts(left: DataFrame, right: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys whose digests differ where both sides have one."""
    return left.select(key, F.col(digest).alias("_a")).join(right.select(key, F.col(digest).alias("_b")), key).where(F.col("_a") != F.col("_b")).select(key)


def split(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """key, a, b, gold (UNRESOLVED without consensus) and reason (null where both agree on a binary label)."""
    met = a.select(key, label_of(F.col(label)).alias("a")).join(b.select(key, label_of(F.col(label)).alias("b")), key)
    agree = (F.col("a") == F.col("b")) & (F.col("a") != "UNRESOLVED")
    reason = (
        F.when(agree, F.lit(None)).when((F.col("a") == "UNRESOLVED") & (F.col("b") == "UNRESOLVED"), "common_uncertain")
        .when((F.col("a") == "UNRESOLVED") | (F.col("b") == "UNRESOLVED"), "one_annotator_uncertain").otherwise("binary_label_disagreement")
    )
    return met.withColumn("gold", F.when(agree, F.col("a")).otherwise("UNRESOLVED")).withColumn("reason", reason)


def adjudicated(consensus: DataFrame, review: DataFrame, key: str, label: str) -> DataFrame:
    """Review labels replace the label of queued rows only; UNRESOLVED stays a legal answer."""
    answers = review.select(key, label_of(F.col(label)).alias("_answer"))
    met = consensus.join(answers, key, "left")
    queued = F.col("reason").isNotNull()
    return met.withColumn("final", F.when(queued, F.coalesce("_answer", F.lit("UNRESOLVED"))).otherwise(F.col("gold"))).withColumn("source", F.when(~queued, "consensus").when(F.col("_answer").isNotNull(), "review").otherwise("open")).drop("_answer")


def field_agreement(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, disagreements (names), agreed: null-safe comparison of each field."""
    met = a.select(key, *(F.col(f).alias(f"a_{f}") for f in fields)).join(b.select(key, *(F.col(f).alias(f"b_{f}") for f in fields)), key)
    apart = F.array_compact(F.array(*(F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields)))
    return met.select(key, apart.alias("disagreements"), *(F.when(F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.col(f"a_{f}")).alias(f) for f in fields)).withColumn("agreed", F.size("disagreements") == 0)


def status(roles: DataFrame, role: str, label: str) -> DataFrame:
    """role, n, one column for each label, missing, complete."""
    counts = [F.count_if(label_of(F.col(label)) == c).alias(c.lower()) for c in CANONICAL]
    got = roles.groupBy(role).agg(F.count("*").alias("n"), *counts)
    done = reduce(lambda x, y: x + y, [F.col(c.lower()) for c in CANONICAL])
    return got.withColumn("missing", F.col("n") - done).withColumn("complete", F.col("missing") == 0)


def forced(predictions: DataFrame, method: str, label: str, of: str, name: str) -> DataFrame:
    """predictions and one more method: abstentions of ``of`` become REJECT."""
    more = predictions.where(F.col(method) == of).withColumn(method, F.lit(name)).withColumn(label, F.coalesce(F.col(label), F.lit("REJECT")))
    return predictions.unionByName(more)


def quotes_align(predicted: Column, human: Column) -> Column:
    """Whether any predicted quote holds or is held by any human quote."""
    return F.exists(predicted, lambda x: F.exists(human, lambda y: (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))))


def record_digest(*columns: str) -> Column:
    """sha256 of the columns by name, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def table_digest(df: DataFrame, digest: str) -> DataFrame:
    """n and one digest of all rows, whatever their order: digests of 256 buckets, then of the buckets."""
    rows = df.select(F.col(digest).alias("_h"))
    buckets = rows.groupBy(F.substring("_h", 1, 2).alias("_b")).agg(F.count("*").alias("_n"), F.sum(F.conv(F.substring("_h", 3, 14), 16, 10).cast("decimal(20,0)")).alias("_s"), F.bit_xor(F.conv(F.substring("_h", 20, 15), 16, 10).cast("bigint")).alias("_x"))
    shown = F.concat_ws(":", "_b", F.col("_n").cast("string"), F.col("_s").cast("string"), F.col("_x").cast("string"))
    return buckets.agg(F.sum("_n").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(shown)), ","), 256).alias("digest"))  # at most 256 buckets


def chain_breaks(df: DataFrame, chain: str, seq: str, payload: str, previous: str, own: str) -> DataFrame:
    """chain, events, first_break (null if none): every link is checked beside its predecessor."""
    from pyspark.sql import Window

    w = Window.partitionBy(chain).orderBy(seq)
    linked = F.col(previous).eqNullSafe(F.lag(own).over(w))
    right = F.col(own) == F.sha2(F.concat_ws("|", F.coalesce(F.col(previous), F.lit("")), F.col(payload)), 256)
    seen = df.select(chain, seq, (linked & F.coalesce(right, F.lit(False))).alias("_ok"))
    return seen.groupBy(chain).agg(F.count("*").alias("events"), F.min(F.when(~F.col("_ok"), F.col(seq))).alias("first_break"))


def role_status(tasks: DataFrame, labels: DataFrame, key: str, role: str, label: str) -> DataFrame:
    """role, n, same_ids, binary, uncertain, missing: what each role has labelled, and whether exactly the tasks.

    A label that is no binary one and no abstention counts as missing. Repeated ids count once
    for same_ids; without tasks only a role without rows could match, and it has no row here.
    """
    ids = tasks.select(key).distinct()
    met = labels.select(role, key, label_of(F.col(label)).alias("_l")).join(ids.withColumn("_task", F.lit(True)), key, "left")
    kind = F.coalesce("_l", F.lit("missing"))
    each = met.groupBy(role, key).agg(F.count("*").alias("_n"), F.bool_or("_task").alias("_task"), *(F.count_if(t).alias(n) for n, t in {"_b": kind.isin("ACCEPT", "REJECT"), "_u": kind == "UNRESOLVED", "_m": kind == "missing"}.items()))
    got = each.groupBy(role).agg(F.sum("_n").alias("n"), F.count("_task").alias("_in"), F.count_if(F.col("_task").isNull()).alias("_out"), F.sum("_b").alias("binary"), F.sum("_u").alias("uncertain"), F.sum("_m").alias("missing"))
    total = ids.agg(F.count("*").alias("_tasks"))
    return got.crossJoin(total).select(role, "n", ((F.col("_out") == 0) & (F.col("_in") == F.col("_tasks"))).alias("same_ids"), "binary", "uncertain", "missing", (F.col("binary") == F.col("_tasks")).alias("ready"))  # one row beside a few


def overlap(tasks: DataFrame, labels: DataFrame, key: str, role: str, label: str, a: str, b: str) -> DataFrame:
    """tasks, overlap, overlap_rate, disagreements, kappa over the tasks that both roles gave a binary label; kappa is null without any, 1 where chance agreement is."""
    value = label_of(F.col(label))
    one = lambda who: F.max(F.when((F.col(role) == who) & value.isin("ACCEPT", "REJECT"), value == "ACCEPT"))
    each = tasks.select(key).distinct().join(labels.select(key, role, label), key, "left").groupBy(key).agg(one(a).alias("_a"), one(b).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    got = each.agg(F.count("*").alias("tasks"), F.count_if(both).alias("overlap"), F.count_if(both & (F.col("_a") != F.col("_b"))).alias("disagreements"), F.count_if(both & F.col("_a")).alias("_x"), F.count_if(both & F.col("_b")).alias("_y"))
    n = F.nullif("overlap", F.lit(0)).cast("double")
    observed, left, right = 1 - F.col("disagreements") / n, F.col("_x") / n, F.col("_y") / n
    chance = left * right + (1 - left) * (1 - right)
    kappa = F.when(chance == 1, 1.0).otherwise((observed - chance) / (1 - chance))
    return got.select("tasks", "overlap", F.round(F.coalesce(F.try_divide("overlap", "tasks"), F.lit(0.0)), 9).alias("overlap_rate"), "disagreements", F.round(kappa, 9).alias("kappa"))


def withheld(metrics: DataFrame, labels: DataFrame, label: str, allowed: list[str] = CANONICAL[:2]) -> DataFrame:
    """metrics with incomplete, the labels outside ``allowed``; while there are any, every metric (a double) is null."""
    open_rows = labels.agg(F.count_if(~F.coalesce(label_of(F.col(label)).isin(allowed), F.lit(False))).alias("incomplete"))
    numbers = {f.name for f in metrics.schema if f.dataType.typeName() == "double"}
    return metrics.crossJoin(open_rows).select(*(F.when(F.col("incomplete") == 0, F.col(c)).alias(c) if c in numbers else c for c in metrics.columns), "incomplete")  # one row beside a few
