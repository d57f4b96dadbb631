"""Model answers as data: type-strict reading of raw text, repeat consensus, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The domains of a verdict.
ACCIDENT_TYPES = ["car_to_car", "car_to_person", "car_to_two_wheeler", "car_to_facility", "work_accident", "other_or_unknown"]
LABELS = ["car_to_car", "not_car_to_car", "ambiguous"]
CONFIDENCE = ["high", "medium", "low"]
STATUSES = ["PASS", "FAIL", "MANUAL_REVIEW"]
NO_ANSWER, LONGEST_RATIONALE = "LLM response unavailable", 600


def without_fence(raw: Column) -> Column:
    """The text inside a code fence, or the trimmed text."""
    return F.trim(F.regexp_replace(F.trim(raw), r"^```[A-Za-z]*\s*|\s*```$", ""))


def outermost_object(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))


def _field(v: Column, name: str) -> tuple[Column, Column]:
    """Type and string value of a field; a number never passes for a string."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.try_variant_get(v, f"$.{name}", "string")


def normalised(df: DataFrame, raw: str) -> DataFrame:
    """df with verdict: each field checked on its own and replaced by its fallback; no object at all is ambiguous and low."""
    v = F.col("_v")
    parsed = df.withColumn("_v", F.try_parse_json(outermost_object(F.col(raw))))
    own = lambda name, domain, fallback: F.when((_field(v, name)[0] == "STRING") & _field(v, name)[1].isin(domain), _field(v, name)[1]).otherwise(fallback)
    kind, reason = _field(v, "reason")
    flag, truth = _field(v, "is_car_to_car")
    listed = F.filter(F.transform(F.try_variant_get(v, "$.evidence", "array<string>"), lambda x: F.trim(x)), lambda x: x != "")
    verdict = F.struct(
        own("accident_type", ACCIDENT_TYPES, "other_or_unknown").alias("accident_type"),
        F.when(flag == "BOOLEAN", truth == "true").otherwise(F.lit(False)).alias("is_car_to_car"),
        own("label", LABELS, "ambiguous").alias("label"), own("confidence", CONFIDENCE, "low").alias("confidence"),
        F.when((kind == "STRING") & (F.trim(reason) != ""), F.trim(reason)).otherwise(NO_ANSWER).alias("reason"),
        F.coalesce(listed, F.array().cast("array<string>")).alias("evidence"),
    )
    return parsed.withColumn("verdict", verdict).drop("_v")


def checked(df: DataFrame, raw: str, codes: list[str]) -> DataFrame:
    """df with status (null where invalid) and error: status and code domains, unique codes, length of the rationale."""
    v = F.col("_v")
    parsed = df.withColumn("_v", F.try_parse_json(F.col(raw)))
    kind, status = _field(v, "status")
    found = F.try_variant_get(v, "$.issue_codes", "array<string>")
    told, rationale = _field(v, "rationale")
    error = (
        F.when(v.isNull(), "not an object").when(~F.coalesce((kind == "STRING") & status.isin(STATUSES), F.lit(False)), "unknown status")
        .when(found.isNull(), "issue codes are no list").when(~F.forall(found, lambda c: c.isin(codes)), "unknown issue code")
        .when(F.size(F.array_distinct(found)) != F.size(found), "repeated issue code")
        .when(~F.coalesce(told == "STRING", F.lit(False)), "no rationale").when(F.length(rationale) > LONGEST_RATIONALE, "rationale too long")
    )
    return parsed.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), status)).drop("_v")


def repeat_consensus(df: DataFrame, request: list[str], status: str, repeats: int = 3) -> DataFrame:
    """One status per request: that of all repeats where they are valid and alike, else MANUAL_REVIEW; and how they agree."""
    valid = F.count_if(F.col(status).isin(STATUSES))
    alike = F.count_distinct(F.col(status)) == 1
    whole = (F.count("*") == repeats) & (valid == repeats)
    return df.groupBy(*request).agg(
        F.when(whole & alike, F.min(status)).otherwise("MANUAL_REVIEW").alias("consensus"),
        F.when(~whole, "incomplete").when(alike, "exact").otherwise("disagreement").alias("agreement"), F.count("*").alias("answers"),
    )
