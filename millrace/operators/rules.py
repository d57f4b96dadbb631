"""The rule classifier: keyword and pattern hits, score, decision list, reasons. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.lexicon import KOREAN, RECORD_FIELDS, Lexicon

ACCEPT, REJECT, AMBIGUOUS = "car_to_car", "not_car_to_car", "ambiguous"
EMPTY_SCORE, MOST_MENTIONS = -5, 8
#: What reviewers read.
REASONS = {
    "empty": "분석 가능한 텍스트가 없음", "many": "차량 언급 %d회 수준으로 2대 이상 가능성이 높음", "one": "차량 언급은 있으나 1대 수준으로 보임", "none": "차량 언급이 거의 없음",
    "hits": "충돌/접촉 표현 %d개 확인", "weak": "충돌/접촉 표현이 약함", "pair": "상대 차량 또는 다중 차량 문맥 확인", "facility": "구조물 충돌 신호 존재",
    "person": "보행자/사람 충돌 신호 존재", "two_wheeler": "자전거/오토바이 등 비자동차 신호 존재", "work": "작업기계 또는 작업현장 문맥이 강함", "other": "교통사고보다는 일반 민사/상사 문맥이 강함",
}
V2V, V2PERSON, V2FACILITY, WORK = "vehicle_to_vehicle_collision_pattern", "vehicle_to_person_pattern", "vehicle_to_facility_pattern", "work_accident_pattern"


def analysis_text(*fields: Column) -> Column:
    """Non-empty fields joined, white space (Unicode's too) made single, trimmed."""
    joined = F.concat_ws("\n", *(F.nullif(f, F.lit("")) for f in fields))
    return F.trim(F.regexp_replace(joined, r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]+", " "))


def record_text(parsed: str = "parsed") -> Column:
    """The analysis text of a record: its source text, then the fields of its struct ``parsed``."""
    return analysis_text(F.col(RECORD_FIELDS[0]), *(F.col(f"{parsed}.{f}") for f in RECORD_FIELDS[1:]))


def keyword_hits(text: Column, words: tuple[str, ...]) -> Column:
    """The distinct words that occur, in list order."""
    return F.filter(F.array(*map(F.lit, words)), lambda k: F.contains(text, k))


def pattern_hits(text: Column, patterns: dict[str, str]) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()))) if patterns else F.array().cast("array<string>")


def mention_count(text: Column, words: tuple[str, ...]) -> Column:
    """Non-overlapping occurrences of each word, summed; words that overlap count again."""
    return sum(((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w) for w in words), F.lit(0)).cast("int")


def classified(df: DataFrame, text: str, lexicon: Lexicon = KOREAN) -> DataFrame:
    """df with a struct ``rule``: label, score, counts, reasons and what matched."""
    t = F.col(text)
    kept = df.columns
    # each family is scanned once; what follows only counts
    hits = F.struct(
        pattern_hits(t, lexicon.roles).alias("roles"), pattern_hits(t, lexicon.pairs).alias("pairs"), pattern_hits(t, lexicon.events).alias("events"),
        mention_count(t, lexicon.vehicle).alias("mentions"), *(keyword_hits(t, getattr(lexicon, n)).alias(n) for n in Lexicon.LISTS),
    )
    seen = df.select(*kept, F.inline(F.array(hits)))
    n = {c: F.size(c) for c in (*Lexicon.LISTS, "roles", "pairs")}
    event = {e: F.array_contains("events", e) for e in (V2V, V2PERSON, V2FACILITY, WORK)}
    empty = F.coalesce(F.col(text), F.lit("")) == ""
    work = n["machinery"] + n["work_context"]
    points = lambda e: F.when(event[e], 4).otherwise(0)
    vehicles = F.greatest(n["roles"], F.least(F.col("mentions"), F.lit(MOST_MENTIONS)))
    numbered = seen.select(*kept, *Lexicon.LISTS, "roles", "pairs", "events", vehicles.alias("_v"), work.alias("_w"), (n["facility"] + n["person"] + n["two_wheeler"] + work).alias("_neg"))
    score = (
        2 * F.col("_v") + 3 * n["collision"] + n["accident"] + 2 * n["pairs"] + points(V2V) - 3 * n["facility"] - 4 * n["person"]
        - 4 * n["two_wheeler"] - 2 * F.col("_w") - n["non_traffic"] - points(V2PERSON) - points(V2FACILITY) - points(WORK)
    )
    label = (
        F.when(empty, REJECT).when(event[V2PERSON] | (n["person"] > 0), REJECT).when(n["two_wheeler"] > 0, REJECT)
        .when(event[V2FACILITY] | (n["facility"] >= 2) | ((n["facility"] >= 1) & ~event[V2V] & (n["pairs"] == 0)), REJECT)
        .when(event[WORK] | ((n["machinery"] > 0) & (n["work_context"] > 0)), REJECT)
        .when((F.col("_v") == 0) & (n["collision"] == 0) & (n["accident"] == 0), REJECT)
        .when(event[V2V] & (F.col("_neg") == 0), ACCEPT)
        .when((F.col("_v") >= 2) & (n["collision"] >= 1) & (n["pairs"] >= 1) & (F.col("_neg") == 0), ACCEPT)
        .when((F.col("_v") >= 2) & (n["collision"] >= 1) & (F.col("_neg") == 0), AMBIGUOUS)
        .when((F.col("_v") >= 1) & ((n["collision"] >= 1) | (n["accident"] >= 1)), AMBIGUOUS).otherwise(REJECT)
    )
    why = F.array_compact(F.array(
        F.when(F.col("_v") >= 2, F.format_string(REASONS["many"], F.col("_v"))).when(F.col("_v") == 1, REASONS["one"]).otherwise(REASONS["none"]),
        F.when(n["collision"] > 0, F.format_string(REASONS["hits"], n["collision"])).otherwise(REASONS["weak"]),
        F.when(n["pairs"] > 0, REASONS["pair"]), F.when(n["facility"] > 0, REASONS["facility"]), F.when(n["person"] > 0, REASONS["person"]),
        F.when(n["two_wheeler"] > 0, REASONS["two_wheeler"]), F.when(F.col("_w") > 0, REASONS["work"]),
        F.when((n["non_traffic"] > 0) & (n["accident"] == 0) & (n["collision"] == 0) & (F.col("_v") == 0), REASONS["other"]),
    ))
    none = F.array().cast("array<string>")
    listed = lambda *cols: F.array_sort(F.array_distinct(F.concat(*cols)))
    rule = F.struct(
        label.alias("label"), F.when(empty, EMPTY_SCORE).otherwise(score).alias("score"), F.when(empty, 0).otherwise(F.col("_v")).alias("vehicle_mentions"),
        n["collision"].alias("collision_hits"), F.col("_w").alias("work_hits"), n["facility"].alias("facility_hits"),
        F.when(empty, F.array(F.lit(REASONS["empty"]))).otherwise(why).alias("reason"),
        F.when(empty, none).otherwise(listed("roles", "collision", "accident")).alias("matched_positive_keywords"),
        F.when(empty, none).otherwise(listed("facility", "person", "two_wheeler", "machinery", "work_context", "non_traffic")).alias("matched_negative_keywords"),
        F.when(empty, none).otherwise(F.concat("events", "pairs")).alias("matched_patterns"),
    )
    return numbered.select(*kept, rule.alias("rule"))
