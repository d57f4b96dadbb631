"""Confusion cells once, ratios many times: selective, weighted and full-denominator metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 9


def _ratio(a: Column, b: Column, zero: str) -> Column:
    got = F.when(b != 0, a / b)
    return F.coalesce(got, F.lit(0.0)) if zero == "zero" else got


def cells(df: DataFrame, keys: list[str], truth: Column, predicted: Column, weight: Column | None = None) -> DataFrame:
    """n, covered, pending, tp, tn, fp, fn per key; truth and predicted are booleans, null predictions are abstentions."""
    one = F.lit(1).cast("long") if weight is None else weight
    add = lambda test: F.coalesce(F.sum(F.when(test, one)), F.lit(0) if weight is None else F.lit(0.0))
    return df.groupBy(*keys).agg(
        add(F.lit(True)).alias("n"), add(predicted.isNotNull()).alias("covered"), add(predicted.isNull()).alias("pending"),
        add(truth & predicted).alias("tp"), add(~truth & ~predicted).alias("tn"), add(~truth & predicted).alias("fp"), add(truth & ~predicted).alias("fn"),
    )


def ratios(df: DataFrame, zero: str = "zero") -> DataFrame:
    """cells with precision, recall, f1, mcc, coverage, risk, false_acceptance (fp of accepted) and false_negative_rate.

    zero: 'zero' gives 0.0 on an empty denominator, 'null' gives null; risk without coverage is null in both.
    """
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    n, covered = F.col("n").cast("double"), F.col("covered").cast("double")
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    made = {
        "precision": _ratio(tp, tp + fp, zero), "recall": _ratio(tp, tp + fn, zero), "f1": _ratio(2 * tp, 2 * tp + fp + fn, zero),
        "mcc": _ratio(tp * tn - fp * fn, root, zero), "coverage": _ratio(covered, n, zero), "selective_risk": _ratio(fp + fn, covered, "null"),
        "false_acceptance": _ratio(fp, tp + fp, zero), "false_negative_rate": _ratio(fn, tp + fn, zero),
    }
    return df.withColumns({k: F.round(v, DIGITS) for k, v in made.items()})


def kappa(df: DataFrame, keys: list[str], a: str, b: str, one_if_certain: bool = True) -> DataFrame:
    """n, observed, expected and kappa per key from label pairs; where chance agreement is 1: 1.0, or null unless observed is 1."""
    pairs = df.groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_n"))
    over = lambda *c: F.sum("_n").over(Window.partitionBy(*(keys or [F.lit(1)]), *c))
    full = pairs.withColumn("_all", over()).withColumn("_ra", over("_a")).withColumn("_rb", over("_b"))
    same = full.groupBy(*keys).agg(F.first("_all").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("_same"))
    left = pairs.groupBy(*keys, "_a").agg(F.sum("_n").alias("_x")).withColumnRenamed("_a", "_l")
    right = pairs.groupBy(*keys, "_b").agg(F.sum("_n").alias("_y")).withColumnRenamed("_b", "_l")
    chance = left.join(right, [*keys, "_l"]).groupBy(*keys).agg(F.sum(F.col("_x") * F.col("_y")).alias("_chance"))
    met = same.join(chance, keys, "left") if keys else same.crossJoin(chance)  # one row beside one row
    observed = F.col("_same") / F.col("n")
    expected = F.coalesce(F.col("_chance"), F.lit(0)) / (F.col("n").cast("double") * F.col("n"))
    certain = F.lit(1.0) if one_if_certain else F.when(observed == 1, 1.0)
    value = F.when(expected == 1, certain).otherwise((observed - expected) / (1 - expected))
    return met.select(*keys, "n", F.round(observed, DIGITS).alias("observed"), F.round(expected, DIGITS).alias("expected"), F.round(value, DIGITS).alias("kappa"))


def full_denominators(df: DataFrame, keys: list[str], fault: Column, status: Column) -> DataFrame:
    """Detection with reviews kept in every denominator: status is FAIL (detected), PASS or anything else (review)."""
    count = lambda t: F.count_if(t)
    fail, passed = status == "FAIL", status == "PASS"
    review = ~F.coalesce(status.isin("FAIL", "PASS"), F.lit(False))
    got = df.groupBy(*keys).agg(
        count(fault).alias("faults"), count(~fault).alias("clean"), count(fault & fail).alias("tp"), count(fault & passed).alias("fn"),
        count(~fault & passed).alias("tn"), count(~fault & fail).alias("fp"), count(review).alias("reviews"),
    )
    return got.withColumns({k: F.round(v, DIGITS) for k, v in full_ratios().items()})


def full_ratios() -> dict[str, Column]:
    """Nine ratios of the columns faults, clean, tp, fn, tn, fp and reviews; null where there is nothing to divide by."""
    recall, specific = F.try_divide("tp", "faults"), F.try_divide("tn", "clean")
    precision = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    total = F.col("faults") + F.col("clean")
    return {
        "precision": precision, "recall": recall, "specificity": specific, "balanced_accuracy": (recall + specific) / 2,
        "f1": F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)), "faults_passed_rate": F.try_divide("fn", "faults"),
        "clean_failed_rate": F.try_divide("fp", "clean"), "coverage": F.try_divide(total - F.col("reviews"), total), "review_rate": F.try_divide(F.col("reviews"), total),
    }
