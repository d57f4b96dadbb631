"""Runtime reports: summaries with nearest-rank p95, phase walls, interval filters, sweeps, agreement, acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(df: DataFrame, keys: list[str], value: str, digits: int = 6) -> DataFrame:
    """n, total, mean, stdev (sample; 0 for one row), min, p50 (interpolated), p95 (nearest rank), max."""
    v = F.col(value)
    r = lambda c, n: F.round(c, digits).alias(n)
    return df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), r(F.sum(v), "total"), r(F.avg(v), "mean"), r(F.coalesce(F.stddev_samp(v), F.lit(0.0)), "stdev"), r(F.min(v), "min"),
        r(F.percentile(v, 0.5), "p50"), r(F.expr(f"percentile_disc(0.95) within group (order by `{value}`)"), "p95"), r(F.max(v), "max"),
    )


def phase_wall(df: DataFrame, keys: list[str], start: str, finish: str) -> DataFrame:
    """n, wall_seconds (last finish - first start), throughput."""
    wall = (F.unix_micros(F.max(finish).cast("timestamp")) - F.unix_micros(F.min(start).cast("timestamp"))) / 1e6
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(wall, 6).alias("wall_seconds")).withColumn("throughput", F.round(F.when(F.col("wall_seconds") > 0, F.col("n") / F.col("wall_seconds")), 9))


def within(samples: DataFrame, at: str, intervals: DataFrame, start: str, finish: str, width: int = 3_600) -> DataFrame:
    """Samples inside any interval, which they meet by the stretch of ``width`` seconds that holds them."""
    stretch = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width)
    cut = intervals.select(F.col(start).alias("_from"), F.col(finish).alias("_to"), F.explode(F.sequence(stretch(start), stretch(finish))).alias("_stretch"))
    met = samples.withColumn("_in", stretch(at))
    return met.join(cut, (F.col("_in") == F.col("_stretch")) & (F.col(at) >= F.col("_from")) & (F.col(at) <= F.col("_to")), "left_semi").drop("_in")


def sweep(walls: DataFrame, level: str) -> DataFrame:
    """speedup against the lowest level, and parallel efficiency."""
    first = lambda c: F.first_value(c).over(Window.orderBy(level))  # noqa: E731  a row for each level
    speed = F.col("throughput") / first(F.col("throughput"))
    return walls.withColumn("speedup", F.round(speed, 6)).withColumn("efficiency", F.round(speed / (F.col(level) / first(F.col(level))), 6))


def economics(n: Column, routed: Column, rule_seconds: Column, model_seconds: Column) -> dict[str, Column]:
    """Routed rate, calls avoided, the time a model would take over all rows, and how many times longer that is."""
    every = model_seconds / routed * n
    return {"routed_percent": F.round(100 * routed / n, 3), "avoided": n - routed, "all_model_seconds": F.round(every, 3), "reduction": F.round(every / (rule_seconds + model_seconds), 3)}


def acceptance(checks: DataFrame) -> DataFrame:
    """The checks and one row more, OVERALL, true if all are."""
    return checks.unionByName(checks.agg(F.every(F.coalesce("ok", F.lit(False))).alias("ok")).select(F.lit("OVERALL").alias("check"), "ok"))


def log_pairs(lines: DataFrame, line: str) -> DataFrame:
    """key, value of key=value lines; others are left out."""
    pair = F.split(F.col(line), "=", 2)
    return lines.where(F.col(line).contains("=")).select(F.trim(pair[0]).alias("key"), F.trim(pair[1]).alias("value"))


def vmstat(lines: DataFrame, line: str) -> DataFrame:
    """busy (100 - idle) and free memory of lines with at least 17 integer columns."""
    cut = F.filter(F.split(F.trim(F.col(line)), r"\s+"), lambda x: x != "")
    whole = lines.select(cut.alias("c")).where((F.size("c") >= 17) & F.forall("c", lambda x: x.try_cast("bigint").isNotNull()))
    return whole.select((100 - F.element_at("c", 15).cast("int")).alias("busy"), F.element_at("c", 4).cast("bigint").alias("free_kb"))


def sweep_report(requests: DataFrame, level: str, status: str, seconds: str, start: str, finish: str) -> DataFrame:
    """level, requests, success, failed, wall_seconds, throughput, mean, p50, p95 (interpolated) of the successful, speedup and efficiency_percent against the lowest level."""
    ok = F.when(F.col(status) == "ok", F.col(seconds))
    wall = (F.unix_micros(F.max(finish).cast("timestamp")) - F.unix_micros(F.min(start).cast("timestamp"))) / 1e6
    got = requests.groupBy(level).agg(
        F.count("*").alias("requests"), F.count_if(F.col(status) == "ok").alias("success"), F.count_if(F.col(status) != "ok").alias("failed"), F.round(wall, 4).alias("wall_seconds"),
        F.round(F.avg(ok), 4).alias("mean"), F.round(F.percentile(ok, 0.5), 4).alias("p50"), F.round(F.percentile(ok, 0.95), 4).alias("p95"),
    )
    w = Window.orderBy(level)  # a row for each level
    speed = F.round(F.try_divide(F.first_value("wall_seconds").over(w), "wall_seconds"), 3)
    return got.withColumn("throughput", F.round(F.try_divide("requests", "wall_seconds"), 4)).withColumn("speedup", speed).withColumn("efficiency_percent", F.round(100 * F.col("speedup") / F.col(level), 1))


def gpu_samples(lines: DataFrame, line: str) -> DataFrame:
    """device, util, memory_mib, power of CSV lines with five columns or more (time, device, util, memory, power); lines that do not read are left out."""
    c = F.split(F.col(line), ",")
    number = lambda i: F.trim(F.get(c, F.lit(i))).try_cast("double")
    device = F.trim(F.get(c, F.lit(1)))
    read = lines.where(F.size(c) >= 5).select(F.when(device.rlike("^[+-]?[0-9]+$"), device.try_cast("int")).alias("device"), number(2).alias("util"), number(3).alias("memory_mib"), number(4).alias("power"))
    return read.dropna()


def gpu_totals(lines: DataFrame, line: str) -> DataFrame:
    """device, total_mib of CSV lines "device, total MiB"; a device that repeats keeps its largest total."""
    c = F.split(F.col(line), ",")
    read = lines.select(F.trim(F.get(c, F.lit(0))).try_cast("int").alias("device"), F.split_part(F.trim(F.get(c, F.lit(1))), F.lit(" "), F.lit(1)).try_cast("double").alias("total_mib")).dropna()
    return read.groupBy("device").agg(F.max("total_mib").alias("total_mib"))


def gpu_report(samples: DataFrame, totals: DataFrame) -> DataFrame:
    """n, mean, p95 and peak of util, mean and peak of the memory share of devices with a known total, mean power."""
    share = 100 * F.col("memory_mib") / F.col("total_mib")
    r = lambda c, n: F.round(c, 2).alias(n)
    return samples.join(totals, "device", "left").agg(F.count("*").alias("n"), r(F.avg("util"), "util_mean"), r(F.percentile("util", 0.95), "util_p95"), r(F.max("util"), "util_peak"), r(F.avg(share), "memory_mean"), r(F.max(share), "memory_peak"), r(F.avg("power"), "power_mean"))


def cpu_report(busy: DataFrame) -> DataFrame:
    """n, mean, p95 and peak of busy, as vmstat gives it."""
    return busy.agg(F.count("*").alias("n"), *(F.round(c, 2).alias(n) for n, c in {"mean": F.avg("busy"), "p95": F.percentile("busy", 0.95), "peak": F.max(F.col("busy").cast("double"))}.items()))
