"""Experiment designs: balance checks, schedules, fault plans, grids, readiness, replicate plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import folder

#: Faults with class, disposition and layer; methods compared.
FAULTS = [
    ("actor_target_swap", "immutable", "manual_review", "telemetry"), ("required_collision_omission", "mutable", "repair", "contract_then_rerun"),
    ("event_order_violation", "immutable", "manual_review", "telemetry"), ("speed_pose_perturbation", "mutable", "repair", "contract_then_rerun"),
    ("map_lane_mismatch", "mutable", "repair", "contract_then_rerun"), ("mismatched_keyframes", "immutable", "manual_review", "keyframe_binding"),
]
METHODS = ["deterministic_telemetry_only", "image_only_vlm", "telemetry_plus_vlm_no_repair", "guarded_bounded_repair", "unconstrained_self_refinement"]


@dataclass(frozen=True)
class Design:
    """What a balanced design must hold, and how seeds follow."""

    slots: int = 24
    per_topology: int = 6
    per_route: int = 12
    per_cell: int = 3
    base_seed: int = 100
    seeds: int = 2
    repeats: int = 2


def balance(cases: DataFrame, design: Design = Design()) -> DataFrame:
    """check, ok: every count of the cube of topology and route, and unique ids."""
    cube = cases.cube("topology", "route").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    want = {3: design.slots, 1: design.per_topology, 2: design.per_route, 0: design.per_cell}
    right = F.coalesce(*(F.when(F.col("g") == g, F.col("n") == n) for g, n in want.items()))
    name = F.concat_ws("/", F.coalesce("topology", F.lit("*")), F.coalesce("route", F.lit("*")))
    unique = cases.agg((F.count("slot_id") == F.count_distinct("slot_id")).alias("ok")).select(F.lit("unique slots").alias("check"), "ok")
    return cube.select(name.alias("check"), right.alias("ok")).unionByName(unique)


def numbered(df: DataFrame, key: str, name: str = "case_no") -> DataFrame:
    """df with a number from 0 in the order of key: rows are cut by ranges of it, numbered there, and each range begins after those before it."""
    spark = df.sparkSession
    path = folder(spark, "numbered")  # written, as ranges are sampled anew whenever they are worked out
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    cut = spark.read.parquet(path)
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_size"))  # a row for each range
    begins = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_begin"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return cut.withColumn("_place", within).join(F.broadcast(begins), "_part").withColumn(name, F.col("_begin") + F.col("_place")).drop("_part", "_place", "_begin")


def schedule(cases: DataFrame, design: Design = Design()) -> DataFrame:
    """run_id, slot_id, seed, repeat_index: case x seeds x repeats, seed = base + 10 * case + k."""
    spark = cases.sparkSession
    grid = spark.range(design.seeds).withColumnRenamed("id", "k").crossJoin(spark.range(1, design.repeats + 1).withColumnRenamed("id", "repeat_index"))  # seeds * repeats rows
    seed = F.lit(design.base_seed) + 10 * F.col("case_no") + F.col("k")
    return numbered(cases, "slot_id").crossJoin(F.broadcast(grid)).select(
        F.format_string("%s_s%d_r%d", F.col("slot_id"), seed, F.col("repeat_index")).alias("run_id"), "slot_id", seed.alias("seed"), F.col("repeat_index").cast("int").alias("repeat_index")
    )


def fault_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *f) for i, f in enumerate(FAULTS)], "fault_no int, fault_type string, fault_class string, disposition string, layer string")


def fault_plan(cases: DataFrame) -> DataFrame:
    """One control and six faults for each case; variants alternate, the donor is the next case and wraps."""
    placed = numbered(cases, "slot_id")
    count = placed.count()
    giver = placed.select(F.pmod(F.col("case_no") - 1, F.lit(max(count, 1))).alias("case_no"), F.col("slot_id").alias("_next"))
    ring = placed.join(giver, "case_no")
    control = ring.select("slot_id", "case_no", F.lit(-1).alias("fault_no"), F.lit("control").alias("trial_kind"), F.lit(None).cast("string").alias("fault_type"), F.lit(None).cast("string").alias("fault_class"), F.lit("accept").alias("disposition"), F.lit(None).cast("string").alias("donor"), F.lit(None).cast("int").alias("variant"))
    faults = ring.crossJoin(F.broadcast(fault_dim(cases.sparkSession))).select(  # six rows
        "slot_id", "case_no", "fault_no", F.lit("fault").alias("trial_kind"), "fault_type", "fault_class", "disposition",
        F.when(F.col("fault_type") == "mismatched_keyframes", F.col("_next")).alias("donor"), ((F.col("case_no") + F.col("fault_no")) % 2).cast("int").alias("variant"),
    )
    return control.unionByName(faults).withColumn("trial_id", F.concat_ws("__", "slot_id", F.coalesce("fault_type", F.lit("control"))))


def evaluation_grid(trials: DataFrame) -> DataFrame:
    methods = trials.sparkSession.createDataFrame([(m,) for m in METHODS], "method string")
    return trials.select("trial_id", "trial_kind", "fault_class").crossJoin(F.broadcast(methods))  # five rows


def blockers(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """df with blockers (names of checks that hold against a row) and ready."""
    found = F.array_distinct(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items()))))
    return df.withColumn("blockers", found).withColumn("ready", F.size("blockers") == 0)


def replicate_plan(scenarios: DataFrame, key: str, total: int, workers: int) -> DataFrame:
    """``total`` runs over the scenarios, the remainder to the first ones, dealt to workers in turn."""
    n = max(scenarios.count(), 1)
    more = F.when(F.col("_no") < total % n, 1).otherwise(0)
    each = numbered(scenarios.select(key), key, "_no").withColumn("_k", (F.lit(total // n) + more).cast("int"))
    runs = each.where("_k > 0").select(key, "_no", F.explode(F.sequence(F.lit(1), F.col("_k"))).alias("replicate"))
    # in the order of (replicate, key): all scenarios have the replicates before
    return runs.select(key, "replicate", F.pmod((F.col("replicate") - 1) * n + F.col("_no"), F.lit(workers)).cast("int").alias("worker"))
