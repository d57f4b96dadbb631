"""Time series of runs: summaries, collisions, time to collision, nearest frames, constraints. States: run, actor, frame, time, x, y, vx, vy, speed, yaw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISS_DISTANCE, STILL = 3.0, 1e-9


def finite(c: Column) -> Column:
    """c, or null where it is NaN or infinite."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)


def trajectories(states: DataFrame, digits: int = 5) -> DataFrame:
    """One row for each run and actor: samples, first and last frame and time, speeds, end points and headings.

    Speeds that are not finite count in none of the five speeds; z and yaw are told where states have them.
    """
    at = F.struct("time", "frame")
    speed = finite(F.col("speed"))
    told = F.when(speed.isNotNull(), at)
    r = lambda c, n: F.round(c, digits).alias(n)
    return states.groupBy("run", "actor").agg(
        F.count("*").alias("samples"), F.min_by("frame", at).alias("first_frame"), F.max_by("frame", at).alias("last_frame"),
        F.min_by("time", at).alias("first_time"), F.max_by("time", at).alias("last_time"),
        r(F.min_by(speed, told), "first_speed"), r(F.max_by(speed, told), "last_speed"), r(F.min(speed), "min_speed"), r(F.max(speed), "max_speed"), r(F.avg(speed), "mean_speed"),
        *(r(f(c, at), f"{end}_{c}") for c in ("x", "y", "z", "yaw") if c in states.columns for end, f in (("start", F.min_by), ("end", F.max_by))),
    )


def endpoints(states: DataFrame) -> DataFrame:
    """run, frames, actors (sorted), and the first and last state of the run."""
    at = F.struct("time", "frame", "actor")
    return states.groupBy("run").agg(F.count_distinct("frame").alias("frames"), F.array_join(F.array_sort(F.collect_set("actor")), ",").alias("actors"), F.min_by("frame", at).alias("first_frame"), F.max_by("frame", at).alias("last_frame"))


def collisions(events: DataFrame) -> DataFrame:
    """One row for each run: events, frames, unordered pairs, first and last event."""
    pair = F.concat_ws("-", F.least("actor", "other"), F.greatest("actor", "other"))
    at = F.struct("frame", "actor", "other")
    return events.groupBy("run").agg(F.count("*").alias("event_count"), F.count_distinct("frame").alias("frame_count"), F.array_join(F.array_sort(F.collect_set(pair)), ",").alias("pairs"), F.min_by(pair, at).alias("first_pair"), F.max_by(pair, at).alias("last_pair"))


def time_to_collision(a: DataFrame, b: DataFrame) -> DataFrame:
    """run, frame, ttc for frames of two actors (x, y, vx, vy); null unless they close to under the miss distance."""
    side = lambda d, p: d.select("run", "frame", *(F.col(c).alias(p + c) for c in ("x", "y", "vx", "vy")))
    m = side(a, "a").join(side(b, "b"), ["run", "frame"])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    vx, vy = F.col("bvx") - F.col("avx"), F.col("bvy") - F.col("avy")
    closing, square = -(dx * vx + dy * vy), vx * vx + vy * vy
    t = F.when((closing > 0) & (square > STILL), closing / square)
    miss = F.sqrt((dx + vx * t) * (dx + vx * t) + (dy + vy * t) * (dy + vy * t))
    return m.select("run", "frame", F.when(miss < MISS_DISTANCE, t).alias("ttc"))


def running_minimum(ttc: DataFrame) -> DataFrame:
    w = Window.partitionBy("run").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return ttc.withColumn("running_min", F.min("ttc").over(w))


def nearest_frames(frames: DataFrame, targets: DataFrame) -> DataFrame:
    """run, target, frame: the frame nearest to each target; the earlier one on a tie. Targets are a few for each run."""
    return targets.join(frames.select("run", "frame"), "run").groupBy("run", "target").agg(F.min_by("frame", F.struct(F.abs(F.col("frame") - F.col("target")), "frame")).alias("frame"))


def keyframe_targets(frames: DataFrame, hits: DataFrame, margin: int = 20) -> DataFrame:
    """run, target: around the strongest hit, or the thirds of a run without one."""
    span = frames.groupBy("run").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    hit = hits.groupBy("run").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.max_by("frame", F.struct("impulse", -F.col("frame"))).alias("peak"))
    m = span.join(hit, "run", "left")
    third = F.floor((F.col("hi") - F.col("lo")) / 3)
    want = F.when(F.col("peak").isNotNull(), F.array(F.col("first") - margin, F.col("peak"), F.col("last") + margin)).otherwise(F.array(F.col("lo"), F.col("lo") + third, F.col("lo") + 2 * third))
    return m.select("run", F.explode(F.array_distinct(want)).alias("target"))


def even_pick(frames: DataFrame) -> DataFrame:
    """run, frame: first, middle and last frame, fewer in short runs."""
    w = Window.partitionBy("run").orderBy("frame")
    n = F.count("*").over(Window.partitionBy("run"))
    placed = frames.select("run", "frame", F.row_number().over(w).alias("_r"), n.alias("_n"))
    return placed.where((F.col("_r") == 1) | (F.col("_r") == F.floor(F.col("_n") / 2) + 1) | (F.col("_r") == F.col("_n"))).select("run", "frame").distinct()


def constraint_results(states: DataFrame, hits: DataFrame, low: float, high: float) -> DataFrame:
    """run, collided, in_lane, ordered, status: the hard constraints of a run; unordered where nothing collided is null."""
    own = states.groupBy("run").agg(F.every((F.col("x") >= low) & (F.col("x") <= high)).alias("in_lane"), F.min("frame").alias("_first"))
    hit = hits.groupBy("run").agg(F.min("frame").alias("_hit"))
    m = own.join(hit, "run", "left")
    collided = F.col("_hit").isNotNull()
    ordered = F.when(collided, F.col("_hit") >= F.col("_first"))
    return m.select("run", collided.alias("collided"), "in_lane", ordered.alias("ordered"), F.when(collided & F.col("in_lane") & ordered, "passed").otherwise("failed").alias("status"))


def last_states(asks: DataFrame, states: DataFrame, width: int = 1024) -> DataFrame:
    """asks (run, actor, frame) with ``state``: the actor's last state at or before the frame, null if there is none.

    Frames are cut into stretches of ``width``: an ask meets the states of its own stretch, and
    else the end of the last stretch that has any, so no run's states meet in one task.
    """
    values = [c for c in states.columns if c not in ("run", "actor")]
    held = states.select("run", "actor", F.floor(F.col("frame") / width).alias("_s"), F.struct(*values).alias("_v"))
    each = asks.select("run", "actor", "frame").distinct().withColumn("_s", F.floor(F.col("frame") / width))
    near = each.join(held, ["run", "actor", "_s"]).where(F.col("_v.frame") <= F.col("frame")).groupBy("run", "actor", "frame").agg(F.max_by("_v", F.struct("_v.frame", "_v")).alias("_near"))
    ends = held.groupBy("run", "actor", "_s").agg(F.max_by("_v", F.struct("_v.frame", "_v")).alias("_v"))  # a row for each stretch
    ends = ends.withColumn("_until", F.lead("_s").over(Window.partitionBy("run", "actor").orderBy("_s")))
    far = each.alias("e").join(ends.alias("d"), (F.col("e.run") == F.col("d.run")) & (F.col("e.actor") == F.col("d.actor")) & (F.col("e._s") > F.col("d._s")) & (F.col("d._until").isNull() | (F.col("e._s") <= F.col("d._until"))))
    far = far.select("e.run", "e.actor", "e.frame", F.col("d._v").alias("_far"))
    met = each.drop("_s").join(near, ["run", "actor", "frame"], "left").join(far, ["run", "actor", "frame"], "left")
    return met.select("run", "actor", "frame", F.coalesce("_near", "_far").alias("state"))


def impacts(events: DataFrame, states: DataFrame, width: int = 1024) -> DataFrame:
    """run, frame, actor, other, relative_speed, own_age, other_age: speed of both last velocities against each other, and how many frames old they are."""
    sides = last_states(events.select("run", "actor", "frame").unionByName(events.select("run", F.col("other").alias("actor"), "frame")), states, width)
    m = events.select("run", "frame", "actor", "other").distinct()
    for side, of in (("a", "actor"), ("b", "other")):
        m = m.join(sides.withColumnsRenamed({"actor": of, "state": side}), ["run", of, "frame"], "left")
    speed = F.hypot(F.col("a.vx") - F.col("b.vx"), F.col("a.vy") - F.col("b.vy"))
    return m.select("run", "frame", "actor", "other", speed.alias("relative_speed"), (F.col("frame") - F.col("a.frame")).alias("own_age"), (F.col("frame") - F.col("b.frame")).alias("other_age"))


def pair_constraints(limits: DataFrame, events: DataFrame, states: DataFrame) -> DataFrame:
    """run, name, passed, expected, observed for each limit (run, actor, target): whether the pair met, in either order, and not before the run's first state.

    ``passed`` is null where nothing was recorded to judge by: a run without states, or, for the order, without a collision.
    """
    pair = lambda a, b: F.concat_ws("-", F.least(a, b), F.greatest(a, b))
    seen = events.groupBy("run", pair("actor", "other").alias("_pair")).agg(F.min("frame").alias("_hit"))
    first = states.groupBy("run").agg(F.min("frame").alias("_first"))
    any_ = events.groupBy("run").agg(F.min_by(pair("actor", "other"), F.struct("frame", pair("actor", "other"))).alias("_seen"))
    m = limits.withColumn("_pair", pair("actor", "target")).join(seen, ["run", "_pair"], "left").join(first, "run", "left").join(any_, "run", "left")
    there, hit = F.col("_first").isNotNull(), F.col("_hit").isNotNull()
    rows = F.array(
        F.struct(F.lit("collision_target").alias("name"), F.when(there, hit).alias("passed"), F.col("_pair").alias("expected"), F.coalesce(F.when(hit, F.col("_pair")), F.col("_seen")).alias("observed")),
        F.struct(F.lit("event_order").alias("name"), F.when(there & hit, F.col("_hit") >= F.col("_first")).alias("passed"), F.col("_first").cast("string").alias("expected"), F.col("_hit").cast("string").alias("observed")),
    )
    return m.select("run", "actor", "target", F.inline(rows))
