"""Queries of telemetry and runtime reports; events play states and requests (user: run, event type: actor, event id: frame)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import metrics, runtime, telemetry
from millrace.plans.base import read, registry

query, QUERIES, SQL = registry()

STATES_SQL = """with s as (select user_id as run, event_type as actor, event_id as frame, ts as time, value as speed, sin(event_id) * 50 as x, cast(event_id % 37 as double) as y, cast(event_id % 11 - 5 as double) as vx, cast(event_id % 7 - 3 as double) as vy from events),
h as (select user_id as run, event_id as frame, event_type as actor, case event_type when 'error' then 'click' else 'error' end as other, value as impulse from events where event_type in ('error', 'click'))
"""


def states(spark, sf):
    e = F.col("event_id")
    return read(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.col("event_type").alias("actor"), e.alias("frame"), F.col("ts").alias("time"), F.col("value").alias("speed"), (F.sin(e) * 50).alias("x"),
        (e % 37).cast("double").alias("y"), (e % 11 - 5).cast("double").alias("vx"), (e % 7 - 3).cast("double").alias("vy"),
    )


def hits(spark, sf):
    e = read(spark, sf, "events").where("event_type in ('error', 'click')")
    return e.select(F.col("user_id").alias("run"), F.col("event_id").alias("frame"), F.col("event_type").alias("actor"), F.when(F.col("event_type") == "error", "click").otherwise("error").alias("other"), F.col("value").alias("impulse"))


@query("trajectory_summary", STATES_SQL + """, t as (select * replace (case when frame % 13 = 0 then 'nan'::double when frame % 17 = 0 then 'inf'::double else speed end as speed), cast(frame % 360 as double) as yaw, case when frame % 13 > 0 and frame % 17 > 0 then speed end as ok from s)
 select run, actor, count(*) as samples, arg_min(frame, (time, frame)) as first_frame, arg_max(frame, (time, frame)) as last_frame, epoch_us(min(time)) as first_time, epoch_us(max(time)) as last_time, round(arg_min(ok, (time, frame)) filter (where ok is not null), 5) as first_speed, round(arg_max(ok, (time, frame)) filter (where ok is not null), 5) as last_speed,
 round(min(ok), 5) as min_speed, round(max(ok), 5) as max_speed, round(round(avg(ok), 5) + 1e-7, 3) as mean_speed, round(arg_min(x, (time, frame)), 5) as start_x, round(arg_max(x, (time, frame)), 5) as end_x, arg_min(y, (time, frame)) as start_y, arg_max(y, (time, frame)) as end_y, arg_min(yaw, (time, frame)) as start_yaw, arg_max(yaw, (time, frame)) as end_yaw from t group by run, actor""")
def trajectory_summary(spark, sf):
    """Trajectories of states some of whose speeds are no numbers."""
    n = F.col("frame")
    s = states(spark, sf).withColumn("yaw", (n % 360).cast("double")).withColumn("speed", F.when(n % 13 == 0, float("nan")).when(n % 17 == 0, float("inf")).otherwise(F.col("speed")))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    # means of a few cents end halfway between two thousandths, which engines round either way
    return telemetry.trajectories(s).withColumn("mean_speed", F.round(F.col("mean_speed") + 1e-7, 3)).withColumns({c: micros(c) for c in ("first_time", "last_time")})


@query("run_endpoints", STATES_SQL + "select run, count(distinct frame) as frames, array_to_string(list_sort(list(distinct actor)), ',') as actors, arg_min(frame, (time, frame, actor)) as first_frame, arg_max(frame, (time, frame, actor)) as last_frame from s group by run")
def run_endpoints(spark, sf):
    return telemetry.endpoints(states(spark, sf))


@query("collision_compaction", STATES_SQL + "select run, count(*) as event_count, count(distinct frame) as frame_count, array_to_string(list_sort(list(distinct least(actor, other) || '-' || greatest(actor, other))), ',') as pairs, 'click-error' as first_pair, 'click-error' as last_pair from h group by run")
def collision_compaction(spark, sf):
    return telemetry.collisions(hits(spark, sf))


PAIR_SQL = STATES_SQL + """, a as (select run, row_number() over (partition by run order by frame) as frame, x, y, vx, vy from s where actor = 'click'), b as (select run, row_number() over (partition by run order by frame) as frame, x, y, vx, vy from s where actor = 'view'),
d as (select run, frame, b.x - a.x as dx, b.y - a.y as dy, b.vx - a.vx as wx, b.vy - a.vy as wy from a join b using (run, frame)), c as (select *, case when -(dx * wx + dy * wy) > 0 and wx * wx + wy * wy > 1e-9 then -(dx * wx + dy * wy) / (wx * wx + wy * wy) end as t from d),
t as (select run, frame, case when sqrt((dx + wx * t) * (dx + wx * t) + (dy + wy * t) * (dy + wy * t)) < 3 then t end as ttc from c)"""


def pair_ttc(spark, sf):
    from pyspark.sql import Window

    s = states(spark, sf)
    side = lambda actor: s.where(F.col("actor") == actor).withColumn("frame", F.row_number().over(Window.partitionBy("run").orderBy("frame")))
    return telemetry.time_to_collision(side("click"), side("view"))


@query("time_to_collision", PAIR_SQL + " select run, frame, round(ttc, 6) as ttc, round(min(ttc) over (partition by run order by frame rows unbounded preceding), 6) as running_min from t")
def time_to_collision(spark, sf):
    return telemetry.running_minimum(pair_ttc(spark, sf)).select("run", "frame", F.round("ttc", 6).alias("ttc"), F.round("running_min", 6).alias("running_min"))


@query("minimum_ttc", PAIR_SQL + " select run, round(min(ttc), 6) as min_ttc, count(ttc) as closing_frames from t group by run")
def minimum_ttc(spark, sf):
    return pair_ttc(spark, sf).groupBy("run").agg(F.round(F.min("ttc"), 6).alias("min_ttc"), F.count("ttc").alias("closing_frames"))


@query("nearest_keyframes", STATES_SQL + """, sp as (select run, min(frame) as lo, max(frame) as hi from s group by run), k as (select run, min(frame) as f, max(frame) as l, arg_max(frame, (impulse, -frame)) as p from h group by run),
 w as (select distinct run, unnest(case when p is not null then [f - 20, p, l + 20] else [lo, lo + (hi - lo) // 3, lo + 2 * ((hi - lo) // 3)] end) as target from sp left join k using (run))
 select w.run, target, arg_min(frame, (abs(frame - target), frame)) as frame from w join s using (run) group by w.run, target""")
def nearest_keyframes(spark, sf):
    s = states(spark, sf).select("run", "frame")
    return telemetry.nearest_frames(s, telemetry.keyframe_targets(s, hits(spark, sf)))


@query("even_frames", STATES_SQL + ", p as (select run, frame, row_number() over (partition by run order by frame) as r, count(*) over (partition by run) as n from s) select run, frame from p where r in (1, n // 2 + 1, n)")
def even_frames(spark, sf):
    return telemetry.even_pick(states(spark, sf).select("run", "frame"))


@query("run_constraints", STATES_SQL + ", o as (select run, bool_and(x between -49.9 and 49.9) as in_lane, min(frame) as f from s group by run), k as (select run, min(frame) as hit from h group by run) select run, hit is not null as collided, in_lane, case when hit is not null then hit >= f end as ordered, case when hit is not null and in_lane and hit >= f then 'passed' else 'failed' end as status from o left join k using (run)")
def run_constraints(spark, sf):
    return telemetry.constraint_results(states(spark, sf), hits(spark, sf), -49.9, 49.9)


@query("impact_speed", STATES_SQL + ", k as (select run, min(frame) as frame from h group by run) select k.run, k.frame, round(sqrt(vx * vx + vy * vy), 6) as impact_speed, k.run || '@' || k.frame || ':' || actor as signature from k join s on s.run = k.run and s.frame = k.frame")
def impact_speed(spark, sf):
    first = hits(spark, sf).groupBy("run").agg(F.min("frame").alias("frame"))
    return first.join(states(spark, sf), ["run", "frame"]).select("run", "frame", F.round(F.hypot("vx", "vy"), 6).alias("impact_speed"), F.format_string("%d@%d:%s", "run", "frame", "actor").alias("signature"))


@query("observed_values", "select event_id, cast(props->>'$.k' as bigint) as k, event_type as name from events")
def observed_values(spark, sf):
    e = read(spark, sf, "events")
    return e.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"), F.col("event_type").alias("name"))


# -- runtime -------------------------------------------------------------------------------------
SUM_SQL = "select {k}, count(*) as n, round(sum({v}), 6) as total, round(avg({v}), 6) as mean, round(coalesce(stddev_samp({v}), 0), 6) as stdev, round(min({v}), 6) as \"min\", round(quantile_cont({v}, 0.5), 6) as p50, round(quantile_disc({v}, 0.95), 6) as p95, round(max({v}), 6) as \"max\" from {t} group by {k}"


@query("latency_by_mode", SUM_SQL.format(k="event_type", v="value", t="events"))
def latency_by_mode(spark, sf):
    return runtime.summary(read(spark, sf, "events"), ["event_type"], "value")


@query("latency_by_scenario", SUM_SQL.format(k="user_id", v="value", t="events"))
def latency_by_scenario(spark, sf):
    return runtime.summary(read(spark, sf, "events"), ["user_id"], "value")


WALL_SQL = "select {k}, count(*) as n, round((epoch_us(max(ts + to_seconds(cast(event_id % 60 as int)))) - epoch_us(min(ts))) / 1e6, 6) as wall_seconds from events group by {k}"


def requests(spark, sf):
    return read(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "ts", (F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 60).cast("decimal(18,6)"))).alias("done"))


@query("phase_wall", f"select *, round(n / nullif(wall_seconds, 0), 9) as throughput from ({WALL_SQL.format(k='event_type')})")
def phase_wall(spark, sf):
    return runtime.phase_wall(requests(spark, sf), ["event_type"], "ts", "done")


@query("resources_in_phase", "with i as (select event_type as phase, min(ts) + interval 2 day as a, max(ts) - interval 3 day as b from events where event_type in ('error') group by 1) select user_id, count(*) as n, round(avg(value), 6) as mean from events e where exists (select 1 from i where e.ts between a and b) group by user_id")
def resources_in_phase(spark, sf):
    e = read(spark, sf, "events")
    phase = e.where("event_type = 'error'").groupBy("event_type").agg((F.min("ts") + F.expr("interval 2 days")).alias("a"), (F.max("ts") - F.expr("interval 3 days")).alias("b")).drop("event_type")
    return runtime.within(e, "ts", phase, "a", "b").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("gpu_summary", "with g as (select unnest([0, 1]) as idx, unnest([value, value * 2]) as used from events), t(idx, total) as (values (0, 1000.0), (1, 4000.0)) select idx, count(*) as n, round(avg(used), 6) as mean_used, round(max(used), 6) as max_used, round(100 * max(used) / max(total), 6) as percent from g join t using (idx) group by idx")
def gpu_summary(spark, sf):
    e = read(spark, sf, "events").select(F.array(F.struct(F.lit(0).alias("idx"), F.col("value").alias("used")), F.struct(F.lit(1).alias("idx"), (F.col("value") * 2).alias("used"))).alias("gpus"))
    total = spark.createDataFrame([(0, 1000.0), (1, 4000.0)], "idx int, total double")
    g = e.select(F.inline("gpus")).join(F.broadcast(total), "idx")  # a row for each device
    return g.groupBy("idx").agg(F.count("*").alias("n"), F.round(F.avg("used"), 6).alias("mean_used"), F.round(F.max("used"), 6).alias("max_used"), F.round(100 * F.max("used") / F.max("total"), 6).alias("percent"))


@query("concurrency_sweep", "with w as (select user_id % 5 + 1 as c, count(*) as n, round((epoch_us(max(ts + to_seconds(cast(event_id % 60 as int)))) - epoch_us(min(ts))) / 1e6, 6) as wall_seconds from events group by 1), t as (select *, round(n / wall_seconds, 9) as throughput from w) select c, n, wall_seconds, throughput, round(throughput / first_value(throughput) over (order by c), 6) as speedup, round(throughput / first_value(throughput) over (order by c) / (c / first_value(c) over (order by c)), 6) as efficiency from t")
def concurrency_sweep(spark, sf):
    return runtime.sweep(runtime.phase_wall(requests(spark, sf).withColumn("c", F.col("user_id") % 5 + 1), ["c"], "ts", "done"), "c")


@query("label_agreement", "with p as (select label % 3 as a, (label + case when vec_id % 4 = 0 then 1 else 0 end) % 3 as b from embeddings) select a, count(*) filter (where b = 0) as b0, count(*) filter (where b = 1) as b1, count(*) filter (where b = 2) as b2 from p group by a")
def label_agreement(spark, sf):
    p = two_runs(spark, sf)
    m = p.groupBy("a").pivot("b", [0, 1, 2]).count()
    return m.select("a", *(F.coalesce(F.col(str(i)), F.lit(0)).alias(f"b{i}") for i in range(3)))


def two_runs(spark, sf):
    return read(spark, sf, "embeddings").select((F.col("label") % 3).alias("a"), ((F.col("label") + F.when(F.col("vec_id") % 4 == 0, 1).otherwise(0)) % 3).alias("b"))


@query("run_kappa", "with p as (select label % 3 as a, (label + case when vec_id % 4 = 0 then 1 else 0 end) % 3 as b from embeddings), t as (select count(*) as n, sum(case when a = b then 1 else 0 end) as same from p), m as (select sum(x * y) as chance from (select a as l, count(*) as x from p group by a) join (select b as l, count(*) as y from p group by b) using (l)) select n, round(same / n, 9) as observed, round(chance / (n * n), 9) as expected, round((same / n - chance / (n * n)) / (1 - chance / (n * n)), 9) as kappa from t, m")
def run_kappa(spark, sf):
    return metrics.kappa(two_runs(spark, sf), [], "a", "b", one_if_certain=False)


@query("routing_economics", "select count(*) as n, count(*) filter (where event_type = 'error') as routed, round(100.0 * count(*) filter (where event_type = 'error') / count(*), 3) as routed_percent, count(*) - count(*) filter (where event_type = 'error') as avoided, round(sum(value) filter (where event_type = 'error') / count(*) filter (where event_type = 'error') * count(*), 3) as all_model_seconds, round(sum(value) filter (where event_type = 'error') / count(*) filter (where event_type = 'error') * count(*) / (61.32 + sum(value) filter (where event_type = 'error')), 3) as reduction from events")
def routing_economics(spark, sf):
    routed = F.col("event_type") == "error"
    got = read(spark, sf, "events").agg(F.count("*").alias("n"), F.count_if(routed).alias("routed"), F.sum(F.when(routed, F.col("value"))).alias("s"))
    return got.select("n", "routed", *(c.alias(k) for k, c in runtime.economics(F.col("n"), F.col("routed"), F.lit(61.32), F.col("s")).items()))


@query("token_totals", "select conv_id, cast(sum(length(text)) as bigint) as total, cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as answered, round(sum(length(text)) / (max(turn) * 1.5), 6) as per_second from conversations group by conv_id")
def token_totals(spark, sf):
    n = F.length("text")
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(n).alias("total"), F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("answered"), F.round(F.sum(n) / (F.max("turn") * 1.5), 6).alias("per_second"))


@query("acceptance_table", """with c as (select 'has rows' as "check", count(*) > 0 as ok from events union all select 'no nulls', count(value) = count(*) from events union all select 'no errors', count(*) filter (where event_type = 'error') = 0 from events) select * from c union all select 'OVERALL', bool_and(ok) from c""")
def acceptance_table(spark, sf):
    from millrace.operators import funnel

    counts = read(spark, sf, "events").agg(F.count("*").alias("n"), F.count("value").alias("v"), F.count_if(F.col("event_type") == "error").alias("e"))
    return runtime.acceptance(funnel.conserved(counts, {"has rows": F.expr("n > 0"), "no nulls": F.expr("v = n"), "no errors": F.expr("e = 0")}))


@query("impact_speeds", STATES_SQL + """, k as (select distinct run, frame + 3 as frame, actor, other from h), a as (select k.*, s.vx as ax, s.vy as ay, s.frame as af from k asof left join s on k.run = s.run and k.actor = s.actor and k.frame >= s.frame),
 b as (select a.*, s.vx as bx, s.vy as by_, s.frame as bf from a asof left join s on a.run = s.run and a.other = s.actor and a.frame >= s.frame) select run, frame, actor, other, round(sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)), 6) as relative_speed, frame - af as own_age, frame - bf as other_age from b""")
def impact_speeds(spark, sf):
    """Relative speed of both actors at collisions three frames after a state, from the last states of each."""
    late = hits(spark, sf).withColumn("frame", F.col("frame") + 3)
    return telemetry.impacts(late, states(spark, sf), 64).withColumn("relative_speed", F.round("relative_speed", 6))


@query("pair_constraints", STATES_SQL + """, l as (select distinct user_id as run, event_type as actor, case user_id % 3 when 0 then 'error' when 1 then 'click' else 'view' end as target from events), p as (select run, least(actor, other) || '-' || greatest(actor, other) as pair, min(frame) as hit from h where run % 5 > 0 group by all),
 f as (select run, min(frame) + case when run % 2 = 0 then 0 else 400 end as first from s group by run), y as (select run, arg_min(pair, (hit, pair)) as seen from p group by run), m as (select l.*, least(actor, target) || '-' || greatest(actor, target) as want, p.hit, first, seen from l left join p on p.run = l.run and p.pair = least(actor, target) || '-' || greatest(actor, target) left join f on f.run = l.run left join y on y.run = l.run)
 select run, actor, target, 'collision_target' as name, hit is not null as passed, want as expected, case when hit is not null then want else seen end as observed from m union all select run, actor, target, 'event_order', case when hit is not null then hit >= first end, cast(first as varchar), cast(hit as varchar) from m""")
def pair_constraints(spark, sf):
    """Pairs that should meet, in runs some of which have lost their collisions or their first states."""
    e = read(spark, sf, "events")
    target = F.when(F.col("user_id") % 3 == 0, "error").when(F.col("user_id") % 3 == 1, "click").otherwise("view")
    limits = e.select(F.col("user_id").alias("run"), F.col("event_type").alias("actor"), target.alias("target")).distinct()
    late = states(spark, sf).withColumn("frame", F.col("frame") + F.when(F.col("run") % 2 == 0, 0).otherwise(400))
    return telemetry.pair_constraints(limits, hits(spark, sf).where("run % 5 > 0"), late)
