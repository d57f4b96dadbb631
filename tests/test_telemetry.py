"""As-of joins, impacts and pair constraints beside plain loops, on one long run and on gaps."""

import random

from millrace.operators import telemetry

STATES = "run long, actor string, frame long, vx double, vy double"


def test_last_states_of_a_long_run(spark):
    rnd = random.Random(2)
    rows = [(1, a, f, float(f), -float(f)) for a in "ab" for f in sorted(rnd.sample(range(100, 3000), 200))] + [(2, "a", 5, 1.0, 0.0), (2, "a", 5000, 2.0, 0.0)]
    asks = [(r, a, f) for r, a in ((1, "a"), (1, "b"), (2, "a"), (3, "a")) for f in [0, 99, 100, 101, *rnd.sample(range(4000), 60), 9999]]
    got = {(r["run"], r["actor"], r["frame"]): r["state"] and r["state"]["frame"] for r in telemetry.last_states(spark.createDataFrame(asks, "run long, actor string, frame long"), spark.createDataFrame(rows, STATES), 64).collect()}
    assert got == {(r, a, f): max((s[2] for s in rows if s[:2] == (r, a) and s[2] <= f), default=None) for r, a, f in asks}


def test_impacts_and_pairs(spark):
    states = spark.createDataFrame([(1, "a", 1, 3.0, 0.0), (1, "b", 2, 0.0, 4.0), (2, "a", 9, 1.0, 1.0)], STATES)
    events = spark.createDataFrame([(1, 4, "b", "a"), (1, 4, "b", "a"), (2, 3, "a", "b")], "run long, frame long, actor string, other string")
    got = {r["run"]: (r["relative_speed"], r["own_age"], r["other_age"]) for r in telemetry.impacts(events, states).collect()}
    assert got == {1: (5.0, 2, 3), 2: (None, None, None)}
    limits = spark.createDataFrame([(1, "a", "b"), (1, "a", "c"), (2, "b", "a"), (3, "a", "b")], "run long, actor string, target string")
    got = {(r["run"], r["target"], r["name"]): (r["passed"], r["observed"]) for r in telemetry.pair_constraints(limits, events, states).collect()}
    assert got == {
        (1, "b", "collision_target"): (True, "a-b"), (1, "b", "event_order"): (True, "4"), (1, "c", "collision_target"): (False, "a-b"), (1, "c", "event_order"): (None, None),
        (2, "a", "collision_target"): (True, "a-b"), (2, "a", "event_order"): (False, "3"), (3, "b", "collision_target"): (None, None), (3, "b", "event_order"): (None, None),
    }


def test_speeds_that_are_no_numbers(spark):
    rows = [(1, "a", k, k, s, 0.0, 0.0, float(k)) for k, s in enumerate([float("nan"), 2.0, None, 4.0, float("inf")])]
    r = telemetry.trajectories(spark.createDataFrame(rows, "run long, actor string, frame long, time long, speed double, x double, y double, yaw double")).first()
    assert (r["first_speed"], r["last_speed"], r["mean_speed"], r["samples"], r["start_yaw"], r["end_yaw"], r["first_time"], r["last_time"]) == (2.0, 4.0, 3.0, 5, 0.0, 4.0, 0, 4)
