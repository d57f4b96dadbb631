"""Reports on hand-made rows: gaps, repeated ids, empty tables, lines that do not read."""

import hashlib
import json

from millrace.operators import assurance, consensus, funnel, rules, runtime
from millrace.plans.cascade import ruled
from millrace.plans.reports import payload_fields


def test_role_status_and_overlap(spark):
    tasks = spark.createDataFrame([(i,) for i in range(4)], "id int")
    rows = [("a", i, v) for i, v in enumerate(["car_to_car", "reject", "uncertain", "accept"])]
    rows += [("b", i, v) for i, v in enumerate(["accept", "accept", "accept", "accept"])]
    rows += [("c", 0, "accept"), ("c", 0, "accept"), ("c", 9, None)]
    labels = spark.createDataFrame(rows, "role string, id int, label string")
    got = {r["role"]: r for r in consensus.role_status(tasks, labels, "id", "role", "label").collect()}
    assert tuple(got["a"])[1:] == (4, True, 3, 1, 0, False) and got["b"]["ready"] and got["b"]["same_ids"]
    assert tuple(got["c"])[1:] == (3, False, 2, 0, 1, False)
    r = consensus.overlap(tasks, labels, "id", "role", "label", "a", "b").first()
    assert (r["tasks"], r["overlap"], r["overlap_rate"], r["disagreements"], r["kappa"]) == (4, 3, 0.75, 1, 0.0)
    none = consensus.overlap(tasks, labels, "id", "role", "label", "a", "z").first()
    assert none["overlap"] == 0 and none["kappa"] is None
    assert consensus.overlap(tasks.limit(0), labels.limit(0), "id", "role", "label", "a", "b").first()["overlap_rate"] == 0.0


def test_metrics_are_withheld(spark):
    metrics = spark.createDataFrame([("m", 3, 0.5)], "method string, n int, f1 double")
    whole = spark.createDataFrame([("accept",), ("reject",)], "label string")
    assert tuple(consensus.withheld(metrics, whole, "label").first()) == ("m", 3, 0.5, 0)
    gaps = whole.unionByName(spark.createDataFrame([(None,), ("uncertain",)], "label string"))
    assert tuple(consensus.withheld(metrics, gaps, "label").first()) == ("m", 3, None, 2)
    assert consensus.withheld(metrics, gaps, "label", consensus.CANONICAL).first()["incomplete"] == 1


def test_fidelity(spark):
    rows = [("completed", True, None, "s1", 2.0, False, "x", ""), ("completed", False, True, "s1", None, True, None, "late"), ("completed", True, True, "", 4.0, None, "x", None), ("failed", True, True, "s2", 9.0, True, "x", "late")]
    df = spark.createDataFrame(rows, "status string, ran boolean, hard boolean, scenario string, ttc double, fallback boolean, topology string, reason string")
    r = assurance.fidelity_summary(df, "status", ["ran", "hard"], "scenario", ["ttc"], "fallback").first()
    assert (r["planned"], r["completed"], r["scenarios"], r["ran_passed"], r["ran_assessed"], r["hard_passed"], r["hard_assessed"], r["hard_rate"], r["ttc_mean"], r["fallbacks"]) == (4, 3, 1, 2, 3, 2, 2, 1.0, 3.0, 1)
    got = {x["value"]: tuple(x)[2:] for x in assurance.fidelity_strata(df, "status", ["topology"], ["ran", "hard"], "scenario", "hard").collect()}
    assert got == {"x": (2, 1, 1, 0.5, 1.0), "unspecified": (1, 1, 0, 0.0, 1.0)}
    assert [tuple(x) for x in assurance.taxonomy(df, "status", "reason").collect()] == [("late", 1)]
    none = assurance.fidelity_summary(df.limit(0), "status", ["ran"], "scenario", ["ttc"], "fallback").first()
    assert none["planned"] == 0 and none["ran_rate"] is None and none["ttc_mean"] is None


def test_call_audit(spark):
    index = spark.createDataFrame([("r1", "t1", "t1", "w1"), ("r2", "t2", "t2", "w2")], "request_id string, approved_sha256 string, template_sha256 string, rendered_sha256 string")
    calls = [(s, r, "t" + r[1], "w" + r[1], "PASS", 1) for s in (1, 2) for r in ("r1", "r2")]
    schema = "seed int, request_id string, template_sha256 string, rendered_sha256 string, verdict string, attempts int"
    scored = spark.createDataFrame([("m", 4, 3, 1)], "method string, n int, faults int, clean int")
    hits = index.limit(0)
    audit = lambda rows, s=scored, h=hits: assurance.call_audit(spark.createDataFrame(rows, schema), index, s, 4, 4, 3, 1, h).first()
    good = audit(calls)
    assert good["ok"] and (good["calls"], good["templates"], good["preserved"], good["retries"]) == (4, 2, 0, 0)
    bad = audit([*calls[:3], (2, "r3", "t3", "w3", "TIMEOUT", 4)])  # a request that the index lacks
    assert not bad["ok"] and (bad["hash_failures"], bad["preserved"], bad["retries"]) == (1, 1, 3)
    twice = audit([*calls[:3], calls[0]])
    assert not twice["ok"] and twice["duplicates"] == 1
    assert not audit([(1, "r1", None, "w1", "PASS", None), *calls[1:]])["ok"]
    assert not audit(calls, h=index)["ok"]
    assert not audit(calls, s=spark.createDataFrame([("m", 4, 2, 2)], "method string, n int, faults int, clean int"))["ok"]
    assert not audit([])["ok"]


def test_device_logs(spark):
    lines = ["t, 0, 50, 1000, 70.5", "t, 1, 100, 500, 30", "t, 7, 90, 1, 1, more", "t, 0, [N/A], 1, 1", "t, 1.5, 1, 1, 1", "short, 0, 1", "", "time, index, util, memory, power"]
    s = runtime.gpu_samples(spark.createDataFrame([(x,) for x in [*lines, None]], "l string"), "l")
    assert sorted(tuple(r) for r in s.collect()) == [(0, 50.0, 1000.0, 70.5), (1, 100.0, 500.0, 30.0), (7, 90.0, 1.0, 1.0)]
    totals = runtime.gpu_totals(spark.createDataFrame([("index, memory.total [MiB]",), ("0, 2000 MiB",), ("1, 1000 MiB",), ("x",)], "l string"), "l")
    r = runtime.gpu_report(s, totals).first()
    assert (r["n"], r["util_mean"], r["util_p95"], r["util_peak"], r["memory_mean"], r["memory_peak"], r["power_mean"]) == (3, 80.0, 99.0, 100.0, 50.0, 50.0, 33.83)
    none = runtime.gpu_report(s.limit(0), totals).first()
    assert none["n"] == 0 and none["util_mean"] is None
    assert runtime.cpu_report(spark.createDataFrame([], "busy int")).first()["n"] == 0


def test_sweep_report(spark):
    rows = [(1, "ok", 1.0, 0, 4), (1, "ok", 3.0, 4, 10), (4, "ok", 2.0, 0, 5), (4, "error", 9.0, 0, 2)]
    df = spark.createDataFrame(rows, "c int, status string, s double, a long, b long").selectExpr("c", "status", "s", "timestamp_seconds(a) as a", "timestamp_seconds(b) as b")
    one, four = runtime.sweep_report(df, "c", "status", "s", "a", "b").orderBy("c").collect()
    assert (one["wall_seconds"], one["mean"], one["p50"], one["p95"], one["throughput"], one["speedup"], one["efficiency_percent"]) == (10.0, 2.0, 2.0, 2.9, 0.2, 1.0, 100.0)
    assert (four["success"], four["failed"], four["mean"], four["speedup"], four["efficiency_percent"]) == (1, 1, 2.0, 2.0, 50.0)


def test_payloads_and_run_report(spark):
    texts = spark.createDataFrame([(1, '원고 차량이 "피고 차량"을 충격\n하였다'), (2, None), (3, "")], "id int, source_text string")
    ruled = rules.classified(texts, "source_text")
    for label in {r["rule"]["label"] for r in ruled.collect()}:
        for r in funnel.payloads(ruled, "id", "rule", label).collect():
            body = json.loads(r["payload"])
            assert list(body) == ["input_file", "source_text", "source_mode", "parsed", "rule_summary"] and body["parsed"] == dict.fromkeys(funnel.PARSED_FIELDS)
            assert list(body["rule_summary"]) == funnel.RULE_FIELDS and body["rule_summary"]["label"] == label
            assert body["source_text"] == {1: '원고 차량이 "피고 차량"을 충격\n하였다', 2: None, 3: ""}[r["id"]]
    results = spark.createDataFrame([("ok", "accept", 1.0), ("error", None, 2.0), ("skipped", None, 50.0)], "status string, label string, s double")
    r = funnel.run_report(results, "status", "label", "s", ["accept", "reject"]).first()
    assert tuple(r) == (3, 2, 1, 1, 1, 1, 0, 3.0, 1.5)
    none = funnel.run_report(results.limit(0), "status", "label", "s", ["accept"]).first()
    assert none["selected"] == 0 and none["elapsed"] == 0.0 and none["mean_seconds"] is None


def test_routed_table(spark):
    df = spark.createDataFrame([("open", "yes"), ("open", "no"), ("open", "yes"), ("yes", "yes")], "label string, final string")
    got = {r["outcome"]: tuple(r)[1:] for r in funnel.routed_table(df, "label", "final", "open").collect()}
    assert got == {"yes": (2, 66.667, 50.0), "no": (1, 33.333, 25.0)}


def test_payload_fields_of_few_and_many_files(spark, tmp_path):
    """The texts are read once, whether documents are dealt out anew or not."""
    texts = ["the station was far", "nothing", "", None, "the \"station\"\nwas far", "the station was far"]
    docs = spark.createDataFrame([(i, t, "en" if i else None, "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, files in (("few", 1), ("many", 3 * spark.sparkContext.defaultParallelism)):
        for k in range(files):  # a file of its own for each part, empty ones too
            docs.where(docs.doc_id % files == k).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "documents.parquet"))
        got = sorted(tuple(r) for r in payload_fields(spark, str(tmp_path / name)).collect())
        want = sorted((r.doc_id, r.rule.label, r.rule.score) for r in ruled(spark, str(tmp_path / name)).collect() if r.rule.label == "ambiguous")
        assert [(i, label, score) for i, *_, label, score in got] == want and {i for i, *_ in got} == {0, 4, 5}
        assert all(tuple(r[1:4]) == (hashlib.md5(texts[r[0]].encode()).hexdigest(), "prose", "en" if r[0] else None) for r in got)
