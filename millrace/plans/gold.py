"""Queries of gold labels, selective metrics, kappa, intervals and paired tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import consensus, metrics, resample
from millrace.plans.base import read, registry

query, QUERIES, SQL = registry()

# Two annotators: quality with a hash of the id as noise. Methods: three lengths' rules with abstentions.
ANNOTATED_SQL = """with a as (select doc_id, quality, toxic, case when doc_id % 11 = 0 then 'uncertain' when quality = 1 then 'car_to_car' else 'not_car_to_car' end as a,
 case when doc_id % 13 = 0 then ' Abstain ' when (quality = 1) = (doc_id % 17 <> 0) then 'accepted' else 'REJECT' end as b from labels),
n as (select doc_id, quality, toxic, case when doc_id % 11 = 0 then 'UNRESOLVED' when quality = 1 then 'ACCEPT' else 'REJECT' end as a, case when doc_id % 13 = 0 then 'UNRESOLVED' when (quality = 1) = (doc_id % 17 <> 0) then 'ACCEPT' else 'REJECT' end as b from labels),
s as (select doc_id, a, b, case when a = b and a <> 'UNRESOLVED' then a else 'UNRESOLVED' end as gold, case when a = b and a <> 'UNRESOLVED' then null when a = 'UNRESOLVED' and b = 'UNRESOLVED' then 'common_uncertain'
 when a = 'UNRESOLVED' or b = 'UNRESOLVED' then 'one_annotator_uncertain' else 'binary_label_disagreement' end as reason from n)
"""


def annotators(spark, sf):
    l = read(spark, sf, "labels")  # noqa: E741
    a = l.select("doc_id", F.when(F.col("doc_id") % 11 == 0, "uncertain").when(F.col("quality") == 1, "car_to_car").otherwise("not_car_to_car").alias("label"))
    b = l.select("doc_id", F.when(F.col("doc_id") % 13 == 0, " Abstain ").when((F.col("quality") == 1) == (F.col("doc_id") % 17 != 0), "accepted").otherwise("REJECT").alias("label"))
    return a, b


def agreed(spark, sf):
    return consensus.split(*annotators(spark, sf), "doc_id", "label")


@query("normalise_labels", ANNOTATED_SQL + "select 'a' as role, a as label, count(*) as n from n group by a union all select 'b', b, count(*) from n group by b")
def normalise_labels(spark, sf):
    a, b = annotators(spark, sf)
    both = a.withColumn("role", F.lit("a")).unionByName(b.withColumn("role", F.lit("b")))
    return both.groupBy("role", consensus.label_of(F.col("label")).alias("label")).agg(F.count("*").alias("n"))


@query("bad_labels", "select event_id, event_type as label, 'unsupported' as error from events where event_type not in ('accept')")
def bad_labels(spark, sf):
    return consensus.bad_labels(read(spark, sf, "events"), "event_id", "event_type")


@query("id_set_equality", "select (select count(*) from documents where doc_id not in (select doc_id from labels)) as missing, (select count(*) from labels where doc_id not in (select doc_id from documents)) as unexpected, (select count(*) from documents) = (select count(*) from labels) as ok")
def id_set_equality(spark, sf):
    return consensus.same_ids(read(spark, sf, "documents"), read(spark, sf, "labels"), "doc_id")


@query("repeated_keys", "select l_orderkey as key, count(*) as n from lineitem group by 1 having count(*) > 1")
def repeated_keys(spark, sf):
    return consensus.repeated_keys(read(spark, sf, "lineitem"), "l_orderkey")


@query("source_hash_conflicts", "select doc_id from documents where doc_id % 29 = 0")
def source_hash_conflicts(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    other = d.withColumn("h", F.when(F.col("doc_id") % 29 == 0, F.reverse("h")).when(F.col("doc_id") % 7 != 0, F.col("h")))
    return consensus.hash_conflicts(d, other, "doc_id", "h")


@query("consensus_split", ANNOTATED_SQL + "select doc_id, a, b, gold, reason from s")
def consensus_split(spark, sf):
    return agreed(spark, sf)


@query("consensus_counts", ANNOTATED_SQL + "select a, b, coalesce(reason, 'consensus') as outcome, count(*) as n from s group by all")
def consensus_counts(spark, sf):
    return agreed(spark, sf).groupBy("a", "b", F.coalesce("reason", F.lit("consensus")).alias("outcome")).agg(F.count("*").alias("n"))


@query("adjudication", ANNOTATED_SQL + "select s.doc_id, case when reason is null then gold when doc_id % 3 = 0 then 'UNRESOLVED' when doc_id % 5 = 0 then 'REJECT' else 'ACCEPT' end as final, case when reason is null then 'consensus' when doc_id % 3 = 0 then 'open' else 'review' end as source from s")
def adjudication(spark, sf):
    review = agreed(spark, sf).where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "rejected").otherwise("accept").alias("label"))
    return consensus.adjudicated(agreed(spark, sf), review, "doc_id", "label").select("doc_id", "final", "source")


@query("field_agreement", "select p_partkey, array_to_string(list_filter([case when p_brand is distinct from case when p_partkey % 6 = 0 then 'x' else p_brand end then 'p_brand' end, case when p_size is distinct from nullif(p_size, 7) then 'p_size' end], lambda x: x is not null), ',') as apart, p_partkey % 6 <> 0 and p_size <> 7 as agreed from part")
def field_agreement(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    q = p.select("p_partkey", F.when(F.col("p_partkey") % 6 == 0, "x").otherwise(F.col("p_brand")).alias("p_brand"), F.nullif("p_size", F.lit(7)).alias("p_size"))
    return consensus.field_agreement(p, q, "p_partkey", ["p_brand", "p_size"]).select("p_partkey", F.array_join("disagreements", ",").alias("apart"), "agreed")


@query("annotator_disagreements", ANNOTATED_SQL + "select doc_id, a, b from s where a is distinct from b")
def annotator_disagreements(spark, sf):
    return agreed(spark, sf).where(~F.col("a").eqNullSafe(F.col("b"))).select("doc_id", "a", "b")


@query("gold_status", ANNOTATED_SQL + ", u as (select 'a' as role, a as l from n union all select 'b', b from n union all select 'open', case when doc_id % 4 = 0 then null else a end from n) select role, count(*) as n, count(*) filter (where l = 'ACCEPT') as accept, count(*) filter (where l = 'REJECT') as reject, count(*) filter (where l = 'UNRESOLVED') as unresolved, count(*) filter (where l is null) as missing, count(*) = count(l) as complete from u group by role")
def gold_status(spark, sf):
    a, b = annotators(spark, sf)
    part = a.withColumn("label", F.when(F.col("doc_id") % 4 != 0, F.col("label")))
    roles = a.withColumn("role", F.lit("a")).unionByName(b.withColumn("role", F.lit("b"))).unionByName(part.withColumn("role", F.lit("open")))
    return consensus.status(roles, "role", "label")


def _k(a: str, b: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    g = f"group by {keys}" if keys else ""
    on = f"using ({keys})" if keys else "on true"
    return f"""t as (select {k}count(*) as n, sum(case when {a} = {b} then 1 else 0 end) as same from p {g}), m as (select {k}sum(x * y) as chance from (select {k}{a} as l, count(*) as x from p group by all) join (select {k}{b} as l, count(*) as y from p group by all) using ({k}l) {g})
 select {k}n, round(same / n, 9) as observed, round(chance / (n * n), 9) as expected, round(case when chance = n * n then 1.0 else (same / n - chance / (n * n)) / (1 - chance / (n * n)) end, 9) as kappa from t join m {on}"""


@query("annotator_kappa", ANNOTATED_SQL + ", p as (select a, b from n), " + _k("a", "b"))
def annotator_kappa(spark, sf):
    return metrics.kappa(agreed(spark, sf), [], "a", "b")


@query("kappa_by_status", "with p as (select o_orderpriority as k, o_orderstatus as a, case when o_orderkey % 5 = 0 then 'F' else o_orderstatus end as b from orders), " + _k("a", "b", "k"))
def kappa_by_status(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_orderstatus").alias("a"), F.when(F.col("o_orderkey") % 5 == 0, "F").otherwise(F.col("o_orderstatus")).alias("b"))
    return metrics.kappa(o, ["k"], "a", "b")


# -- predictions: four methods over all gold rows ----------------------------------------------
METHODS = ["rule_only", "model_only", "hybrid"]
PRED_SQL = """with g as (select d.doc_id, d.lang, d.n_chars, l.quality = 1 as truth from documents d join labels l on d.doc_id = l.doc_id),
p0 as (select g.*, method, case method when 'rule_only' then case when n_chars % 3 = 0 then null else n_chars > 300 end when 'model_only' then case when n_chars % 19 = 0 then null else (doc_id % 9 <> 0) = truth end
 else case when n_chars % 7 = 0 then null when n_chars % 2 = 0 then n_chars > 300 else truth end end as predicted from g, (values ('rule_only'), ('model_only'), ('hybrid')) m(method)),
p as (select * from p0 union all select doc_id, lang, n_chars, truth, 'hybrid_forced_reject', coalesce(predicted, false) from p0 where method = 'hybrid')
"""
CELLS_SQL = "count(*) as n, count(predicted) as covered, count(*) - count(predicted) as pending, count(*) filter (where truth and predicted) as tp, count(*) filter (where not truth and not predicted) as tn, count(*) filter (where not truth and predicted) as fp, count(*) filter (where truth and not predicted) as fn"
RATIO_SQL = """n, covered, pending, tp, tn, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) as f1,
 round(coalesce((tp::double * tn - fp::double * fn) / nullif(sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 9) as mcc, round(coalesce(covered / nullif(n, 0), 0), 9) as coverage, round((fp + fn) / nullif(covered, 0), 9) as selective_risk,
 round(coalesce(fp / nullif(tp + fp, 0), 0), 9) as false_acceptance, round(coalesce(fn / nullif(tp + fn, 0), 0), 9) as false_negative_rate"""


def predictions(spark, sf):
    g = read(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("truth")), "doc_id")
    n = F.col("n_chars")
    each = g.withColumn("method", F.explode(F.array(*map(F.lit, METHODS))))
    rule = F.when(n % 3 != 0, n > 300)
    model = F.when(n % 19 != 0, (F.col("doc_id") % 9 != 0) == F.col("truth"))
    hybrid = F.when(n % 7 == 0, F.lit(None)).when(n % 2 == 0, n > 300).otherwise(F.col("truth"))
    p = each.withColumn("predicted", F.when(F.col("method") == "rule_only", rule).when(F.col("method") == "model_only", model).otherwise(hybrid))
    forced = p.where("method = 'hybrid'").withColumn("method", F.lit("hybrid_forced_reject")).withColumn("predicted", F.coalesce("predicted", F.lit(False)))
    return p.unionByName(forced)


@query("selective_metrics", PRED_SQL + f"select method, {RATIO_SQL} from (select method, {CELLS_SQL} from p group by method)")
def selective_metrics(spark, sf):
    return metrics.ratios(metrics.cells(predictions(spark, sf), ["method"], F.col("truth"), F.col("predicted")))


@query("selective_metrics_by_language", PRED_SQL + f"select method, lang, {RATIO_SQL} from (select method, lang, {CELLS_SQL} from p group by method, lang)")
def selective_metrics_by_language(spark, sf):
    return metrics.ratios(metrics.cells(predictions(spark, sf), ["method", "lang"], F.col("truth"), F.col("predicted")))


@query("weighted_metrics", PRED_SQL + """, w as (select lang, round(count(*) / 10.0, 1) as weight from documents group by lang), x as (select method, truth, predicted, weight from p join w using (lang)),
 c as (select method, sum(weight) as n, sum(case when predicted is not null then weight else 0 end) as covered, sum(case when predicted is null then weight else 0 end) as pending, sum(case when truth and predicted then weight else 0 end) as tp, sum(case when not truth and not predicted then weight else 0 end) as tn,
 sum(case when not truth and predicted then weight else 0 end) as fp, sum(case when truth and not predicted then weight else 0 end) as fn from x group by method)
 select method, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round((tp::double * tn - fp::double * fn) / sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 6) as mcc, round(covered / n, 6) as coverage, round((fp + fn) / covered, 6) as selective_risk from c""")
def weighted_metrics(spark, sf):
    w = read(spark, sf, "documents").groupBy("lang").agg(F.round(F.count("*") / 10, 1).alias("weight"))
    got = metrics.ratios(metrics.cells(predictions(spark, sf).join(w, "lang"), ["method"], F.col("truth"), F.col("predicted"), F.col("weight")))
    return got.select("method", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "mcc", "coverage", "selective_risk")))


@query("unresolved_detection", PRED_SQL + ", u as (select method, n_chars % 5 = 0 as truth, predicted is null as predicted from p) select method, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) as f1 from (select method, " + CELLS_SQL + " from u group by method)")
def unresolved_detection(spark, sf):
    u = predictions(spark, sf).select("method", (F.col("n_chars") % 5 == 0).alias("truth"), F.col("predicted").isNull().alias("predicted"))
    return metrics.ratios(metrics.cells(u, ["method"], F.col("truth"), F.col("predicted"))).select("method", "tp", "fp", "fn", "precision", "recall", "f1")


ALL = [*METHODS, "hybrid_forced_reject"]


@query("mcnemar_pairs", PRED_SQL + """, x as (select doc_id, method, truth = predicted as ok from p where predicted is not null), j as (select l.method as "left", r.method as "right", l.ok as lo, r.ok as ro from x l join x r on l.doc_id = r.doc_id
 where list_position(['rule_only', 'model_only', 'hybrid', 'hybrid_forced_reject'], l.method) < list_position(['rule_only', 'model_only', 'hybrid', 'hybrid_forced_reject'], r.method)) select "left", "right", count(*) as common, count(*) filter (where lo and not ro) as b, count(*) filter (where not lo and ro) as c from j group by all""")
def mcnemar_pairs(spark, sf):
    right = predictions(spark, sf).withColumn("right_", F.col("truth") == F.col("predicted"))
    return resample.pairwise(right, "doc_id", "method", "right_", ALL)


@query("mcnemar_exact")
def mcnemar_exact(spark, sf):
    return mcnemar_pairs(spark, sf).withColumn("p", F.round(resample.exact_mcnemar("b", "c"), 12))


@query("bootstrap_intervals")
def bootstrap_intervals(spark, sf):
    p = predictions(spark, sf)
    open_ = p.where("predicted is null").groupBy("method").agg(F.count_if("truth").alias("true_open"), F.count_if(~F.col("truth")).alias("false_open"))
    cells = metrics.cells(p, ["method"], F.col("truth"), F.col("predicted")).join(open_, "method", "left").fillna(0, ["true_open", "false_open"])
    return resample.stratified_bootstrap(cells, "method", 10_000, 7)


@query("interpolated_percentiles", "select event_type, round(quantile_cont(value, 0.025), 9) as p025, round(quantile_cont(value, 0.5), 9) as p50, round(quantile_cont(value, 0.95), 9) as p95 from events group by event_type")
def interpolated_percentiles(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(*(F.round(F.percentile("value", q), 9).alias(n) for n, q in (("p025", 0.025), ("p50", 0.5), ("p95", 0.95))))


@query("record_fingerprints", "select c_custkey, sha256('{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}') as digest from customer")
def record_fingerprints(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", consensus.record_digest("c_custkey", "c_name").alias("digest"))


@query("table_digest")
def table_digest(spark, sf):
    rows = read(spark, sf, "lineitem").select(consensus.record_digest("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").alias("h"))
    return consensus.table_digest(rows, "h")


@query("hash_chain_breaks", "select conv_id, count(*) as events, min(case when conv_id % 9 = 0 and turn = 2 then turn end) as first_break from conversations group by conv_id")
def hash_chain_breaks(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf, "conversations").select("conv_id", "turn", F.md5("text").alias("payload"))
    # a conversation's turns are few: each event is sealed over all payloads up to it
    seal = F.aggregate(F.collect_list("payload").over(w), F.lit(""), lambda before, p: F.sha2(F.concat_ws("|", before, p), 256))
    sealed = c.withColumn("own", seal).withColumn("previous", F.lag("own").over(w))
    broken = sealed.withColumn("own", F.when((F.col("conv_id") % 9 == 0) & (F.col("turn") == 2), "x").otherwise(F.col("own")))
    return consensus.chain_breaks(broken, "conv_id", "turn", "payload", "previous", "own")


@query("quote_alignment", """with x as (select doc_id, coalesce(string_split(text, chr(10)), []) as p, coalesce(string_split(text, '. '), []) as h from documents)
 select doc_id, len(list_filter(p, lambda a: a <> '' and len(list_filter(h, lambda b: b <> '' and (contains(a, b) or contains(b, a)))) > 0)) > 0 as aligned from x""")
def quote_alignment(spark, sf):
    """Lines of whole texts against their sentences."""
    d = read(spark, sf, "documents").select("doc_id", *(F.coalesce(F.split("text", by), F.array().cast("array<string>")).alias(n) for n, by in (("p", "\n"), ("h", r"\. "))))
    return d.select("doc_id", consensus.quotes_align(F.col("p"), F.col("h")).alias("aligned"))


@query("selective_safety", ANNOTATED_SQL + "select gold, count(*) as n, count(*) filter (where gold = 'REJECT' and toxic = 1) as leaked, count(*) filter (where gold = 'UNRESOLVED' and quality = 0) as abstained, array_to_string(list_sort(coalesce(list(doc_id) filter (where gold = 'REJECT' and toxic = 1), [])), ',') as ids from s join labels using (doc_id) group by gold")
def selective_safety(spark, sf):
    x = agreed(spark, sf).join(read(spark, sf, "labels"), "doc_id")
    leaked = (F.col("gold") == "REJECT") & (F.col("toxic") == 1)
    return x.groupBy("gold").agg(F.count("*").alias("n"), F.count_if(leaked).alias("leaked"), F.count_if((F.col("gold") == "UNRESOLVED") & (F.col("quality") == 0)).alias("abstained"), F.array_join(F.sort_array(F.collect_list(F.when(leaked, F.col("doc_id")))), ",").alias("ids"))
