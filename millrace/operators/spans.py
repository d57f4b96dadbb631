"""Offset-exact spans and relations: sentences, statuses, mentions, clauses, roles, events, integrity.

Offsets are code points. Splitting a text at a pattern and taking the lengths of pieces and
matches in order gives every match's place without leaving the built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Terms:
    """Patterns and word groups of span extraction."""

    mentions: tuple[str, ...]
    collisions: tuple[str, ...]
    maneuvers: tuple[tuple[str, str], ...]
    statuses: tuple[tuple[str, tuple[str, ...]], ...]
    driver: str
    gate: str = "운전"
    roles: tuple[str, ...] = ("피고", "원고", "자신의")
    instrument: str = r"(?:으로|로)(?:\s|,|$)"
    object: str = r"(?:을|를)(?:\s|,|$)"
    subject: str = r"(?:이|가)(?:\s|,)"
    reach: int = 35


# The terms that results for Korean judgments depend on.
KOREAN = Terms(
    mentions=(
        r"(?:피고(?:인)?|원고|피해자|가해자|상대방|선행|후행|앞|뒤)(?:의|인\s+운전의?|가\s+운전하는|가\s+운전하던)?\s*(?:차량|자동차|승용차|승합차|화물차량?|트럭|버스|오토바이)",
        r"(?:[A-Z]\s+)?[A-Z가-힣0-9()·-]{2,15}\s+(?:승용차|승합차|화물차량?|트럭|버스|오토바이)",
        r"(?:자신의|피고인의|원고의|피해자의|피고인\s+운전|원고\s+운전)\s*차량",
    ),
    collisions=("충격", "충돌", "추돌", "접촉", "들이받", "부딪"),
    maneuvers=(
        ("signal_wait", "신호대기"), ("stopped", "정차"), ("lane_change", "차선변경"), ("lane_change", "차선 변경"), ("lane_change", "차선을 변경"), ("lane_change", "차로 변경"), ("lane_change", "차로를 변경"),
        ("lane_change", "진로변경"), ("lane_change", "진로 변경"), ("lane_change", "진로를 변경"), ("left_turn", "좌회전"), ("right_turn", "우회전"), ("merge", "합류"), ("centerline_intrusion", "중앙선"),
    ),
    statuses=(
        ("party_claim", ("주장", "항소이유", "원고는", "피고는")), ("accepted_fact", ("인정사실", "범죄사실", "공소사실", "인정된다")), ("court_reasoning", ("판단", "살피건대", "법원은", "보건대")),
    ),
    driver=r"(피고인|피해자(?:\s+[A-Z가-힣0-9]+)?|원고(?:\s+[A-Z가-힣0-9]+)?)",
)


def once(**columns: Column) -> Column:
    """Columns worked out once for each row, however often they are used."""
    return F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))).alias(*columns)


#: Ends are summed up in stretches of so many matches, as an array grows by being copied.
STRETCH = 32


def _sums(steps: Column, size: Column) -> Column:
    """Running sums of an array: within stretches first, then over what the stretches come to."""
    start = F.struct(F.array().cast("array<int>").alias("sums"), F.lit(0).alias("at"))
    grow = lambda a, n: F.struct(F.array_append(a["sums"], a["at"] + n).alias("sums"), (a["at"] + n).alias("at"))
    firsts = F.sequence(F.lit(1), F.greatest(size, F.lit(1)), F.lit(STRETCH))
    inner = lambda held: F.transform(firsts, lambda k: F.aggregate(F.slice(held, k, STRETCH), start, grow))
    return F.transform(  # arrays of one, so that what several steps read is worked out once
        F.transform(F.array(steps), inner),
        lambda parts: F.flatten(F.zip_with(
            parts, F.aggregate(F.transform(parts, lambda p: p["at"]), start, grow, lambda a: a["sums"]),
            lambda p, after: F.transform(p["sums"], lambda x: x + after - p["at"]),
        )),
    )[0]


def _found(text: Column, pattern: str) -> Column:
    """array<struct<start,end,match>>: the matches of a text in order, with their places."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.array(F.struct(gaps.alias("gaps"), found.alias("found")))
    steps = lambda b: F.zip_with(F.slice(b["gaps"], 1, F.size(b["found"])), b["found"], lambda p, m: F.length(p) + F.length(m))
    place = lambda m, e: F.struct((e - F.length(m)).cast("long").alias("start"), e.cast("long").alias("end"), m.alias("match"))
    return F.transform(both, lambda b: F.zip_with(b["found"], _sums(steps(b), F.size(b["found"])), place))[0]


def _placed(df: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """keys, text, found: the matches of each row with their places, summed up within the row; nothing is shuffled."""
    return df.select(*keys, text, once(found=_found(F.col(text), pattern)))


def occurrences(df: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """keys, start, end, match: every leftmost, non-overlapping match with its place; texts without one take no part."""
    return _placed(df.where(F.col(text).isNotNull()), keys, text, pattern).select(*keys, F.inline("found"))


#: White space at the ends of a sentence: what Python's strip() takes.
_BLANK = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


#: A text is cut after each of these and after each end of line; alone they are no sentence.
_STOPS = (".", "!", "?", "。")


def sentence_list(text: Column, told=None) -> Column:
    """array<struct<start,end,quote>>: the sentences of a text in order, or those of them whose quote passes a test.

    The text is cut once and nothing else is matched; what does not pass is neither stripped nor kept.
    """
    strip = lambda q: F.btrim(q, F.lit(_BLANK))
    test = told or (lambda q: F.lit(True))

    def bare(s):
        lead = F.length(s["piece"]) - F.length(F.ltrim(s["piece"], F.lit(_BLANK)))
        return F.transform(F.array(strip(s["piece"])), lambda q: F.struct((s["at"] + lead).alias("start"), (s["at"] + lead + F.length(q)).alias("end"), q.alias("quote")))[0]

    def cut(pieces):
        placed = F.zip_with(pieces, _sums(F.transform(pieces, F.length), F.size(pieces)), lambda q, e: F.struct((e - F.length(q)).cast("long").alias("at"), q.alias("piece")))
        passed = F.filter(placed, lambda s: ~s["piece"].isin("", *_STOPS) & test(s["piece"]))  # white space can make a piece pass, but not keep it from it
        found = F.filter(F.transform(passed, bare), lambda s: (s["quote"] != "") & test(s["quote"]))
        none = ~F.exists(pieces, lambda q: ~q.isin("", *_STOPS) & (strip(q) != ""))
        whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.length(text).cast("long").alias("end"), text.alias("quote")))
        return F.when(none, F.filter(whole, lambda s: test(s["quote"]))).otherwise(found)

    return F.transform(F.array(F.split(text, r"(?<=[.!?。\n])", -1)), cut)[0]


def sentences(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, start, end, quote: sentences (lines cut after . ! ? 。), stripped; the whole text where there is none."""
    return df.where(F.col(text).isNotNull()).select(*keys, F.inline(sentence_list(F.col(text))))


def legal_status(quote: Column, terms: Terms) -> Column:
    """The first status one of whose words occurs, else unknown."""
    out = F
    for name, words in terms.statuses:
        test = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(quote, w))
        out = out.when(test, name)
    return out.otherwise("unknown")


def mentions(text: Column, terms: Terms) -> Column:
    """Distinct mentions in first-seen order, without those that are part of another."""
    raw = F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in terms.mentions)))
    every = F.array_distinct(F.transform(raw, lambda m: F.btrim(m, F.lit(" \t\n\r\f\u000b"))))
    return F.element_at(F.transform(F.array(every), lambda all_: F.filter(all_, lambda m: ~F.exists(all_, lambda o: (o != m) & F.contains(o, m)))), 1)


def before(text: Column, part: Column) -> Column:
    """How many characters stand before a part that the text holds: by a pattern, which leaps where instr() compares at each place."""
    return F.length(F.try_element_at(F.split(text, F.concat(F.lit("\\Q"), part, F.lit("\\E")), 2), F.lit(1)))


def mention_nodes(df: DataFrame, key: str, text: str, terms: Terms, *more: str) -> DataFrame:
    """key, node_id (vehicle_1 ..), ord, label, source_start, and what else of a row is named."""
    listed = df.select(key, *more, F.col(text).alias("_t"), F.posexplode(mentions(F.col(text), terms)).alias("ord", "label"))
    return listed.select(key, F.format_string("vehicle_%d", F.col("ord") + 1).alias("node_id"), "ord", "label", before(F.col("_t"), F.col("label")).alias("source_start"), *more)


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 12))


def evidence(spans: DataFrame, key: str, source: str, extractor: str, confidence: float) -> DataFrame:
    """spans as evidence rows: id from file, place and quote; supported where it has text."""
    return spans.withColumn("evidence_id", stable_id("ev", F.col(source), F.col("start"), F.col("end"), F.col("quote"))).withColumns({"extractor": F.lit(extractor), "confidence": F.lit(confidence), "provenance": F.lit("observed"), "supported": F.length("quote") > 0})


def verb(quote: Column, terms: Terms) -> Column:
    """The place of the last collision word, -1 where there is none."""
    return F.greatest(*(F.when(F.contains(quote, F.lit(t)), F.length(quote) - F.length(F.substring_index(quote, t, -1)) - len(t)).otherwise(-1) for t in terms.collisions))


def clauses(spans: DataFrame, key: str, terms: Terms) -> DataFrame:
    """Sentences with a collision word: number in the text and place of the last such word."""
    w = Window.partitionBy(key).orderBy("start")
    return spans.withColumn("verb", verb(F.col("quote"), terms)).where("verb >= 0").withColumn("clause", F.row_number().over(w)).withColumn("verb_start", F.col("start") + F.col("verb"))


def role(quote: Column, verb: Column, named: Column, terms: Terms) -> Column:
    """struct<agent,target> (node ids) of a clause whose particles tell them, else null; named is array<struct<node_id,label>>.

    Each entity's occurrences before the verb count: the last one that an object particle follows is the target.
    """

    def placed(e):
        size = F.length(e["label"])
        gaps = F.split(quote, F.concat(F.lit("\\Q"), e["label"], F.lit("\\E")), -1)
        stops = F.transform(F.array(gaps), lambda g: _sums(F.transform(F.slice(g, 1, F.size(g) - 1), lambda p: F.length(p) + size), F.size(g) - 1))[0]
        return F.transform(F.filter(stops, lambda stop: stop - size < verb), lambda stop: F.struct((stop - size).alias("begin"), stop.alias("stop"), e["node_id"].alias("node_id")))

    def marked(o):
        near = lambda a, p: a.rlike(f"^(?s:.{{0,{terms.reach}}}?){p}")
        after = F.array(quote.substr((o["stop"] + 1).cast("int"), (verb - o["stop"]).cast("int")))
        return F.transform(after, lambda a: F.struct(o["begin"].alias("begin"), o["node_id"].alias("node_id"), near(a, terms.object).alias("is_object"), near(a, terms.instrument).alias("is_instrument"), a.rlike(terms.subject).alias("has_subject")))[0]

    def told(parts):
        last = lambda flag: F.try_element_at(F.filter(parts, lambda o: o[flag]), F.lit(-1))["node_id"]
        first = F.try_element_at(parts, F.lit(1))
        return F.struct(F.size(F.array_distinct(F.transform(parts, lambda o: o["node_id"]))).alias("entities"), last("is_object").alias("target"), last("is_instrument").alias("agent"), first["node_id"].alias("first"), first["has_subject"].alias("subject"))

    def judged(x):
        by_particle = x["agent"].isNotNull() & (x["agent"] != x["target"])
        agent = F.when(by_particle, x["agent"]).when(x["subject"] & (x["first"] != x["target"]), x["first"])
        return F.when((x["entities"] >= 2) & x["target"].isNotNull() & agent.isNotNull(), F.struct(agent.alias("agent"), x["target"].alias("target")))

    every = F.array_sort(F.transform(F.flatten(F.transform(named, placed)), marked))
    return F.when(F.size(named) >= 2, F.transform(F.transform(F.array(every), told), judged)[0])


def roles(found: DataFrame, nodes: DataFrame, key: str, terms: Terms) -> DataFrame:
    """key, clause, agent, target (node ids) of each clause whose particles tell them; others give no row."""
    known = nodes.groupBy(key).agg(F.collect_list(F.struct("node_id", "label")).alias("_known"))
    met = found.select(key, "clause", "quote", "verb").join(known, key)
    named = F.filter("_known", lambda e: F.contains(F.col("quote"), e["label"]))
    got = met.select(key, "clause", "quote", "verb", once(_named=named)).where(F.size("_named") >= 2)
    return got.select(key, "clause", once(_role=role(F.col("quote"), F.col("verb"), F.col("_named"), terms))).where("_role is not null").select(key, "clause", "_role.agent", "_role.target")


def maneuver_list(text: Column, terms: Terms) -> Column:
    """array<struct<kind,term,start,end,quote>>: every occurrence of every maneuver term, by term and place."""
    one = lambda n, kind, term: F.transform(_found(text, "\\Q" + term + "\\E"), lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("term"), m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("quote")))
    every = [F.when(F.contains(text, F.lit(term)), one(n, kind, term)) for n, (kind, term) in enumerate(dict.fromkeys(terms.maneuvers))]
    return F.flatten(F.array_compact(F.array(*every)))


def maneuvers(df: DataFrame, key: str, text: str, terms: Terms, *more: str) -> DataFrame:
    """key, more, kind, term (its number), start, end, quote: every occurrence of every maneuver term, in one reading of the texts."""
    return df.where(F.col(text).isNotNull()).select(key, *more, F.inline(maneuver_list(F.col(text), terms)))


def span_entities(spans: DataFrame, nodes: DataFrame, key: str, *more: str) -> DataFrame:
    """key, start, quote, more, entities: the distinct entities that each sentence names."""
    met = spans.join(nodes.select(key, "node_id", "label"), key).where(F.contains(F.col("quote"), F.col("label")))
    return met.groupBy(key, "start", "quote", *more).agg(F.array_sort(F.collect_set(F.struct("node_id", "label"))).alias("entities"))


def drivers(spans: DataFrame, nodes: DataFrame, key: str, terms: Terms) -> DataFrame:
    """key, start, quote, driver, vehicle: sentences that speak of driving, name a person and exactly one vehicle."""
    return drivers_of(gated(spans, nodes, key, terms), key, terms)


def gated(spans: DataFrame, nodes: DataFrame, key: str, terms: Terms, *more: str) -> DataFrame:
    """The entities of the sentences that speak of driving."""
    return span_entities(spans.where(F.contains("quote", F.lit(terms.gate))), nodes, key, *more)


def drivers_of(own: DataFrame, key: str, terms: Terms, *more: str) -> DataFrame:
    own = own.where(F.size("entities") == 1).withColumn("driver", F.regexp_extract("quote", terms.driver, 1))
    return own.where(F.col("driver") != "").select(key, "start", "quote", *more, "driver", F.col("entities")[0]["node_id"].alias("vehicle"))


def same_as(spans: DataFrame, nodes: DataFrame, key: str, terms: Terms) -> DataFrame:
    """key, start, quote, role, model: sentences that speak of driving with exactly two vehicles, one named by role and one by model."""
    return same_of(gated(spans, nodes, key, terms), key, terms)


def pair(entities: Column, terms: Terms) -> Column:
    """struct<role,model> (node ids) where one of two entities is named by its role and one by its model, else null."""
    by_role = lambda e: F.exists(F.array(*map(F.lit, terms.roles)), lambda w: F.contains(e["label"], w))
    first, second = F.try_element_at(entities, F.lit(1)), F.try_element_at(entities, F.lit(2))
    both = lambda a, b: F.struct(a["node_id"].alias("role"), b["node_id"].alias("model"))
    return F.when(F.size(entities) == 2, F.when(by_role(first) & ~by_role(second), both(first, second)).when(by_role(second) & ~by_role(first), both(second, first)))


def same_of(own: DataFrame, key: str, terms: Terms, *more: str) -> DataFrame:
    return own.select(key, "start", "quote", *more, once(_pair=pair(F.col("entities"), terms))).where("_pair is not null").select(key, "start", "quote", *more, "_pair.role", "_pair.model")


def event_order(events: DataFrame, key: str, at: str, event: str) -> DataFrame:
    """key, source, target: each event precedes the next by (place, id as a string)."""
    w = Window.partitionBy(key).orderBy(at, event)
    return events.select(key, F.col(event).alias("source"), F.lead(event).over(w).alias("target")).where("target is not null")


def unresolved(docs: DataFrame, nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    n = nodes.groupBy(key).agg(F.count("*").alias("_n"))
    e = edges.groupBy(key).agg(F.count("*").alias("_e"))
    m = docs.select(key).join(n, key, "left").join(e, key, "left")
    return m.select(key, F.array_compact(F.array(F.when(F.coalesce("_n", F.lit(0)) < 2, F.lit("two_vehicle_entities")), F.when(F.coalesce("_e", F.lit(0)) == 0, F.lit("collision_agent")), F.when(F.coalesce("_e", F.lit(0)) == 0, F.lit("collision_target")))).alias("critical_unresolved"))


def resolved(docs: DataFrame, answers: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """key, agent, target, note: an answer stands only if it names two known, different nodes and quotes the text."""
    known = nodes.groupBy(key).agg(F.collect_set("node_id").alias("_ids"))
    m = docs.select(key, F.col(text).alias("_t")).join(answers, key, "left").join(known, key, "left")
    right = F.array_contains("_ids", F.col("agent")) & F.array_contains("_ids", F.col("target")) & (F.col("agent") != F.col("target"))
    quoted = (F.instr("_t", F.col("quote")) > 0) & (F.col("quote") != "")
    note = F.when(F.col("agent").isNull(), "no answer").when(~F.coalesce(right, F.lit(False)), "unknown or equal entities").when(~F.coalesce(quoted, F.lit(False)), "quote is not in the text")
    return m.select(key, F.when(note.isNull(), F.col("agent")).alias("agent"), F.when(note.isNull(), F.col("target")).alias("target"), note.alias("note"))


def broken_spans(ev: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Evidence whose quote is not what stands at its place."""
    return ev.join(docs.select(key, F.col(text).alias("_t")), key).where(F.col("_t").substr((F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")) != F.col("quote")).select(key, "start", "end", "quote")


def unsupported_edges(edges: DataFrame, ev: DataFrame, key: str, edge: str) -> DataFrame:
    """Observed edges that cite no supported evidence."""
    cited = edges.where("provenance = 'observed'").select(key, edge, F.explode_outer("evidence_ids").alias("evidence_id"))
    good = ev.where("supported").select(key, "evidence_id", F.lit(1).alias("_ok"))
    return cited.join(good, [key, "evidence_id"], "left").groupBy(key, edge).agg(F.max("_ok").alias("_ok")).where("_ok is null").select(key, edge)
