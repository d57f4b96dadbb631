"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Texts become tokens; numbers, names (capitalised words within a sentence) and units become
typed placeholders, other words are lower-cased. Windows of W template tokens are hashed and
joined with the windows of the benchmark, so a question whose numbers, names or units were
changed still meets its original. The slots of the windows that meet on one diagonal must
then fit: one value of the benchmark stands for one value in the document, in FITTING of the
slots at least. Windows of the lower-cased words as written are joined beside them, so that a
copy is found whatever its letter case, its line breaks or its share of slots. An item counts
as leaked in a document when its windows there cover enough of it in one of both forms.

First only hashes are joined: which rows hold any window of the benchmark. Tokens, places and
slots are worked out again for those rows alone. The benchmark's hashes are sent to every task
if their counted number is within SENT_WINDOWS; beyond that the join is an ordinary one, of
longs. Items shorter than W tokens are one window of their own length. Template windows with
fewer than LITERALS words that are no slots are not keys, as any table of numbers would hold
them; as written they are. An item that is mostly slots, so that the other windows cover too
little of it, has keys from FEW_LITERALS words on.

Defined results: null or empty texts have no windows and leak nothing; an item that repeats
is reported for each of its ids; repeated rows are reported once for each doc_id and item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

WINDOW, COVERAGE, FITTING, LITERALS, FEW_LITERALS = 10, 0.5, 0.8, 0.5, 0.2
SENT_WINDOWS = 1_000_000
SENT_ROWS = 500_000

#: Units that may follow a number, and words that are numbers.
UNITS = ["%", "km", "m", "cm", "mm", "kg", "g", "mg", "l", "ml", "mi", "miles", "mile", "feet", "ft", "inches", "pounds", "lb", "hours", "hour", "minutes", "minute", "seconds", "days", "day", "weeks", "years", "dollars", "euros", "cents", "meters", "metres", "degrees", "liters", "litres", "mph", "kmh"]
# repeated groups are possessive: Java's engine then loops, where it would else recurse once for each turn
NAME = r"\p{Lu}(?<=[\p{Ll},;] \p{Lu})\p{Ll}++(?: \p{Lu}\p{Ll}++)*+"
NUMBER = r"[0-9]++(?:[.,][0-9]++)*+"
TOKEN = "[\\p{L}\\p{M}]++|\u0001[^\u0002]*\u0002|[0-9]++(?:[.,][0-9]++)*+|[\u0003%]"
#: Placeholders as they stand in a template: they are tokens that no text can hold.
IS_NAME, IS_UNIT, IS_NUMBER = "\u0001\u0002", "\u0003", "0"
SLOTS = [IS_NAME, IS_UNIT, IS_NUMBER]
FORMS = ["template", "plain"]


def _once(**columns) -> list:
    """Columns computed once for each row: Spark would else repeat a costly expression wherever it is used."""
    return [F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))).alias(*columns)]


def templates(rows: DataFrame, text: str, keep: list[str], both: bool = True) -> DataFrame:
    """keep, marked (the text with its names marked), template (its template tokens) and plain (its lower-cased words as written).

    A text without slots has one form: with ``both`` plain then repeats template, else it is empty.
    """
    t = F.col(text)
    held = F.contains(t, F.lit("\u0001")) | F.contains(t, F.lit("\u0002")) | F.contains(t, F.lit("\u0003"))
    free = F.when(held, F.translate(t, "\u0001\u0002\u0003", "   ")).otherwise(t)
    marked = rows.select(*keep, *_once(marked=F.regexp_replace(free, NAME, "\u0001$0\u0002")))
    units = r"(?<=[0-9] ?)(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![\p{L}\p{M}])"
    has_name, has_number = F.contains("marked", F.lit("\u0001")), F.col("marked").rlike("[0-9]")
    named = F.lower(F.when(has_name, F.regexp_replace("marked", "\u0001[^\u0002]*\u0002", IS_NAME)).otherwise(F.col("marked")))
    shape = F.when(has_number, F.regexp_replace(F.regexp_replace(named, units, IS_UNIT), NUMBER, IS_NUMBER)).otherwise(named)
    low = F.lower(F.translate("marked", "\u0001\u0002", ""))
    plain = F.when(has_name | has_number, F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))).when(F.col("marked").isNotNull(), F.array().cast("array<string>"))
    made = marked.select(*keep, "marked", *_once(template=F.regexp_extract_all(shape, F.lit(TOKEN), F.lit(0)), plain=plain))
    return made.withColumn("plain", F.when(F.size("plain") == 0, F.col("template")).otherwise(F.col("plain"))) if both else made


def written():
    """The tokens as written; as many as in template, so it is worked out only where slots are compared."""
    return F.regexp_extract_all("marked", F.lit(TOKEN), F.lit(0))


def windows(rows: DataFrame, lengths: dict[str, list[int]], keep: list[str]) -> DataFrame:
    """keep, form, n, tokens, at and hash: a row for each window of n tokens of each form.

    No array is made for each window or for each text: all of it is compiled into one loop over places,
    which needs functions without lambdas. tokens is the text's own array: it must not be moved with the windows.
    """
    forms = F.array(*(F.struct(F.lit(f).alias("form"), F.lit(n).alias("n"), F.col(f).alias("tokens")) for f in FORMS for n in lengths.get(f, [])))
    each = rows.select(*keep, F.inline(forms)).where(F.size("tokens") >= F.col("n"))
    placed = each.select("*", F.explode(F.sequence(F.lit(0), F.size("tokens") - F.col("n"))).alias("at"))
    return placed.withColumn("hash", F.xxhash64(at_window("tokens")))


def at_window(tokens: str):
    """The tokens of a row of windows, or what stands at their places in an array beside them."""
    return F.slice(tokens, F.col("at") + 1, F.col("n"))


def literals(form: str, n: int, window: int, coverage: float):
    """The words that a template window of an item must hold to be a key.

    LITERALS of it, unless such windows cover too little of the item for it ever to be found:
    then FEW_LITERALS of a whole window (an item below a window's length keeps the first rule).
    """
    if n < window:
        return F.lit(LITERALS * n)
    words = lambda p: F.size(F.filter(F.slice(form, p + 1, n), lambda x: ~x.isin(SLOTS)))
    rich = F.filter(F.sequence(F.lit(0), F.size(form) - n), lambda p: words(p) >= LITERALS * n)
    covered = F.size(F.array_distinct(F.flatten(F.transform(rich, lambda p: F.sequence(p, p + n - 1)))))
    return F.when(covered < coverage * F.size(form), FEW_LITERALS * n).otherwise(LITERALS * n)


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """row (a hash of doc_id and text), doc_id, item_id, covered (0 to 1), n_slots: the items found in each document."""
    items = stored(templates(benchmark.where("text is not null"), "text", ["item_id"]))
    # at most ``window`` different lengths of each form, whatever the size of the benchmark
    lengths = {f: sorted(r[0] for r in items.where(F.size(f) > 0).select(F.least(F.size(f), F.lit(window))).distinct().collect()) for f in FORMS}
    if not any(lengths.values()):
        return docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id").where("false").join(benchmark.select("item_id").where("false")).withColumns({"covered": F.lit(0.0), "n_slots": F.lit(0).cast("long")})
    least = {k: F.when(F.size("template") >= k, literals("template", k, window, coverage)).alias(f"least_{k}") for k in lengths["template"]}
    own = windows(items.select("item_id", *FORMS, written().alias("written"), *least.values()), lengths, ["item_id", "written", *(f"least_{k}" for k in least)])
    own = own.where(F.when(F.col("n") < window, F.size("tokens") == F.col("n")).otherwise(F.size("tokens") >= F.col("n")))
    of_template = F.col("form") == "template"
    own = own.select("item_id", "hash", F.col("at").alias("item_at"), "form", "n", F.size("tokens").alias("item_size"), at_window("tokens").alias("item_form"), F.when(of_template, at_window("written")).otherwise(at_window("tokens")).alias("item_tokens"), *(f"least_{k}" for k in least))
    enough = F.lit(True)
    for k in least:
        enough = F.when(of_template & (F.col("n") == k), F.size(F.filter("item_form", lambda x: ~x.isin(SLOTS))) >= F.col(f"least_{k}")).otherwise(enough)
    keys = stored(own.where(enough).drop(*(f"least_{k}" for k in least)))
    hashes = keys.select("hash").distinct()
    few = hashes.count() <= SENT_WINDOWS

    rows = docs.select("doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    # both forms hash alike, so a text without slots is read once, in the lengths of both
    first = {"template": sorted({n for f in FORMS for n in lengths[f]}), "plain": lengths["plain"]}
    each = windows(templates(rows, "text", ["row"], both=False), first, ["row"]).select("row", "hash")
    hit = stored(each.join(F.broadcast(hashes) if few else hashes, "hash", "left_semi").select("row").distinct())  # at most SENT_WINDOWS longs
    some = hit if hit.count() > SENT_ROWS else F.broadcast(hit)  # at most SENT_ROWS longs
    own = ["row", "doc_id"]
    again = templates(rows.join(some, "row", "left_semi"), "text", own)
    again = again.select(*own, *FORMS, *_once(written=written()))
    met = windows(again, lengths, [*own, "written"])
    met = met.select(*own, "form", "n", "at", "hash", at_window("tokens").alias("window"), F.when(F.col("form") == "template", at_window("written")).alias("now"))
    mine = keys.withColumnsRenamed({"form": "item_of", "n": "item_n"})
    met = met.join(F.broadcast(mine) if few else mine, "hash").where((F.col("form") == F.col("item_of")) & (F.col("n") == F.col("item_n")) & (F.col("window") == F.col("item_form")))
    slots = F.arrays_zip(F.col("item_form").alias("kind"), F.col("item_tokens").alias("was"), F.coalesce("now", "item_tokens").alias("now"))
    slots = F.filter(slots, lambda s: (F.col("form") == "template") & s["kind"].isin(SLOTS))
    found = met.select(*own, "item_id", "item_at", "item_size", "form", (F.col("at") - F.col("item_at")).alias("diagonal"), "n", slots.alias("slots"))
    # every set below is bounded by the length of one benchmark item
    lines = found.groupBy("row", "doc_id", "item_id", "form", "diagonal").agg(F.collect_set("item_at").alias("places"), F.first("n").alias("n"), F.first("item_size").alias("item_size"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    was = F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["was"])))
    fitting = lines.withColumn("n_was", F.size(was)).where((F.size("slots") == 0) | (F.col("n_was") >= FITTING * F.size("slots")))
    covered = F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("n") - 1)))
    return (
        fitting.select("row", "doc_id", "item_id", "form", "item_size", "n_was", covered.alias("covered"))
        .groupBy("row", "doc_id", "item_id", "form").agg(F.first("item_size").alias("item_size"), F.size(F.array_distinct(F.flatten(F.collect_set("covered")))).alias("c"), F.max("n_was").cast("long").alias("n_slots"))
        .withColumn("covered", F.col("c") / F.col("item_size")).where(F.col("covered") >= coverage)
        .groupBy("row", "doc_id", "item_id").agg(F.max("covered").alias("covered"), F.max("n_slots").alias("n_slots"))
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.groupBy("doc_id", "item_id").agg(F.round(F.max("covered"), 6).alias("covered"), F.max("n_slots").alias("n_slots"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs in which no benchmark item leaks, with all their columns.

    Rows with a null or empty text stay; of repeated rows all stay or go; an empty benchmark or table removes nothing.
    """
    found = stored(leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).select("row").distinct())
    if found.count() <= SENT_ROWS:
        found = F.broadcast(found)  # at most SENT_ROWS longs
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64("doc_id", "text").alias("row"))  # columns may carry any name
    return packed.join(found, "row", "left_anti").select(*(F.col("doc")[c].alias(c) for c in docs.columns))


QUERIES = {"op7_decontamination": op7_decontamination}
SQL: dict[str, str] = {}
