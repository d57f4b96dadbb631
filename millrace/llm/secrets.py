"""Secret scans with corpus-wide ownership frequency, with DataFrame functions only.

Base spans come from three fixed patterns, leftmost and non-overlapping for each kind. The
value of each span is hashed, and hashes are counted over the whole corpus by distinct
repositories and owners: a value that EXAMPLE_OWNERS owners or EXAMPLE_REPOSITORIES repositories
hold is a widely copied example, one that a single owner holds in LIVE_REPOSITORIES of its
repositories at most looks live. Two kinds are added by that evidence: ``copy``, a bare
run of characters equal to the value of a base span found anywhere in the corpus, and
``bare``, a run of mixed letters and digits that looks live.

Offsets are code points: the lengths of matches and of the pieces between them are summed
in order. Only spans and hashes are shuffled, never texts.

Defined results: a null text is empty; an empty text has no spans; repeated rows are scanned
each on its own and count as one repository; a null owner is an owner of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Fixed patterns; letters of ``assign`` words stand in either case.
WORDS = ["password", "passwd", "secret", "token", "api_?key"]
ASSIGN = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in WORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
RUN = "[A-Za-z0-9+/_.=-]{16,}"
#: kind number, name, pattern, group of the value, least length of the value
KINDS = [(0, "assign", ASSIGN, 2, 8), (1, "access", ACCESS, 0, 16), (2, "hex", HEX, 0, 32), (3, "run", RUN, 0, 16)]
BARE, EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, LIVE_REPOSITORIES = 20, 3, 6, 2


def candidates(docs: DataFrame, owner, repository) -> DataFrame:
    """row, owner, repository and, by kind, the pieces and matches of each text; one narrow pass, nothing shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(repository, F.lit("")).alias("repository"), text.alias("_t"))
    found = []
    for number, name, pattern, group, _ in KINDS:
        some = F.col("_t").rlike(pattern) & (F.col("_t").rlike("[0-9]") if number == 3 else F.lit(True))
        found.append(F.when(some, F.struct(
            F.transform(F.split(F.col("_t"), pattern, -1), lambda p: F.length(p)).alias("pieces"),
            F.transform(F.regexp_extract_all("_t", F.lit(pattern), F.lit(0)), lambda m: F.length(m)).alias("sizes"),
            F.regexp_extract_all("_t", F.lit(pattern), F.lit(group)).alias("values"),
        )).alias(name))
    return rows.select("row", "doc_id", "owner", "repository", *found)


def spans(found: DataFrame) -> DataFrame:
    """row, owner, repository, kind (its number), start, end, value: every match that is long enough."""
    out = None
    for number, name, _, _, least in KINDS:
        each = found.where(F.col(name).isNotNull()).select(
            "row", "owner", "repository", F.lit(number).alias("kind"),
            F.posexplode(F.zip_with(F.slice(F.col(f"{name}.pieces"), 1, F.size(f"{name}.values")), F.arrays_zip(f"{name}.sizes", f"{name}.values"), lambda p, m: F.struct(p.alias("piece"), m["sizes"].alias("size"), m["values"].alias("value")))),
        )
        kept = each.select("row", "owner", "repository", "kind", "pos", "col.*").withColumn("least", F.lit(least))
        out = kept if out is None else out.unionByName(kept)
    order = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = out.withColumn("end", F.sum(F.col("piece") + F.col("size")).over(order)).withColumn("start", F.col("end") - F.col("size"))
    run = (F.col("kind") < 3) | F.col("value").rlike("[0-9]")
    return placed.where((F.length("value") >= F.col("least")) & run).select("row", "owner", "repository", "kind", "start", "end", "value")


def live(field):
    return (field("owners") == 1) & (field("repositories") <= LIVE_REPOSITORIES)


def example(field):
    return (field("owners") >= EXAMPLE_OWNERS) | (field("repositories") >= EXAMPLE_REPOSITORIES)


def judged(all_spans: DataFrame) -> DataFrame:
    """Every base span, and the runs that corpus-wide ownership makes spans; owners and repositories of each value."""
    named = all_spans.withColumn("a", F.xxhash64("value")).withColumn("b", F.xxhash64(F.lit(7), F.col("value")))
    held = (
        named.groupBy("a", "b", "owner", "repository").agg(F.max((F.col("kind") < 3).cast("int")).alias("base"))
        .groupBy("a", "b").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"), F.max("base").alias("base"))
    )
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]") & (F.length("value") >= BARE)
    kind = F.when(F.col("kind") < 3, F.col("kind")).when(F.col("base") == 1, F.lit(3)).when(mixed & live(F.col), F.lit(4))
    return named.join(held, ["a", "b"]).withColumn("kind", kind).where("kind is not null").select("row", "kind", "start", "end", "owners", "repositories")


def scanned(docs: DataFrame, owner, repository) -> DataFrame:
    """A row for each row of docs: counts by kind, the digest of base spans, all spans, live and example counts."""
    found = stored(candidates(docs, owner, repository))
    each = judged(spans(found))
    # a run that meets a base span is that span's value, not another: only the neighbours in the order of starts can meet it
    is_base, sofar = F.col("kind") < 3, (Window.unboundedPreceding, 0)
    before = F.max(F.when(is_base, F.col("end"))).over(Window.partitionBy("row").orderBy("start", "kind").rowsBetween(*sofar))
    after = F.min(F.when(is_base, F.col("start"))).over(Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(*sofar))
    each = each.withColumns({"before": before, "after": after})
    each = each.where(is_base | ~F.coalesce((F.col("before") > F.col("start")) | (F.col("after") < F.col("end")), F.lit(False))).drop("before", "after")
    part = each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "owners", "repositories"))).alias("s"))
    base = F.filter("s", lambda x: x["kind"] < 3)
    parts = part.select("row", "s", base.alias("base"))
    names = F.array(*(F.lit(n) for n in ("assign", "access", "hex", "copy", "bare")))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
    count = lambda test: F.coalesce(F.size(F.filter("s", test)).cast("long"), F.lit(0).cast("long"))
    done = found.select("row", "doc_id").join(parts, "row", "left")
    return done.select(
        "doc_id", count(lambda x: x["kind"] == 0).alias("n_assign"), count(lambda x: x["kind"] == 1).alias("n_access"), count(lambda x: x["kind"] == 2).alias("n_hex"),
        F.sha2(F.coalesce(shown("base"), F.lit("")), 256).alias("base_sha256"), F.coalesce(shown("s"), F.lit("")).alias("spans"),
        count(lambda x: live(lambda c: x[c])).alias("n_live"), count(lambda x: example(lambda c: x[c])).alias("n_example"),
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    # a source owns its documents; what it holds in one language stands for a repository
    return scanned(docs, F.col("source"), F.concat_ws("/", "source", "lang"))


QUERIES = {"op10_secret_scan": op10_secret_scan}
_MATCHES = " union all ".join(
    f"""select r, doc_id, owner, repository, {number} as kind, {least} as least, unnest(regexp_extract_all(t, '{pattern.replace("'", "''")}', {group})) as value,
 unnest(list_transform(regexp_extract_all(t, '{pattern.replace("'", "''")}', 0), lambda m: length(m))) as size,
 unnest(list_transform(regexp_split_to_array(t, '{pattern.replace("'", "''")}')[1:len(regexp_extract_all(t, '{pattern.replace("'", "''")}', 0))], lambda p: length(p))) as piece,
 unnest(range(len(regexp_extract_all(t, '{pattern.replace("'", "''")}', 0)))) as pos from d"""
    for number, _, pattern, group, least in KINDS
)
SQL = {
    "op10_secret_scan": f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, coalesce(source, '') as owner, concat_ws('/', source, lang) as repository from documents),
m as ({_MATCHES}),
p as (select *, sum(piece + size) over (partition by r, kind order by pos) as stop from m),
c as (select r, owner, repository, kind, cast(stop - size as bigint) as start, cast(stop as bigint) as stop, value from p where length(value) >= least and (kind < 3 or regexp_matches(value, '[0-9]'))),
h as (select value, count(distinct owner) as owners, count(distinct repository) as repositories, max(case when kind < 3 then 1 else 0 end) as base from c group by value),
j as (select c.r, c.start, c.stop, h.owners, h.repositories, case when kind < 3 then kind when base = 1 then 3
  when length(c.value) >= {BARE} and owners = 1 and repositories <= {LIVE_REPOSITORIES} and regexp_matches(c.value, '[A-Z]') and regexp_matches(c.value, '[a-z]') then 4 end as kind from c join h on c.value = h.value),
k as (select * from j where kind < 3 or (kind > 2 and not exists (select 1 from j b where b.r = j.r and b.kind < 3 and j.start < b.stop and b.start < j.stop))),
s as (select *, list_extract(['assign', 'access', 'hex', 'copy', 'bare'], cast(kind + 1 as int)) || ':' || start || ':' || stop as shown from k),
g as (select r, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex,
  string_agg(shown, ',' order by start, kind, stop) filter (where kind < 3) as base, string_agg(shown, ',' order by start, kind, stop) as spans,
  count(*) filter (where owners = 1 and repositories <= {LIVE_REPOSITORIES}) as n_live, count(*) filter (where owners >= {EXAMPLE_OWNERS} or repositories >= {EXAMPLE_REPOSITORIES}) as n_example from s group by r)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
 coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example from d left join g on d.r = g.r"""
}
