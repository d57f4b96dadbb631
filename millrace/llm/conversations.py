"""Conversation structure repair by a parallel Viterbi search whose chunks converge in rank.

A conversation is damaged by the hash of each row's key, and then repaired at least cost: rows
are kept, given another role or deleted, and empty turns are inserted, until the roles read
``(s?(ua)+)?``. The search has four states: nothing yet, after the system turn, after a user
turn, after an assistant turn. It runs backwards over chunks of at most CHUNK rows, one code
letter a row. The last chunk starts from the true end, every other from a speculative cost
vector; fix-up passes rerun a chunk from what its successor found, until both runs differ by
a constant alone, and end when no chunk's start has changed but for a constant. Rows that keep
the vectors apart (a long stretch of user turns does) need as many passes as chunks, so after
FIXES passes the chunks that are left are carried over by min-plus matrices, doubled in reach.
The backward costs, stitched, then say in each state which edit is the least in ASCII order
among the cheapest; a chunk's trace is found for each state it may be entered in, and the
states that it is entered in by doubling again. A conversation of one chunk takes neither.

Rows are numbered by a range-partitioned sort, equal ones counted first, so that one
conversation may hold any share of the rows. Only the digest of a whole repaired conversation
and its audit are made in one task, as the stream of its rows that they are.

Defined results: rows of equal turn come by role and text, in byte order; repeated rows are
rows, the later ones duplicates; a null turn comes first and counts in no gap; a null role or
text is one space, as is a null id within the key of the damage; a null conv_id is a
conversation of its own; a role that is empty, or begins with no s, u or a, cannot be kept.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, stored, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Bits of a row's place within its chunk, and fix-up passes before matrices take over.
BITS, FIXES = 12, 4
START, SYSTEM, USER, ASSISTANT = range(4)
INSERTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
ZEROS, END = (0.0, 0.0, 0.0, 0.0), (0.0, 2.0 * INSERT, 1.0 * INSERT, 0.0)
NEVER = float("inf")
BLANKS = " \t\n\x0b\x0c\r"
#: Codes of a row: s, u, a or x (any other role); upper case if truncated; 1, 2, 3, 0 if it must be deleted.
MUST = {"1": "s", "2": "u", "3": "a", "0": "x"}
LEGAL = ("su", "ua", "au")


# -- the rows after damage -----------------------------------------------------------------------
def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n, the number of times that the row stands there."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    each = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return each.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("n"))


def placed(rows: DataFrame) -> DataFrame:
    """Different rows with their number n and their place ``at``, which grows with conv_id, turn, role and text; the first code letter of each."""
    keys = ["conv_id", "turn", "role"]
    counted = rows.groupBy(*keys, "text").agg(F.sum("n").alias("n"))
    tail = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    first = F.substring("role", 1, 1)
    flagged = counted.withColumns({
        "blank": tail == "", "truncated": ~tail.isin("", ".", "!", "?"), "initial": F.when(first.isin("s", "u", "a"), first).otherwise("x"),
        "d1": F.xxhash64("text"), "d2": F.xxhash64(F.lit(7), "text", F.lit(11)),
    })
    # the bounds are drawn from beginnings of texts, so that a sample of them stays small
    dealt = flagged.repartitionByRange(partitions(rows.sparkSession), *keys, F.substring("text", 1, 200))
    return stored(dealt.sortWithinPartitions(*keys, "text").withColumn("at", F.monotonically_increasing_id()))


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, at, n, blank, truncated, fresh (the first of its role and text), and code: a letter for each of the n rows."""
    fresh = rows.where("not blank").groupBy("conv_id", "role", "d1", "d2").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("fresh"))
    met = rows.select("conv_id", "at", "n", "initial", "blank", "truncated").join(fresh, "at", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    must = F.translate("initial", "suax", "1230")
    code = F.when(F.col("truncated"), F.upper("initial")).otherwise(F.col("initial"))
    return met.withColumn("code", F.when(F.col("fresh"), F.concat(code, F.repeat(must, F.col("n").cast("int") - 1))).otherwise(F.repeat(must, F.col("n").cast("int"))))


def chunked(codes: DataFrame) -> DataFrame:
    """conv_id, k (from 1), last, chunk and codes: at most 2 ** BITS different rows each."""
    chunk = F.shiftright("at", BITS)
    found = codes.groupBy("conv_id", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("rows"))
    order = Window.partitionBy("conv_id").orderBy("chunk")
    return found.select(
        "conv_id", "chunk", F.row_number().over(order).alias("k"), F.lead("chunk").over(order).isNull().alias("last"), F.array_join("rows.code", "").alias("codes")
    )


# -- one row of the search -----------------------------------------------------------------------
@lru_cache(maxsize=1 << 14)
def step(code: str, after: tuple) -> tuple:
    """The costs before a row from those after it, as a vector from 0 up and what was taken off, and each state's least edits here.

    An edit: audit letters, acts (lower case: inserted turns; K, U, A or D: the row's own), state after it, cost.
    """
    initial, late = MUST.get(code, code.lower()), TRUNCATED * code.isupper()
    own = []
    for s in range(4):
        choice = [("D", "D", s, DELETE)]
        if code not in MUST:
            asks = ASSISTANT if s == USER else USER
            goes = SYSTEM if initial == "s" and s == START else asks if initial == "ua"[asks == ASSISTANT] else None
            if goes is not None:
                choice.append(("K", "K", goes, KEEP + late))
            choice.append(("R", "UA"[asks == ASSISTANT], asks, REROLE + late))
        own.append(choice)
    cost = [min(c + after[t] for _, _, t, c in own[s]) for s in range(4)]
    cost[USER], cost[ASSISTANT] = min(cost[USER], INSERT + cost[ASSISTANT]), min(cost[ASSISTANT], INSERT + cost[USER])
    cost[START], cost[SYSTEM] = min(cost[START], INSERT + cost[USER]), min(cost[SYSTEM], INSERT + cost[USER])
    moves = []
    for s in range(4):
        audit, acts, spent, at = "", "", 0, s
        while cost[s] < NEVER:
            choice = [*own[at], ("I", "", INSERTED[at], INSERT)]
            letter, act, to, c = min(x for x in choice if x[3] + (cost if x[0] == "I" else after)[x[2]] == cost[at])
            audit, acts, spent, at = audit + letter, acts + (act or "ua"[to == ASSISTANT]), spent + c, to
            if letter != "I":
                break
        moves.append((audit, acts, at, spent))
    least = min(cost)
    return tuple(c - least for c in cost), least, tuple(moves)


def level(vector) -> tuple:
    least = min(vector)
    return tuple(float(c - least) for c in vector)


def backward(codes: str, after) -> tuple:
    """The level costs before a chunk."""
    vector = level(after)
    for code in reversed(codes):
        vector = step(code, vector)[0]
    return vector


def mended(codes: str, old, new, found) -> tuple:
    """backward(codes, new) where backward(codes, old) has ``found``: it stops where both differ by a constant."""
    old, new = level(old), level(new)
    for code in reversed(codes):
        if old == new:
            return tuple(found)
        old, new = step(code, old)[0], step(code, new)[0]
    return new


def matrix(codes: str) -> list[float]:
    """Costs from each state before the chunk (rows) to each state after it."""
    columns = []
    for t in range(4):
        vector, taken = tuple(0.0 if s == t else NEVER for s in range(4)), 0.0
        for code in reversed(codes):
            vector, least, _ = step(code, vector)
            taken += least
        columns.append([c + taken for c in vector])
    return [columns[t][s] for s in range(4) for t in range(4)]


def traced(codes: str, after, last: bool, entries) -> list[tuple]:
    """For each state of entry: audit, acts (one string a row, and one for what ends the conversation), state at the end, cost."""
    vector, steps = level(after), []
    for code in reversed(codes):
        vector, _, moves = step(code, vector)
        steps.append(moves)
    out = []
    for state in entries:
        audit, acts, cost = [], [], 0
        for moves in reversed(steps):
            letters, act, state, spent = moves[state]
            audit.append(letters)
            acts.append(act)
            cost += spent
        tail = {SYSTEM: "ua", USER: "a"}.get(state, "") if last else ""
        out.append(("".join(audit) + "I" * len(tail), [*acts, tail], state, cost + INSERT * len(tail)))
    return out


# -- stitching -----------------------------------------------------------------------------------
def _each(f, kind: str):
    """A function of columns that runs row by row over Arrow batches."""
    return F.pandas_udf(lambda *columns: pd.Series([f(*row) for row in zip(*columns, strict=True)]), kind)


def _scanned(df: DataFrame, value: str, combine, toward: int) -> DataFrame:
    """Each k's value combined with those of all later (toward 1) or earlier (-1) chunks, in reach doubled each time."""
    most, reach = df.agg(F.max("k")).first()[0] or 0, 1
    while reach < most:
        other = df.select(F.col("conv_id").alias("_c"), (F.col("k") - toward * reach).alias("_k"), F.col(value).alias("_v"))
        both = df.join(other, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("k") == F.col("_k")), "left")
        df = stored(both.withColumn(value, F.when(F.col("_k").isNull(), F.col(value)).otherwise(combine(F.col(value), F.col("_v")))).drop("_c", "_k", "_v"))
        reach *= 2
    return df


def _times(a: Column, b: Column) -> Column:
    """Min-plus product of two matrices of 16 costs."""
    return F.array(*(F.array_min(F.array(*(a[4 * s + m] + b[4 * m + t] for m in range(4)))) for s in range(4) for t in range(4)))


def stitched(chunks: DataFrame, fixes: int = FIXES) -> DataFrame:
    """chunks with ``after``: the costs after each chunk, but for a constant."""
    vector = "array<double>"
    end, zeros = F.array(*map(F.lit, END)), F.array(*map(F.lit, ZEROS))
    now = chunks.withColumn("after", F.when(F.col("last"), end).otherwise(zeros))
    if chunks.where("not last").isEmpty():
        return now
    now = stored(now.withColumn("found", _each(backward, vector)("codes", "after")))
    for _ in range(fixes):
        told = now.select(F.col("conv_id").alias("_c"), (F.col("k") - 1).alias("_k"), F.col("found").alias("told"))
        met = now.join(told, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("k") == F.col("_k")), "left").drop("_c", "_k")
        changed = ~F.col("last") & (F.col("told") != F.col("after"))
        rerun = F.when(changed, _each(lambda c, o, n, f, go: mended(c, o, n, f) if go else f, vector)("codes", "after", F.coalesce("told", "after"), "found", changed))
        now = stored(met.withColumn("changed", changed).withColumn("found", F.coalesce(rerun, "found")).withColumn("after", F.when(F.col("changed"), F.col("told")).otherwise(F.col("after"))).drop("told"))
        if now.where("changed").isEmpty():
            return now.drop("found", "changed")
    reach = _scanned(now.select("conv_id", "k", _each(matrix, vector)("codes").alias("m")), "m", _times, 1)
    m = F.col("m")
    before = F.array(*(F.array_min(F.array(*(m[4 * s + t] + F.lit(END[t]) for t in range(4)))) for s in range(4)))
    told = reach.select(F.col("conv_id").alias("_c"), (F.col("k") - 1).alias("_k"), before.alias("told"))
    met = now.join(told, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("k") == F.col("_k")), "left")
    return met.withColumn("after", F.when(F.col("last"), F.col("after")).otherwise(F.col("told"))).drop("_c", "_k", "told", "found", "changed")


def edited(chunks: DataFrame) -> DataFrame:
    """conv_id, chunk, codes, audit, acts and cost of each chunk of ``stitched``."""
    kind = "array<struct<audit:string,acts:array<string>,state:int,cost:long>>"
    trace = _each(lambda codes, after, last, k: [dict(zip(("audit", "acts", "state", "cost"), x, strict=True)) for x in traced(codes, after, last, [START] if k == 1 else range(4))], kind)
    done = stored(chunks.withColumn("ways", trace("codes", "after", "last", "k")))
    way = F.col("ways")[0]
    out = ["conv_id", "chunk", "codes"]
    if done.where("k > 1").isEmpty():
        return done.select(*out, way["audit"].alias("audit"), way["acts"].alias("acts"), way["cost"].alias("cost"))
    exits = F.when(F.col("k") == 1, F.array_repeat(way["state"], 4)).otherwise(F.col("ways.state"))
    led = _scanned(done.where("not last or k > 1").select("conv_id", "k", exits.alias("exits")), "exits", lambda mine, past: F.transform(past, lambda s: F.element_at(mine, s + 1)), -1)
    led = led.select(F.col("conv_id").alias("_c"), (F.col("k") + 1).alias("_k"), F.col("exits")[0].alias("state"))
    met = done.join(led, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("k") == F.col("_k")), "left")
    way = F.col("ways")[F.when(F.col("k") == 1, 0).otherwise(F.col("state"))]
    return met.select(*out, way["audit"].alias("audit"), way["acts"].alias("acts"), way["cost"].alias("cost"))


# -- the repaired conversations ------------------------------------------------------------------
def _told(batches):
    """Streams of a conversation's chunks, each before its rows: its audit, cost, illegal neighbours and the digest of what it reads after repair."""
    names = ["conv_id", "audit", "cost", "illegal", "repaired_sha256"]
    open_, done = None, []

    class Conversation:
        def __init__(self, conv_id):
            self.conv_id, self.audit, self.cost, self.illegal, self.sha, self.before, self.any = conv_id, [], 0, 0, hashlib.sha256(), "", False
            self.acts, self.at, self.tail = [], 0, ""

        def says(self, role, text=""):
            self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.any = True

        def inserts(self, letters):
            for x in letters:
                self.says("user" if x == "u" else "assistant")

        def chunk(self, codes, audit, acts, cost):
            self.inserts(self.tail)
            self.audit.append(audit)
            self.cost += cost
            initials = self.before + codes.lower().translate(PLAIN)
            self.illegal += sum(x + y not in LEGAL for x, y in zip(initials, initials[1:], strict=False))
            self.before, self.acts, self.at, self.tail = initials[-1:], acts, 0, acts[-1]

        def row(self, n, role, text):
            act = self.acts[self.at]
            self.at += n
            self.inserts(act[:-1])
            if act[-1] != "D":
                self.says({"U": "user", "A": "assistant"}.get(act[-1], role), text)

        def closes(self):
            self.inserts(self.tail)
            return (self.conv_id, "".join(self.audit), self.cost, self.illegal, self.sha.hexdigest())

    def flushed():
        columns = zip(*done, strict=True)
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (1, 4) else pa.int64() if k else kind) for k, c in enumerate(columns)], names=names)
        done.clear()
        return out

    for b in batches:
        kind = b.schema.field("conv_id").type
        for at in range(0, b.num_rows, 256):
            for r in b.slice(at, 256).to_pylist():
                if open_ is None or r["conv_id"] != open_.conv_id:
                    if open_ is not None:
                        done.append(open_.closes())
                    open_ = Conversation(r["conv_id"])
                if r["acts"] is not None:
                    open_.chunk(r["codes"], r["audit"], r["acts"], r["cost"])
                else:
                    open_.row(r["n"], r["role"], r["text"])
            if len(done) >= 1000:
                yield flushed()
    if open_ is not None:
        done.append(open_.closes())
        yield flushed()


PLAIN = str.maketrans("1230", "suax")


def repaired(rows: DataFrame, fixes: int = FIXES) -> DataFrame:
    """A row for each conv_id of rows: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    ids = rows.select("conv_id").distinct()
    there = placed(damaged(rows))
    codes = stored(coded(there))
    edits = stored(edited(stitched(stored(chunked(codes)), fixes)))
    heads = edits.select("conv_id", F.shiftleft("chunk", BITS).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "codes", "audit", "acts", "cost")
    bodies = there.select("conv_id", "at", F.lit(1).alias("kind"), "n", "role", "text")
    stream = heads.unionByName(bodies, allowMissingColumns=True).repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "at", "kind")
    told = stream.mapInArrow(_told, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, audit string, cost long, illegal long, repaired_sha256 string")
    turns = there.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    faults = codes.groupBy("conv_id").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - F.col("fresh").cast("int"))).alias("duplicate"),
        F.count_if(F.col("fresh") & F.col("truncated")).alias("truncated"),
    )
    out = ids
    for part in (turns, faults, told):
        out = out.join(part.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
SQL: dict[str, str] = {}
