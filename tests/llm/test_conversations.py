"""Conversation repair beside a brute-force search over all edits, on random, awkward and very long conversations."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from millrace.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, at long, kind string, code string"
SPACES = re.compile(r"[^\x20\x09-\x0D]")


def brute(rows):
    """Results by conv_id: Dijkstra over (rows taken, state) with the audit as tie-break."""
    by = {}
    for cid, turn, role, text in rows:
        by.setdefault(cid, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if cid is None else cid}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        by[cid] += [(turn, "user" if fate == 4 else role, text)] * (1 + (fate == 3))
    out = {}
    for cid, found in by.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in found if t is not None]
        faults, seen = [], set()
        for _, role, text in found:
            marks = SPACES.findall(text)
            faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in found]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        heap, done = [(0, "", 0, 0, ())], set()
        while True:
            cost, audit, i, s, said = heapq.heappop(heap)
            if i == len(found) and s in (0, 3):
                break
            if (i, s) in done:
                continue
            done.add((i, s))
            need = 3 if s == 2 else 2
            heapq.heappush(heap, (cost + 3, audit + "I", i, need, (*said, ("user" if need == 2 else "assistant") + ":")))
            if i < len(found):
                _, role, text = found[i]
                heapq.heappush(heap, (cost + 4, audit + "D", i + 1, s, said))
                if faults[i] not in ("blank", "duplicate"):
                    late = 3 * (faults[i] == "truncated")
                    to = 1 if role[:1] == "s" and s == 0 else need if role[:1] == "ua"[need - 2] else None
                    if to:
                        heapq.heappush(heap, (cost + late, audit + "K", i + 1, to, (*said, f"{role}:{text}")))
                    heapq.heappush(heap, (cost + late + 3, audit + "R", i + 1, need, (*said, f"{'user' if need == 2 else 'assistant'}:{text}")))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[cid] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "k", "c") for r in rows], SCHEMA)
    got = {r["conv_id"]: tuple(r)[1:] for r in c.repaired(df, **more).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    assert got == brute(rows)


ROLES = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "superb", "User"]
TEXTS = ["Yes.", "No!", "cut off", "", " \t\n", None, "why?  ", "...", "a. b", "é。", "x" * 3000, "same."]


def random_rows(seed, conversations, turns):
    rnd = random.Random(seed)
    return [(cid if cid % 11 else None, None if rnd.random() < 0.05 else t + (rnd.random() < 0.1), rnd.choice(ROLES), rnd.choice(TEXTS) if rnd.random() < 0.4 else f"text {rnd.random()}" + rnd.choice(["", ".", "!"])) for cid in range(conversations) for t in range(rnd.randrange(turns))]


def test_repair_against_brute_force(spark):
    rows = random_rows(1, 150, 12)
    check(spark, rows + rows[:20])


def test_repair_of_given_conversations(spark):
    got = {r["conv_id"]: tuple(r) for r in c.op11_conversation_repair(spark, "/root/testdata/sf0.001").collect()}
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {k: v[1:] for k, v in got.items()} == brute(rows)


@pytest.mark.parametrize(("kind", "fixes"), [("mixed", 4), ("mixed", 0), ("users", 1), ("duplicates", 4)])
def test_chunks_stitch(spark, monkeypatch, kind, fixes):
    """Small chunks: converging ones, a run of user turns, which never converges, and one of rows that must go."""
    monkeypatch.setattr(c, "BITS", 3)
    rnd = random.Random(3)
    if kind == "mixed":
        rows = random_rows(5, 12, 70)
    else:
        rows = [(cid, t, "user" if rnd.random() < 0.97 else "system", f"{t}." if kind == "users" else "same") for cid in range(3) for t in range(90)]
    check(spark, rows, fixes=fixes)


def test_vectors_stop_where_they_differ_by_a_constant():
    rnd = random.Random(4)
    for _ in range(300):
        codes = "".join(rnd.choice("suaxSUAX1230uuu") for _ in range(rnd.randrange(1, 15)))
        old, new = ([float(rnd.randrange(4)) for _ in range(4)] for _ in range(2))
        assert c.mended(codes, old, new, c.backward(codes, old)) == c.backward(codes, new)
        m, closed = c.matrix(codes), c.step("1", tuple(new))[0]
        assert c.level([min(m[4 * s + t] + closed[t] for t in range(4)) for s in range(4)]) == c.backward(codes, closed)


def test_awkward_tables(spark):
    check(spark, [])
    check(spark, [(1, None, None, None), (1, None, None, None), (None, 3, "user", "long " * 400_000), (2, 5, "assistant", "only.")] + [(7, 1, "user", "again.")] * 300)
