"""The text operators beside brute-force versions, on planted and random rows and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, decontamination, html_extraction, line_dedup, ngram_join, pseudonyms, quality_compression, quality_rules, secrets, sharding

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, row string, node string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts, ids=None):
    """A documents table with extra columns whose names clash with what the operators use."""
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 7 else None, len(t or ""), 0.5, "k", "r", "n") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


AWKWARD = [None, "", " \n\t ", "one", "a b", "x" * 5000, "same text here twice " * 40, "same text here twice " * 40, "ünïcödé 北京 👍 \u0001 \x1c", "\n".join(["line"] * 50)]


# -- 9 -------------------------------------------------------------------------------------------
def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    hits = defaultdict(list)
    for i in range(len(words) - 4):
        hits[tuple(words[i:i + 5])].append(i)
    covered = {j for v in hits.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


def test_quality_base(spark):
    random.seed(1)
    texts = AWKWARD + [" ".join(random.choice("ab cd ef\n # x!".split(" ")) for _ in range(random.randrange(60))) for _ in range(60)]
    got = {r["doc_id"]: r for r in quality_rules.judged(table(spark, texts), spark.createDataFrame([], "doc_id long, quality int"), ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        want = brute_base(t)
        assert [got[i][c] for c in quality_rules.BASE] == want, t
        assert got[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_quality_verdicts_on_rows_not_fitted(spark):
    sf = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    d = quality_rules.judged(spark.read.parquet(f"{sf}/documents.parquet"), labels.where(~held), ["doc_id"]).join(labels.where(held), "doc_id").toPandas()
    d = d[~d["base_failed"]]
    assert len(d) > 50 and (d["kept"] == (d["quality"] == 1)).mean() > 0.95


def test_trees_are_monotone():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] + 0.3 * rng.random(600)) < 0.6).astype(float)
    trees = quality_rules.grow(x, y, [-1, 0, 0], trees=20)
    line = np.repeat(x[:1], 50, axis=0)
    for k in range(5):
        line[:, 1:] = x[k, 1:]
        line[:, 0] = np.linspace(0, 1, 50)
        assert (np.diff(trees.score(line)) <= 1e-12).all()


def test_quality_stage_keeps_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = table(spark, [*AWKWARD, "a clean text of more than ten different words that nobody would reject here"])
    out = quality_rules.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and [r["doc_id"] for r in out.collect()] == [10]


# -- 6 -------------------------------------------------------------------------------------------
def test_line_dedup(spark):
    texts = [f"menu home\nown line {i}\n\nown line {i}" for i in range(30)] + [None, "", "menu home"]
    rows = [(i, t, "h" if i < 31 else None) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_dedup.without_boilerplate(d, "source", "text").select("doc_id", F.array_join("_kept", "\n").alias("t"), "_n_dropped").collect()}
    assert got[3]["t"] == "own line 3\n\nown line 3" and got[3]["_n_dropped"] == 1
    assert got[30]["t"] is None and got[31]["t"] == "" and got[32]["t"] == "menu home"


def test_line_dedup_ways_agree(spark):
    """Sent lists and the salted join give the same rows; small hosts keep lines unless asked."""
    texts = [f"menu\nline {i}" for i in range(40)] + AWKWARD
    d = table(spark, texts)
    rows = lambda **k: sorted((r["doc_id"], r["t"]) for r in line_dedup.without_boilerplate(d, "source", "text", **k).select("doc_id", F.array_join("_kept", "\n").alias("t")).collect() if r["t"] is not None)
    assert rows() == rows(sent_lines=0) and all("menu" not in t for i, t in rows() if i < 40)
    few = spark.createDataFrame([(i, "same\n" + str(i), "h") for i in range(3)], "doc_id long, text string, source string")
    left = lambda **k: {r["t"] for r in line_dedup.without_boilerplate(few, "source", "text", **k).select(F.array_join("_kept", "\n").alias("t")).collect()}
    assert "same\n0" in left() and left(min_pages=1, ratio=0.5) == {"0", "1", "2"}


# -- 5 -------------------------------------------------------------------------------------------
def brute_components(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    both = defaultdict(int)
    for v in where.values():
        for a in range(len(v)):
            for b in range(a):
                both[v[b], v[a]] += 1
    for (a, b), o in both.items():
        if den * o >= num * (len(sets[a]) + len(sets[b]) - o):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def near_copies(seed, groups, most, words=(8, 120)):
    random.seed(seed)
    docs = []
    for _ in range(groups):
        base = [random.choice("abcdefghijklmnopqrstuvwxyz") + random.choice("aeiou") for _ in range(random.randrange(*words))]
        docs.append(base)
        for _ in range(random.randrange(most)):
            w = list(base)
            for _ in range(random.randrange(6)):
                w[random.randrange(len(w))] = random.choice(["Q", "zz", "the"])
            docs.append(w)
    random.shuffle(docs)
    return [" ".join(d) for d in docs]


@pytest.mark.parametrize(("n", "num", "block"), [(3, 90, 3000), (5, 80, 3000), (3, 70, 4)])
def test_ngram_components(spark, n, num, block):
    texts = AWKWARD + near_copies(n * num, 25, 9)
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    rows.append(rows[20])  # a repeated row
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), n, num, 100, block=block, sent_rows=10_000 if n == 3 else 0)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows, n, num, 100)


def test_ngram_on_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = sorted(tuple(r) for r in ngram_join.op5_ngram_join(spark, SF).collect())
    assert got == brute_components([tuple(r) for r in d.collect()], 3, 90, 100)


def grown(text, steps):
    """Texts in which each begins with the one before, and so do their sets as sorted lists: every new hash comes last."""
    out = [text]
    for _ in range(steps):
        had, good, k = ngram_join.shingles(out[-1], 3), [], 0
        while k < 300 or not good:  # the least of many, so that there is room for the next ones
            got = ngram_join.shingles(f"{out[-1]} w{k}", 3)
            if len(got) == len(had) + 1 and got[-1] != had[-1]:
                good.append((int(got[-1]), k))
            k += 1
        out.append(f"{out[-1]} w{min(good)[1]}")
    return out


def some_words(seed, n):
    return " ".join(f"v{seed}x{k}" for k in range(n))


@pytest.mark.parametrize("seed", range(6))
def test_tree_finds_prefixes(seed):
    """Single probes against brute force: no set is lost as a target, though others begin with it."""
    rule = ngram_join.Rule(3, 90, 100)
    sets = [ngram_join.shingles(t, 3) for k in range(3) for t in grown(some_words(10 * seed + k, 16 + seed), 4)]
    random.Random(seed).shuffle(sets)
    both = lambda a, b: len(set(a.tolist()) & set(b.tolist()))
    for i, a in enumerate(sets):
        want = {j for j, b in enumerate(sets) if j != i and both(a, b) * 100 >= 90 * (len(a) + len(b) - both(a, b))}
        assert want and {j for _, j in ngram_join.tree_links(sets, [i], rule)} == want


def test_ngram_prefix_chains(spark):
    """Two prefixes of other sets, linked only to each other; and chains dealt in small blocks."""
    texts = [t for k in (100, 101) for t in grown(some_words(k, 22), 4)]
    for k in (0, 1):  # 20 shingles, 19 of them in both; the longer ones have 24, too many for a link
        for end in ("this", "that"):
            texts += [(chain := grown(f"{some_words(100 + k, 21)} {end}", 4))[0], chain[4]]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100, block=3)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows, 3, 90, 100)


def test_keys_meet_every_link():
    for rule in (ngram_join.Rule(3, 90, 100), ngram_join.Rule(5, 80, 100), ngram_join.Rule(2, 60, 100)):
        sets = [ngram_join.shingles(t, rule.n) for t in near_copies(7, 20, 10, (12, 300))]
        sets = list({s.tobytes(): s for s in sets}.values())
        keys = [set(rule.keys(s).tolist()) for s in sets]
        for i in range(len(sets)):
            for j in range(i):
                o = len(set(sets[i]) & set(sets[j]))
                if rule.den * o >= rule.num * (len(sets[i]) + len(sets[j]) - o):
                    assert keys[i] & keys[j]


def test_ngram_stage(spark):
    texts = ["w1 w2 w3 w4 w5 w6 w7 w8"] * 3 + ["other words stand here alone now ok"] + [None, ""]
    out = ngram_join.stage(spark, table(spark, texts, [5, 3, 3, 9, 1, 2]), "")
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 3, 9]


# -- 7 -------------------------------------------------------------------------------------------
ITEM = "a train leaves Boston at 30 km per hour and John Smith waits for 12 minutes near the old red house today"


def test_decontamination(spark):
    changed = ITEM.replace("Boston", "Paris").replace("30", "45").replace("John Smith", "Mary Jones").replace("12", "9")
    mixed = " ".join([ITEM.replace("30", str(k)).split(" ")[k] for k in range(len(ITEM.split()))])
    texts = [f"We say: {ITEM} ok", f"Well, {changed}.", "nothing of that kind is written in this text at all, really not one bit", ITEM[:40], None, "", mixed.upper()]
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (10, "tiny one")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(table(spark, texts), bench).collect()}
    assert {(0, 7), (1, 7)} <= got and not {d for d, _ in got} & {2, 4, 5}


def test_verbatim_items_of_slots_and_other_case(spark):
    """What the templates cannot hold is found as written: tables of numbers, names, other case, other line breaks."""
    numbers = " ".join(str(k * k + 3) for k in range(30))
    names = "Anna Bauer, Carl Denk, Emil Frey, Gina Hahn, Ines Jung, Kurt Lang, Maja Noll, Olga Pohl, Rita Senn, Toni Ulm"
    bench = spark.createDataFrame([(1, numbers), (2, names), (3, ITEM)], "item_id long, text string")
    texts = [f"x {numbers} y", names.lower(), ITEM.upper(), ITEM.replace(" ", "\n"), "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16", "nothing of this is there"]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(table(spark, texts), bench).collect()}
    assert got == {(0, 1), (1, 2), (2, 3), (3, 3)}


def brute_leaks(texts, items, window=10, coverage=0.5):
    """Items of which half the words stand in windows of ten equal words, letter case aside."""
    cut = lambda t: re.findall(r"[^\W\d_]+|[0-9]+(?:[.,][0-9]+)*|%", t.lower())
    out = set()
    for d, t in texts.items():
        w = cut(t or "")
        for i, x in items.items():
            v = cut(x)
            n = min(window, len(v))
            seen = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
            held = {j for k in range(len(v) - n + 1) if n and tuple(v[k:k + n]) in seen for j in range(k, k + n)}
            if v and len(held) >= coverage * len(v):
                out.add((d, i))
    return out


def test_decontamination_brute(spark):
    random.seed(8)
    some = lambda n: " ".join(random.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + random.choice("abcdefghij") for _ in range(n))
    items = {i: some(random.randrange(4, 40)) for i in range(25)}
    texts = {}
    for d in range(120):
        x = items[random.randrange(25)].split()
        k = random.randrange(len(x))
        texts[d] = f"{some(20)} {' '.join(x[k:k + random.randrange(1, 40)])} {some(9)}"
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), bench).collect()}
    assert got == brute_leaks(texts, items) and 10 < len(got) < 120


NUMERIC = "Compute {} + {} - {} * {}, {} + {} - {} and {} * {} - {} + {}, then {} + {} to end."


def test_items_of_numbers(spark):
    """An item that is mostly numbers is found with every number changed, and not in tables of numbers or where the slots do not fit."""
    item = NUMERIC.format(*range(11, 24))
    same = NUMERIC.format(*[7] * 13)
    docs = table(spark, ["Before it. " + NUMERIC.format(*range(131, 144)) + " After it.", item, " ".join(map(str, range(400))), "Add 5 and 6 and 7 and 8, then 9 + 10 + 11 + 12 + 13 to end.", None, ""])
    got = {r["doc_id"] for r in decontamination.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {0, 1}
    # one value throughout cannot stand for thirteen
    got = {r["doc_id"] for r in decontamination.leaks(docs, spark.createDataFrame([(1, same)], "item_id long, text string")).collect()}
    assert got == set()


@pytest.mark.parametrize("seed", range(3))
def test_recall_of_changed_items(spark, seed):
    """Planted items with every number, name and unit changed: all are found, and no other item but one that tells half of the same story."""
    r = random.Random(seed)
    verbs = [w for w in "walks sails carries gathers borrows measures plants counts paints repairs crosses delivers".split()]
    things = "apples boxes bricks plates ropes tickets maps pears lamps shells coins wheels".split()
    story = [(r.choice(verbs), r.choice(things), r.choice(verbs), r.choice(things)) for _ in range(12)]
    tell = lambda k, name, unit, off: f"In the story {name} {story[k][0]} {off} {story[k][1]} over {off + 5} {unit} and later {story[k][2]} {off + 9} {story[k][3]}; how many stay on day {off + 21} of trip {off + 2}?"
    items = spark.createDataFrame([(k, tell(k, "Anna", "km", 3 + k)) for k in range(12)], "item_id long, text string")
    docs = table(spark, [f"Some words first. {tell(k, 'Boris', 'miles', 50 + 3 * k)} Some words after." for k in range(12)])
    got = {(x["doc_id"], x["item_id"]) for x in decontamination.leaks(docs, items).collect()}
    assert {(k, k) for k in range(12)} <= got
    assert all(story[d][:2] == story[i][:2] or story[d][2:] == story[i][2:] or d == i for d, i in got)


def test_decontamination_joins_beyond_the_bounds(spark, monkeypatch):
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    docs = table(spark, [f"We say: {ITEM} ok", "no", *AWKWARD])
    want = sorted(tuple(r) for r in decontamination.leaks(docs, bench).collect())
    monkeypatch.setattr(decontamination, "SENT_WINDOWS", 0)
    monkeypatch.setattr(decontamination, "SENT_ROWS", 0)
    assert sorted(tuple(r) for r in decontamination.leaks(docs, bench).collect()) == want and len(want) == 1


def test_inconsistent_slots_do_not_count(spark):
    item = "if 4 boys share 4 apples and 4 pears then how many fruits are there for the 4 boys in total please say"
    good = item.replace("4", "9")
    values = iter("1 2 3 5".split())
    odd = re.sub("4", lambda _: next(values), item)
    got = {r["doc_id"] for r in decontamination.leaks(table(spark, [good, odd]), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {0}


def test_decontamination_on_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.op7_decontamination(spark, SF).collect()}
    assert whole <= got
    words = lambda s: re.findall(r"\w+", s.lower())
    for d, i in got - whole:  # anything else shares a long run of words
        w, x = words(docs[d]), words(items[i])
        runs = {tuple(w[k:k + 8]) for k in range(len(w))}
        assert any(tuple(x[k:k + 8]) in runs for k in range(len(x) - 7))


# -- 4 -------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_equals_the_library(spark, library):
    random.seed(2)
    letters = list("abcdefghilmnorstuv'  \n!#1") + ["é", "ß", "Σ", "İ", "北", "👍", "\x85", "\xa0", "\x1c", "<|endoftext|>", "<|", "'re", "é"]
    texts = AWKWARD + ["".join(random.choice(letters) for _ in range(random.randrange(80))) for _ in range(300)]
    got = {r["doc_id"]: r for r in bpe.encoded(table(spark, texts), bpe.vocabulary(), ids=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        assert list(got[i]["ids"]) == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(shown.encode()).hexdigest()


def test_bpe_long_word(library):
    c = bpe.Codec(bpe.vocabulary())
    for word in ("ab" * 5000, "the" * 3000, "x" * 10_000):
        assert c.encode(word) == library.encode(word, add_special_tokens=False).ids


# -- 10 ------------------------------------------------------------------------------------------
BASE = [("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 8), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32)]


def brute_spans(text):
    out = []
    for k, (name, p, g, least) in enumerate(BASE):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in p.finditer(text or "") if len(m[g]) >= least]
    return [s for _, _, s in sorted(out)]


def test_secrets(spark):
    random.seed(4)
    parts = ["password=", "token: ", "secret=abc ", "API_KEY = '", "abcdefgh1", "x", "é ", "AKIA" + "A" * 12, "AKIAAB ", "0" * 32, "deadbeef" * 5, " ", "=", "👍", "Zx9" * 8, "token=secret:abcdefghijk "]
    texts = AWKWARD + ["".join(random.choice(parts) for _ in range(random.randrange(25))) for _ in range(150)]
    got = {r["doc_id"]: r for r in secrets.scanned(table(spark, texts), F.col("source"), F.col("lang")).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert set(want) <= set(got[i]["spans"].split(","))
        assert got[i]["n_assign"] == sum(s.startswith("assign") for s in want)


def test_ownership(spark):
    key, own = "Qw3" * 8, "Zx9" * 8
    rows = [(i, f"token={key}", f"o{i}") for i in range(4)] + [(9, f"see {own} here", "o9"), (10, f"bare {key} again", "o1")]
    got = {r["doc_id"]: r for r in secrets.scanned(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.col("source"), F.col("source")).collect()}
    assert got[0]["n_example"] == 1 and got[0]["n_live"] == 0
    assert got[9]["spans"] == "bare:4:28" and got[9]["n_live"] == 1
    assert got[10]["spans"] == "copy:5:29"


# -- 3 -------------------------------------------------------------------------------------------
def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def test_pseudonyms(spark):
    texts = ["4111 1111 1111 1111 and 4111111111111111", "4111-1111-1111-1111.", "4111111111111112", "10.1.2.3 300.1.1.1", "on 2024-02-29 and 29/02/2024", "a.b@mail0.example.com", "+1 (568) 555-7610", "078-05-1120", "GB82 WEST 1234 5698 7654 32", None, ""]
    got = {r["doc_id"]: r["_text"] for r in pseudonyms.pseudonymised(table(spark, texts), "key").select("doc_id", "_text").collect()}
    one, two = re.match(r"(.{19}) and (\d{16})$", got[0]).groups()
    assert one.replace(" ", "") == two == got[1].replace("-", "").rstrip(".") and luhn(two) and two != "4111111111111111"
    assert got[2] == texts[2] and got[9] is None and got[10] == ""
    assert re.fullmatch(r"(\d{1,3}\.){3}\d{1,3} 300\.1\.1\.1", got[3]) and "10.1.2.3" not in got[3]
    iso, day = re.fullmatch(r"on (\d{4}-\d\d-\d\d) and (\d\d/\d\d/\d{4})", got[4]).groups()
    assert "/".join(reversed(iso.split("-"))) == day and iso != "2024-02-29"
    assert "mail0" not in got[5] and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[6]) and got[6] != texts[6]
    assert re.fullmatch(r"\d{3}-\d\d-\d{4}", got[7]) and got[7] != texts[7] and got[8] != texts[8]
    moved = got[8].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1


def test_numbers_beside_others(spark):
    """What stands before or after a card or account number does not keep it in clear."""
    card, iban = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    texts = [f"{card} 03/27", f"{card} 123", f"03 {card}", f"{card} {card}", f"{card} 03/12/2027", f"{iban} EUR", f"{iban} EUR {card}", f"AB12 CDEF 1234 {card} x", f"2024-01-01 {card} 555 123 4567", f"AB12 CDEF GHIJ 555 123 4567 x", "+49 1512 345 6789"]
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymised(table(spark, texts), "key").select("doc_id", "_text", "_kinds").collect()}
    want = [["card"], ["card"], ["card"], ["card"] * 2, ["card", "day"], ["iban"], ["iban", "card"], ["card"], ["iso", "card", "phone"], ["phone"], ["phone"]]
    for i, t in enumerate(texts):
        assert card not in got[i]["_text"] and iban not in got[i]["_text"] and len(got[i]["_text"]) == len(t)
        assert "555 123 4567" not in got[i]["_text"]
        assert list(got[i]["_kinds"]) == want[i], t


def test_pseudonyms_are_permutations(spark):
    df = spark.createDataFrame([(f"10.0.{i // 256}.{i % 256}",) for i in range(600)], "text string")
    assert pseudonyms.pseudonymised(df, "key").select("_text").distinct().count() == 600


def test_no_personal_number_stays(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["text"] for r in pseudonyms.op3_pseudonyms(spark, SF).collect()}
    found = 0
    for i, t in docs.items():
        for m in re.findall(r"[\w.]+@[\w.]+\w|\+1 \(\d{3}\) \d{3}-\d{4}|(?<!\d)4\d{15}(?!\d)|(?<![\d.])(?:\d{2,3}\.){3}\d{1,3}(?![\d.])", t):
            if "@" in m or m.startswith("+") or ("." in m and all(int(x) < 256 for x in m.split("."))) or ("." not in m and luhn(m)):
                found += 1
                assert m not in got[i]
        if not re.search(r"[0-9@]", t):
            assert got[i] == t
    assert found


# -- 8 -------------------------------------------------------------------------------------------
@pytest.mark.parametrize("kind", ["mixed", "copies", "few", "none"])
def test_sharding(spark, kind):
    random.seed(5)
    texts = {"mixed": AWKWARD + ["z" * int(random.expovariate(0.002)) for _ in range(3000)], "copies": ["copy of one text"] * 2000 + [f"text {i}" for i in range(3000)], "few": AWKWARD[:3], "none": []}[kind]
    d = sharding.assigned(table(spark, texts)).toPandas()
    assert len(d) == len(texts)
    if kind in ("few", "none"):
        return
    g = d.groupby("shard")
    assert sorted(g.groups) == list(range(40))
    size = g["size"].sum()
    assert size.max() - size.min() <= d["size"].max() + 0.03 * size.mean()
    assert all(sorted(s) == list(range(len(s))) for _, s in g["slot"])
    by = {i: t for i, t in enumerate(texts)}
    assert all(r.text_crc32 == zlib.crc32((by[r.doc_id] or "").encode()) and r.size == len((by[r.doc_id] or "").encode()) + 16 for r in d.itertuples())
    if kind == "copies":  # a group lies in neighbouring shards
        s = sorted(set(d[d["doc_id"] < 2000]["shard"]))
        assert s == list(range(s[0], s[-1] + 1))


def test_written_shards(spark, tmp_path):
    docs = table(spark, AWKWARD * 5, range(50))
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and set(docs.columns) <= set(back.columns)


def test_sharding_brute(spark):
    """Shards and slots follow from the rows alone: equal texts lie side by side and every row has one place."""
    random.seed(6)
    texts = [random.choice(["a", "bb", "ccc"]) * random.randrange(1, 400) for _ in range(20_000)]
    d = sharding.assigned(table(spark, texts)).toPandas()
    assert len(set(zip(d["shard"], d["slot"], strict=True))) == len(texts) == d["doc_id"].nunique()
    spans = d.assign(text=[texts[i] for i in d["doc_id"]]).groupby("text")["shard"].agg(["min", "max"])
    assert (spans["max"] - spans["min"]).max() <= 1


# -- 2 -------------------------------------------------------------------------------------------
def test_compression_scores(spark):
    d = quality_compression.op2_quality_compression(spark, SF.replace("0.001", "0.01"))
    got = d.join(spark.read.parquet(SF.replace("0.001", "0.01") + "/labels.parquet"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    assert got["score"].between(0, 1).all() and (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()


def brute_difference(pair, text):
    import zstandard

    raw, got = text.encode(), []
    for d in (pair.good, pair.bad):
        c = zstandard.ZstdCompressor(level=quality_compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
        got.append(sum(len(c.compress(raw[i:i + 2048])) for i in range(0, len(raw), 2048)))
    return (got[1] - got[0]) / len(raw)


def test_compression_brute(spark):
    """Scores are a rising curve of the two dictionaries' sizes, worked out apart."""
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) > 4000")
    pair = quality_compression.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(brute_difference(pair, r["text"]), s) for r, s in zip(docs.collect(), [r["score"] for r in quality_compression.scored(docs, pair).collect()], strict=True)]
    assert [d for d, _ in rows] == pytest.approx(pair.differences([r["text"] for r in docs.collect()]).tolist())
    rows.sort()
    scores = [s for _, s in rows]
    assert sum(a > b + 0.05 for a, b in zip(scores, scores[1:], strict=False)) == 0 and len(rows) > 20


def test_compression_without_labels(spark):
    docs = table(spark, AWKWARD)
    pair = quality_compression.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r["score"] for r in quality_compression.scored(docs, pair).collect()] == [0.5] * len(AWKWARD)


# -- 1 -------------------------------------------------------------------------------------------
def page(i, body, extra=""):
    return f'<!DOCTYPE html><html><head><title>T{i}</title><script>var t="</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="sidebar">Popular now {i}</div>{body}<div class="comments"><p>I say {i}</p></div><form>Mail <input></form>{extra}<footer>&copy; all</footer></body></html>'


def test_html(spark):
    rows = [(i, f"http://a.example/{i}", page(i, f"<article><h1>Head {i}</h1><p>First &amp; {i}<br>more<p>Second\n {i}</article>")) for i in range(6)]
    rows += [(10 + i, f"http://b.example/{i}", page(i, f'<div id="content"><p>Block one {i} of a page without an article element.</p><p>Block two {i} ends it.</p></div>')) for i in range(6)]
    rows += [(20, None, None), (21, "x", ""), (22, "http://c.example/", "just text <b>bold"), (23, "http://c.example/2", "<p>cut off <a hre")]
    got = {r["page_id"]: r for r in html_extraction.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3]["text"] == "Head 3\n\nFirst & 3 more\n\nSecond 3"
    assert got[12]["text"] == "Block one 2 of a page without an article element.\n\nBlock two 2 ends it."
    assert got[20]["text"] == got[21]["text"] == "" and got[22]["text"] == "just text bold" and got[23]["text"].startswith("cut off")
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_classes_share_vectors(spark):
    rows = [(i, f"http://a.example/{i}", page(i, f"<article><p>Text {i}</p></article>")) for i in range(8)]
    rows += [rows[0]] * 2  # repeated rows count as one page
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    t = html_extraction.templates(pages).collect()
    elements, blocks = html_extraction.read(rows[0][2])
    assert t[0]["main"] == next(e.path for e in elements if e.name == "article")
    fixed = {html_extraction._hash(elements[b.element].path, b.text) for b in blocks if b.text in ("Home", "© all")}
    assert len(fixed) == 2 and fixed <= set(t[0]["tokens"])
    vectors = {r["token"]: r["vector"] for r in html_extraction.occurrences(pages).where("pages = 8 and count = 8").collect()}
    assert len(set(vectors.values())) == 1 and len(vectors) > 5


def test_repeated_pages_stay_apart(spark):
    """Two equal pages: their tokens do not cancel, and those of one page only are of another class."""
    rows = [(1, "http://a.example/1", "<article><p>one</p></article>")] * 2 + [(2, "http://a.example/2", "<article><ul><li>two</ul></article>")]
    got = html_extraction.occurrences(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len({r["vector"] for r in got}) == 3 and {r["pages"] for r in got} == {1, 2}


CASES = [
    ('<article><p><img alt="5" tall">Lost words here</p>', "Lost words here"),
    ("<article><p>a <a title=it's href=x>link</a> end", "a link end"),
    ("<article><p>one <svg><title>x</title></svg> two <script>3</script>four", "one two four"),
    ("<article><p>x is <math><mi>y</mi><mo>+</mo></math> z<figure><figcaption>Seen here</figcaption></figure>", "x is y+ z\n\nSeen here"),
    ("<article><header><h1>Title</h1></header><p>Text</p><footer>By us</footer></article><footer>End</footer>", "Title\n\nText"),
    ('<div class="article-header"><h1>Title</h1></div><div class="site-header">Site</div><div><p>A first text of this page.</div>', "Title\n\nA first text of this page."),
    ("<head><title>T</title><body><p>Head never closed", "Head never closed"),
    ("<div>" + "A story in a plain element that is told at some length here. " * 4 + "</div><article><h3>Teaser</h3></article>", ("A story in a plain element that is told at some length here. " * 4).strip() + "\n\nTeaser"),
    ("<div><p>A lead that stands beside the body of the text.</p><div>" + "<p>Body text of some length stands in here too.</p>" * 9 + "</div></div>", "\n\n".join(["A lead that stands beside the body of the text."] + ["Body text of some length stands in here too."] * 9)),
    ('<article><h2 id="search">Search trees</h2><p class="share-price">It rose.</p><p class="lead social">Then fell.</p><section id="cookie-recipes"><p>Bake.</p></section><blockquote class="reply">Quoted.</blockquote></article>', "Search trees\n\nIt rose.\n\nThen fell.\n\nBake.\n\nQuoted."),
    ('<article><p>Text</p><p class="ad">Buy</p><div class="share-buttons">Share</div><div class="comments"><p>I say</p></div><ul id="related-posts"><li>Other</ul></article>', "Text"),
    ("<article><h1>Head</h1><p>Text</p><article><p>A reader says so</p></article></article>", "Head\n\nText"),
    ("<article><article><h1>Head</h1><p>Only the inner one has text</p></article></article>", "Head\n\nOnly the inner one has text"),
    ("<div><h1>Headline</h1><article><p>Text of it.</p></article></div>", "Headline\n\nText of it."),
    ("<h1>The site</h1><article><h2>Head</h2><p>Text of it.</p></article>", "Head\n\nText of it."),
    ("<p>a &lt;b&gt; &#x41;&nbsp;c\n\td", "a <b> A c d"),
]


def test_html_cases():
    for html, want in CASES:
        assert html_extraction.extract(html) == want, html


def test_template_text_inside_articles(spark):
    """A sentence in each article of a host is template; a heading in each, and articles that are copies, are not."""
    note = "<p>Sign up to our newsletter for more stories like this one.</p>"
    rows = [(i, f"http://a.example/{i}", page(i, f"<article><h2>Summary</h2><p>A story of its own, number {i}, told at some length.</p><p>It ends {i}.</p>{note}</article>")) for i in range(8)]
    rows += [(20 + i, f"http://b.example/{i}", page(i, f"<article><h1>Copied</h1><p>The same story stands on each page here.</p><p>Seen {i}</p></article>")) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Summary\n\nA story of its own, number {i}, told at some length.\n\nIt ends {i}." for i in range(8))
    assert all(got[20 + i] == f"Copied\n\nThe same story stands on each page here.\n\nSeen {i}" for i in range(5))


def test_deep_nesting_takes_a_step_an_element():
    import time

    began = time.time()
    assert html_extraction.extract("<div><p>x" * 40_000).count("x") == 40_000
    assert len(html_extraction.extract("<b>y<p>" * 20_000).split()) == 20_000
    assert time.time() - began < 20


def brute_text(html):
    """An independent reader for well-formed pages: html.parser, a skip counter, block borders."""
    from html.parser import HTMLParser

    skip, blocks, line = {"nav", "footer", "aside", "form", "script", "style", "head", "header"}, [], []

    class Reader(HTMLParser):
        depth = 0

        def handle_starttag(self, tag, attrs):
            hidden = tag in skip or any(k == "class" and set(v.split()) & {"ad", "sidebar", "comments", "cookie"} for k, v in attrs)
            if self.depth or hidden:
                self.depth += tag not in {"br", "meta", "input", "img", "p", "b"}
            if tag == "br":
                line.append(" ")
            if tag not in {"b", "a", "br", "i"}:
                self.cut()

        def handle_endtag(self, tag):
            if tag not in {"b", "a", "i"}:
                self.cut()
            if self.depth and tag not in {"p", "b"}:
                self.depth -= 1

        def handle_data(self, data):
            if not self.depth:
                line.append(data)

        def cut(self):
            text = " ".join("".join(line).split())
            line.clear()
            if text:
                blocks.append(text)

    r = Reader()
    r.feed(html or "")
    r.close()
    r.cut()
    return "\n\n".join(blocks)


def test_html_on_pages(spark):
    pages = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet")
    want = {r["page_id"]: brute_text(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in html_extraction.extracted(pages).collect()}
    assert got == want


# -- all of them: empty tables -------------------------------------------------------------------
def test_empty_tables(spark):
    none = table(spark, [])
    assert quality_rules.judged(none, spark.createDataFrame([], "doc_id long, quality int"), ["doc_id"]).count() == 0
    assert line_dedup.without_boilerplate(none, "source", "text").count() == 0
    assert ngram_join.linked(none, 3, 90, 100).count() == 0
    assert decontamination.leaks(none, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).count() == 0
    assert decontamination.leaks(table(spark, ["a"]), spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert bpe.encoded(none, bpe.vocabulary()).count() == 0
    assert secrets.scanned(none, F.col("source"), F.col("lang")).count() == 0
    assert pseudonyms.pseudonymised(none, "key").count() == 0
    assert html_extraction.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_windows_are_compiled_and_texts_read_once(spark, tmp_path):
    """Windows cost no lambda for each token, and rows that hold any are worked out once, whatever the forms and lengths."""
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    texts = ["", None, f"xx {' '.join(words)} 7", " ".join(words[:4]), f"Then, Mr {ITEM}"]
    table(spark, texts).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    rows = decontamination.windows(decontamination.templates(docs, "text", ["doc_id"], both=False), {"template": [3, 10], "plain": [4]}, ["doc_id"]).select("doc_id", "form", "n", "at", "hash")
    assert "lambda" not in shown(rows)
    count = {tuple(r)[:3]: r["count"] for r in rows.groupBy("doc_id", "form", "n").count().collect()}
    assert count[2, "template", 3] == 12 and count[2, "template", 10] == 5 and count[2, "plain", 4] == 11 and count[3, "template", 3] == 2 and (3, "template", 10) not in count
    bench = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:4])), (3, " ".join(words[:7])), (4, ITEM)], "item_id long, text string")
    found = decontamination.leaks(docs, bench)
    assert shown(found).count(f"{tmp_path}/docs") == 1
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(2, 1), (2, 2), (2, 3), (3, 2), (4, 4)}
