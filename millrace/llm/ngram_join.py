"""N-gram Jaccard join: linked texts and their components, exact at the threshold.

1. Every text becomes its set of distinct word shingles (64-bit hashes). Equal sets are one
   node from here on, so copies cost nothing more.
2. Clusters. Two sets at the threshold differ in at most D shingles. Cut by hash into D + 1 + S
   parts, they agree in at least S + 1 whole parts, so of the D + 1 strongest parts of each (in
   one order over all parts: most shingles that are not common first) one is the same. Their
   digests are the keys under which possible partners meet; the S weakest parts, those that a
   passage shared by many documents fills, are never keys. All nodes of a key form a star around
   its smallest node, never pairs. Sizes fall into classes, and a set is cut for its own and the
   next class.
3. Prefix-tree join in each cluster. Shingles are put into one order for the cluster, those in
   most sets first; a shingle of one set only counts for lengths. The sorted sets form a trie,
   which is walked once for each set: what sets share is compared once, and a subtree is left
   when its lengths or what remains below it cannot reach the overlap needed, or when all of it
   is linked to the set already. Only links that join two parts come out.
   Clusters of each node's smallest leader come first; then those that still hold nodes of
   different components.
4. A cluster over BLOCK nodes is dealt to several tasks: each block against itself and the
   first block; then whatever is not in the cluster's largest part against every block. Keys
   that many nodes hold, and the members of large clusters, are salted before they are shuffled.
5. Links give components by repeated minima over neighbours.

Texts are fetched for nodes that have a partner in a star only, once, into a table of their own.
Nothing is capped: the keys only decide who is compared, and every link is checked on the whole
sets. SAMPLE documents tell which shingles and keys are common; that decides costs, never
results. Defined results: null or empty texts have an empty set and link with nothing; repeated
rows are copies; a null doc_id is linked like any other and is never the smallest unless it is
alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, stored, table

BLOCK = 1_000
#: Rows up to which a list of rows to fetch (two longs each) is sent to every task; beyond it, it is joined by a shuffle.
SENT_ROWS = 200_000
#: Documents sampled for common shingles and keys, and the share of them from which one is common: at most 1 / COMMON times the shingles of a mean text.
SAMPLE, COMMON = 4_000, 0.002
#: More parts than needed, as a share; salts of a common key and of a large cluster.
SPARE, SALTS = 0.3, 64

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _B
        h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LETTERS = _mix((np.arange(64 * 256, dtype=np.uint64) + np.uint64(1)) * _A)  # by place in the word and byte


def words(text: str | None) -> np.ndarray:
    """A hash of each word, A-Z lower-cased: the sum of what its bytes are worth at their places."""
    data = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    solid = ~_BLANK[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.empty(0, dtype=np.uint64)
    firsts = np.flatnonzero(begins[at])
    place = at - np.repeat(at[firsts], np.diff(np.append(firsts, len(at))))
    code = place << 8 | data[at]
    with np.errstate(over="ignore"):
        worth = _LETTERS[code] if int(place.max()) < 64 else _mix((code.astype(np.uint64) + np.uint64(1)) * _A)
        return _mix(np.add.reduceat(worth, firsts))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The text's set, ascending; the whole sequence as one shingle where it has fewer than n words."""
    h = words(text)
    if not len(h):
        return np.empty(0, dtype=np.int64)
    size = min(n, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, size, dtype=np.uint64)
        for i in range(size):
            out = (out ^ h[i: len(h) - size + 1 + i]) * _A
            out ^= out >> np.uint64(29)
    return np.unique(_mix(out).view(np.int64))


class Rule:
    """Shingle length and threshold num / den; the size classes and how many parts each needs."""

    def __init__(self, n: int, num: int, den: int):
        self.n, self.num, self.den = n, num, den
        self.bounds = [1]

    def most_apart(self, total: int) -> int:
        """Shingles in which two linked sets with total members between them can differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def needed(self, x: int, y: int) -> int:
        return -(-self.num * (x + y) // (self.den + self.num))

    def class_of(self, size: int) -> int:
        b = self.bounds
        while b[-1] <= size:  # the smallest size whose every partner is at most one class below
            b.append(max(b[-1] + 1, self.den * (b[-1] - 1) // self.num + 1))
        return int(np.searchsorted(b, size, side="right")) - 1

    def parts(self, kind: int) -> tuple[int, int]:
        """Parts for a class, and how many of them are keys; any two linked sets agree in one of those."""
        while len(self.bounds) < kind + 2:
            self.class_of(self.bounds[-1])
        need = self.most_apart(2 * (self.bounds[kind + 1] - 1)) + 1
        return need + int(np.ceil(SPARE * need)), need

    def keys(self, found: np.ndarray, common: np.ndarray | None = None) -> np.ndarray:
        """Digests of the strongest parts of a set, for its own class and the one above; none where only equal sets can link."""
        kind, h = self.class_of(len(found)), _mix(found.view(np.uint64))
        weight = None
        if common is not None and len(common):
            weight = (common[np.minimum(np.searchsorted(common, found), len(common) - 1)] != found).astype(np.float64)
        out = []
        for k in (kind, kind + 1):
            parts, need = self.parts(k)
            if need > 1:
                at = ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
                one = np.zeros(parts, dtype=np.uint64)
                np.bitwise_xor.at(one, at, h)
                got = _mix(one ^ _mix(np.arange(parts, dtype=np.uint64) + np.uint64((k + 1) << 32)))
                strength = np.bincount(at, weights=weight, minlength=parts).astype(np.uint64)
                rank = np.minimum(strength, np.uint64(0xFFFF)) << np.uint64(48) | got >> np.uint64(16)
                out.append(got[np.argpartition(rank, parts - need)[parts - need:]])
        return np.concatenate(out).view(np.int64) if out else np.empty(0, dtype=np.int64)


def _digest(found: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def _rows(batch: pa.RecordBatch, *names: str):
    """A batch's rows, a few at a time: its texts never stand in memory twice."""
    for at in range(0, batch.num_rows, 256):
        yield from zip(*(batch.column(c).slice(at, 256).to_pylist() for c in names), strict=True)


def nodes(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, row (a hash of doc_id and text), n_shingles, node (a digest of the set; null if empty) of every row."""

    def run(batches):
        for b in batches:
            sizes, digests = [], []
            for (t,) in _rows(b, "text"):
                found = shingles(t, rule.n)
                sizes.append(len(found))
                digests.append(_digest(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row"), pa.array(sizes, pa.int64()), pa.array(digests, pa.int64())],
                names=["doc_id", "row", "n_shingles", "node"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text").mapInArrow(run, "doc_id long, row long, n_shingles long, node long")


def common_shingles(docs: DataFrame, rule: Rule) -> np.ndarray:
    """Shingles in COMMON of the different texts of a sample, ascending: at most 1 / COMMON times those of a mean text."""

    def run(batches):
        for b in batches:
            for (t,) in _rows(b, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, rule.n), pa.int64())], names=["shingle"])

    found = docs.select("text").distinct().mapInArrow(run, "shingle long").groupBy("shingle").count()
    return np.sort(np.array([r[0] for r in found.where(F.col("count") >= max(3, COMMON * SAMPLE)).select("shingle").collect()], dtype=np.int64))


def common_keys(docs: DataFrame, rule: Rule, common: np.ndarray) -> np.ndarray:
    """Keys that COMMON of the sample's nodes hold, ascending."""
    got = keyed(docs, rule, common, np.empty(0, dtype=np.int64)).distinct().groupBy("key").count()
    return np.sort(np.array([r[0] for r in got.where(F.col("count") >= max(3, COMMON * SAMPLE)).select("key").collect()], dtype=np.int64))


def keyed(docs: DataFrame, rule: Rule, common: np.ndarray, hot: np.ndarray) -> DataFrame:
    """key, node, salt: a row for each key of each node; a task emits a node once. Keys that many nodes hold get a salt."""

    def put(keys: list, own: list) -> pa.RecordBatch:
        key, node = np.concatenate(keys), np.concatenate(own)
        salt = np.zeros(len(key), dtype=np.int32)
        if len(hot):
            held = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
            salt[held] = 1 + node[held] % SALTS
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(node, pa.int64()), pa.array(salt, pa.int32())], names=["key", "node", "salt"])

    def run(batches):
        seen: set[int] = set()
        keys, own, held = [], [], 0
        for b in batches:
            for (t,) in _rows(b, "text"):
                found = shingles(t, rule.n)
                if len(found) and (node := _digest(found)) not in seen:
                    seen.add(node)
                    k = rule.keys(found, common)
                    keys.append(k)
                    own.append(np.full(len(k), node))
                    held += len(k)
                    if held >= 100_000:
                        yield put(keys, own)
                        keys, own, held = [], [], 0
        if keys:
            yield put(keys, own)

    return docs.select("text").mapInArrow(run, "key long, node long, salt int")


def stars(keys: DataFrame) -> DataFrame:
    """leader, member: each node beside the smallest node of a key they share; distinct."""

    def run(batches):
        last = last_leader = None
        for b in batches:
            key, node, salt = (b.column(c).to_numpy() for c in ("key", "node", "salt"))
            if not len(key):
                continue
            first = np.ones(len(key), dtype=bool)
            first[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
            if last == (key[0], salt[0]):
                first[0] = False
            starts = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
            leader = np.where(starts >= 0, node[np.maximum(starts, 0)], last_leader if last_leader is not None else 0)
            last, last_leader = (key[-1], salt[-1]), leader[-1]
            pick = (leader != node) | (salt > 0)
            if pick.any():
                pairs = pd.DataFrame({"leader": leader[pick], "member": node[pick], "hot": np.where(salt[pick] > 0, key[pick], 0)}).drop_duplicates()
                yield pa.RecordBatch.from_pandas(pairs, preserve_index=False)

    dealt = keys.repartition(partitions(keys.sparkSession), "key", "salt").sortWithinPartitions("key", "salt", "node")
    found = stored(dealt.mapInArrow(run, "leader long, member long, hot long"))
    heads = F.broadcast(found.where("hot <> 0").groupBy("hot").agg(F.min("leader").alias("head")))  # a row for each common key
    moved = found.where("hot <> 0").join(heads, "hot").select(F.col("head").alias("leader"), "member")
    return found.where("hot = 0").select("leader", "member").unionByName(moved).where("leader <> member").distinct()


class _Branch:
    """A node of the prefix tree: the shingles on the way to it, its children, and bounds over the sets below."""

    __slots__ = ("deepest", "least", "longest", "own", "start", "stop", "under", "whole")

    def __init__(self, own, start, stop):
        self.own, self.start, self.stop = own, start, stop  # the slice of set ``own`` that leads here
        self.under, self.whole = [], None  # children; one set of the part that all sets below belong to
        self.least = self.longest = self.deepest = 0  # sizes of whole sets, and most shared shingles in one


def _tree(sets: list[np.ndarray], sizes: list[int]) -> _Branch:
    """A prefix tree of sets that stand in lexicographic order, built from neighbours' common prefixes.

    Every set ends in a leaf; one that others begin with has an empty leaf as the first child of its branch.
    """

    def shared(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    root = _Branch(0, 0, 0)
    path = [root]
    for i, s in enumerate(sets):
        common = shared(sets[i - 1], s) if i else 0
        last = None
        while path[-1].stop > common:
            last = path.pop()
        top = path[-1]
        if last is not None and top.stop < common:  # cut the branch where the ways part
            middle = _Branch(last.own, last.start, common)
            top.under[-1] = middle
            last.start = common
            middle.under.append(last)
            path.append(middle)
            top = middle
        if top is not root and not top.under:  # the set before is a prefix of this one: it stays a set of its own
            top.under.append(_Branch(top.own, common, common))
        leaf = _Branch(i, common, len(s))
        top.under.append(leaf)
        path.append(leaf)
    stack = [(root, False)]
    while stack:
        b, done = stack.pop()
        if not b.under:
            b.whole, b.least, b.longest, b.deepest = b.own, sizes[b.own], sizes[b.own], b.stop
        elif done:
            b.least, b.longest, b.deepest = min(u.least for u in b.under), max(u.longest for u in b.under), max(u.deepest for u in b.under)
        else:
            stack.append((b, True))
            stack += [(u, False) for u in b.under]
    return root


def _ordered(sets: list[np.ndarray], labels: np.ndarray, rule: Rule) -> tuple[list[int], list[np.ndarray]]:
    """The sets that can join another part here, in the tree's order, each as the ascending places of what it shares with other parts.

    A linked set shares num / den of its shingles with one partner, so it goes if fewer stand in
    sets of other labels; that may leave others with too few, so it is repeated until none goes.
    """
    size = np.array([len(s) for s in sets])
    kinds, place = np.unique(np.concatenate(sets), return_inverse=True)
    own, left = np.repeat(np.arange(len(sets)), size), np.ones(len(sets), dtype=bool)
    while True:
        low, high = np.full(len(kinds), len(sets)), np.full(len(kinds), -1)
        np.minimum.at(low, place, labels[own])
        np.maximum.at(high, place, labels[own])
        both = (low < high)[place]
        place, own = place[both], own[both]
        stays = left & (np.bincount(own, minlength=len(sets)) * rule.den >= size * rule.num) & (size > 0)
        if (stays == left).all():
            break
        left, keep = stays, stays[own]
        place, own = place[keep], own[keep]
    count = np.bincount(place, minlength=len(kinds))
    rank = np.empty(len(kinds), dtype=np.int64)
    rank[np.lexsort((kinds, -count))] = np.arange(len(kinds))  # what most sets hold comes first, so they share long ways
    at = rank[place]
    by = np.lexsort((at, own))
    ends = np.cumsum(np.bincount(own, minlength=len(sets)))
    ways = np.split(at[by], ends[:-1])
    order = sorted(np.flatnonzero(left).tolist(), key=lambda i: ways[i].astype(">u8").tobytes())
    return order, [ways[i] for i in order]


def tree_links(sets: list[np.ndarray], probes: list[int], rule: Rule, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between probes and all sets that join two parts: enough for the components, never all pairs.

    ``known`` gives sets of one part the same number, where links are known already.
    """
    if len(sets) < 2:
        return []
    labels = np.arange(len(sets)) if known is None else np.unique(np.array(known, dtype=np.int64), return_inverse=True)[1]
    order, ways = _ordered(sets, labels, rule)
    if len(order) < 2:
        return []
    sizes = [len(sets[i]) for i in order]
    root = _tree(ways, sizes)
    heads: dict[int, int] = {}
    parent = [heads.setdefault(int(labels[i]), k) for k, i in enumerate(order)]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    place = {i: k for k, i in enumerate(order)}
    links = []
    for i in probes:
        me = place.get(i)
        if me is None:
            continue
        x, size, mine = ways[me], sizes[me], find(me)
        stack = [(root, 0)]
        while stack:
            b, got = stack.pop()
            if b.whole is not None:
                if find(b.whole) == mine:
                    continue  # all of it is linked to this set already
            else:
                one = find(b.under[0].whole) if b.under[0].whole is not None else None
                if one is not None and all(u.whole is not None and find(u.whole) == one for u in b.under):
                    b.whole = one
                    if one == mine:
                        continue
            if b.longest * rule.den < size * rule.num or size * rule.den < b.least * rule.num:
                continue
            passed = 0
            if b.stop > b.start:
                way = ways[b.own][b.start: b.stop]
                low = np.searchsorted(x, way)
                got += int((x[np.minimum(low, len(x) - 1)] == way).sum())
                passed = int(low[-1]) + int(low[-1] < len(x) and x[min(low[-1], len(x) - 1)] == way[-1])
            if got + min(len(x) - passed, b.deepest - b.stop) < rule.needed(size, max(b.least, got)):
                continue
            if b.under:
                stack += [(u, got) for u in b.under]
            elif b.own != me and got >= rule.needed(size, sizes[b.own]):
                parent[find(b.own)] = mine
                links.append((i, order[b.own]))
    return links


def _joined(rows: DataFrame, rule: Rule) -> DataFrame:
    """left, right: links inside each task; rows hold task, part, probe, role (0 tree, 1 probe, 2 both), node, its root and text."""

    def links(group: list) -> pa.RecordBatch | None:
        one = {}
        for node, role, root, text in group:  # a node may stand in a task both as tree and as probe
            one[node] = (max(role, one[node][0]) if node in one else role, text, root)
        own = sorted(one)
        sets = [shingles(one[k][1], rule.n) for k in own]
        got = tree_links(sets, [i for i, k in enumerate(own) if one[k][0] > 0], rule, [one[k][2] for k in own])
        return pa.RecordBatch.from_arrays([pa.array([own[i] for i, _ in got], pa.int64()), pa.array([own[j] for _, j in got], pa.int64())], names=["left", "right"]) if got else None

    def run(batches):
        last, group = None, []
        for b in batches:  # a task's rows stand together; at most two blocks of them are held
            for task, part, probe, *row in _rows(b, "task", "part", "probe", "node", "role", "root", "text"):
                key = task, part, probe
                if key != last:
                    if group and (out := links(group)):
                        yield out
                    last, group = key, []
                group.append(row)
        if group and (out := links(group)):
            yield out

    by = ["task", "part", "probe"]
    return rows.repartition(partitions(rows.sparkSession), *by).sortWithinPartitions(*by).mapInArrow(run, "left long, right long")


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component of links (left, right); each round takes minima over neighbours and follows them."""
    both = stored(links.where("left <> right").select("left", "right").unionByName(links.where("left <> right").select(F.col("right").alias("left"), F.col("left").alias("right"))).distinct())
    state = stored(both.groupBy(F.col("left").alias("node")).agg(F.least(F.first("left"), F.min("right")).alias("root")))
    while True:
        near = both.join(state.select(F.col("node").alias("right"), F.col("root").alias("_r")), "right").groupBy(F.col("left").alias("node")).agg(F.min("_r").alias("_near"))
        best = state.join(near, "node").select("node", F.least("root", "_near").alias("_to"), F.col("root").alias("_was"))
        after = best.join(state.select(F.col("node").alias("_to"), F.col("root").alias("_on")), "_to", "left").select("node", F.least("_to", F.coalesce("_on", "_to")).alias("root"), "_was")
        after = stored(after)
        state = after.select("node", "root")
        if after.where("root <> _was").isEmpty():
            return state


def _meet(texts: DataFrame, clusters: DataFrame, before: tuple[DataFrame, DataFrame] | None, rule: Rule, block: int) -> tuple[DataFrame, DataFrame]:
    """Links found so far and components, after joining clusters (leader, member; the leader is a member of its own)."""
    large = clusters.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")).where("blocks > 1")
    salts = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    inside = clusters.select("leader", F.col("member").alias("node"), F.pmod(F.xxhash64("member"), F.lit(SALTS)).cast("int").alias("salt"))
    inside = inside.join(salts, ["leader", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    inside = stored(inside.withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int")))
    everyone = F.sequence(F.lit(0), F.col("blocks") - 1)
    first = inside.withColumn("part", F.explode(F.when(F.col("block") == 0, everyone).otherwise(F.array("block"))))
    first = first.select(F.col("leader").alias("task"), "part", F.lit(0).alias("probe"), F.lit(2).alias("role"), "node")
    joined = _joined(_with_text(first, texts, before and before[1]), rule)
    found = stored(joined if before is None else before[0].unionByName(joined))
    roots = components(found)

    placed = stored(inside.where("blocks > 1").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    main = placed.groupBy("leader", "root").agg(F.count("*").alias("size")).groupBy("leader").agg(F.max_by("root", F.struct("size", "root")).alias("main"))
    main = main.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rest = stored(placed.join(main, ["leader", "salt"]).where("root <> main").select("leader", "salt", "node", "blocks"))
    if rest.isEmpty():
        return found, roots
    many = rest.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("probes"))
    many = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    tree = placed.join(many, ["leader", "salt"]).withColumn("probe", F.explode(F.sequence(F.lit(0), F.col("probes") - 1))).select(F.col("leader").alias("task"), F.col("block").alias("part"), "probe", F.lit(0).alias("role"), "node")
    ask = (
        rest.join(many, ["leader", "salt"]).withColumn("probe", F.pmod(F.xxhash64("node", F.lit(6)), F.col("probes")).cast("int"))
        .withColumn("part", F.explode(everyone)).select(F.col("leader").alias("task"), "part", "probe", F.lit(1).alias("role"), "node")
    )
    found = stored(found.unionByName(_joined(_with_text(tree.unionByName(ask), texts, roots), rule)))
    return found, components(found)


def _with_text(rows: DataFrame, texts: DataFrame, roots: DataFrame | None) -> DataFrame:
    """rows with the text and the root (itself where it has none) of each node."""
    root = rows.withColumn("root", F.col("node")) if roots is None else rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return root.join(texts, "node")


def linked(docs: DataFrame, n: int, num: int, den: int, block: int = BLOCK, sent_rows: int = SENT_ROWS) -> DataFrame:
    """doc_id, row, n_shingles and component_id for every row of docs (doc_id, text)."""
    rule = Rule(n, num, den)
    docs = docs.select("doc_id", "text")
    known = stored(nodes(docs, rule))
    every = max(1, known.count() // SAMPLE)
    sample = stored(docs.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(every)) == 0).select("text"))
    common = common_shingles(sample, rule)
    edges = stored(stars(keyed(docs, rule, common, common_keys(sample, rule, common))))

    # The texts of nodes that have a partner, each from one of the rows that hold it.
    partners = edges.select(F.col("member").alias("node")).unionByName(edges.select(F.col("leader").alias("node"))).distinct()
    rows = stored(known.join(partners, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row")))
    if rows.count() <= sent_rows:
        rows = F.broadcast(rows)  # at most sent_rows rows of two longs
    texts = stored(docs.withColumn("row", F.xxhash64("doc_id", "text")).join(rows, "row").dropDuplicates(["node"]).select("node", "text"))

    # First each node meets the smallest of its leaders: a row or two for each node.
    top = edges.groupBy("member").agg(F.min("leader").alias("leader"))
    own = top.select(F.col("leader").alias("member")).distinct().select(F.col("member").alias("leader"), "member")
    found, roots = _meet(texts, top.select("leader", "member").unionByName(own), None, rule, block)

    # Of the other stars, only those that still hold nodes of different parts are joined.
    part = edges.join(roots.select(F.col("node").alias("member"), F.col("root").alias("_m")), "member", "left").withColumn("_m", F.coalesce("_m", "member"))
    open_ = (
        part.groupBy("leader").agg(F.min("_m").alias("low"), F.max("_m").alias("high"))
        .join(roots.select(F.col("node").alias("leader"), F.col("root").alias("_l")), "leader", "left")
        .where((F.col("low") != F.col("high")) | (F.col("low") != F.coalesce("_l", "leader"))).select("leader")
    )
    salts = open_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = stored(edges.withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(SALTS)).cast("int")).join(salts, ["leader", "salt"], "left_semi").select("leader", "member"))
    if not left.isEmpty():
        heads = left.select("leader").distinct()
        found, roots = _meet(texts, left.unionByName(heads.select("leader", F.col("leader").alias("member"))), (found, roots), rule, block)

    full = known.where("node is not null").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return full.join(least, "root").select("doc_id", "row", "n_shingles", "component_id").unionByName(known.where("node is null").select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id")))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"), 3, 90, 100).select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, that with the smallest doc_id (of rows that repeat, one); five words, 0.8.

    Rows with a null or empty text, or a null doc_id, stay, repeated ones once.
    """
    found = linked(docs, 5, 80, 100).where("component_id is null or doc_id = component_id or n_shingles = 0")
    kept = stored(found.groupBy("row").agg(F.count("*").alias("n")))
    if kept.count() <= SENT_ROWS:
        kept = F.broadcast(kept)  # at most SENT_ROWS rows of two longs
    out = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64("doc_id", "text").alias("row")).join(kept, "row")  # columns may carry any name
    once, again = out.where("n = 1"), out.where("n > 1").dropDuplicates(["row"])
    return once.unionByName(again).select(*(F.col("doc")[c].alias(c) for c in docs.columns))


QUERIES = {"op5_ngram_join": op5_ngram_join}
SQL: dict[str, str] = {}
