"""BPE encoding and decoding of whole texts.

Encoding is the backtracking method: Aho-Corasick gives the longest token at each place of a
word; a token is accepted beside its predecessor only if the pair-compatibility table says
that merging would have left exactly this border; otherwise a shorter token, or a step back,
is tried. Places that proved dead are marked, so each is left at most once and a word takes
linear time. Decoding cuts token strings out of one text by an offset table.

Words repeat, so each Python worker keeps a bounded table of encoded words in two halves: when
the newer half is full it becomes the older one, and what is asked for again moves over, so
frequent words stay. The table goes with its task. The vocabulary file is a parameter and is sent with the closure.

Defined results: a null or empty text has no tokens (the hash of nothing); special tokens
written in a text are taken as those tokens; repeated rows are encoded alike.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import released, table

#: White space as the vocabulary's patterns know it (the Unicode property), as a fixed value.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
#: Blanks for str.split() that the vocabulary does not take for white space.
SEPARATORS = "\x1c\x1d\x1e\x1f"
ENDS = ".,;:!?"
END = "\x00"  # stands for the end of a word inside the automaton; no mapped byte is \x00


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


#: Words in each half of a worker's table: more take less time and more memory.
KEEP = 150_000


class Codec:
    def __init__(self, content: str, keep: int = KEEP):
        import ahocorasick
        import regex

        spec = json.loads(content)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.keep, self.suffix, self.letters = keep, suffix, byte_letters()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        own = {t: i for t, i in vocab.items() if t not in self.specials}
        shown = lambda t: t[: -len(suffix)] + END if suffix and t.endswith(suffix) and len(t) > len(suffix) else t
        self.strings = {i: shown(t) for t, i in own.items()}
        self.lengths = {i: len(s) for i, s in self.strings.items()}
        rank = {}
        self.halves, self.merged = {}, {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i = own.get(a + b if not (suffix and a.endswith(suffix)) else a[: -len(suffix)] + b)
            if i is not None and (own[a], own[b]) not in self.merged:
                self.merged[own[a], own[b]] = i
                if i not in rank:
                    rank[i], self.halves[i] = k, (own[a], own[b])
        self.rank = {i: rank.get(i, -1) for i in self.strings}  # a single letter was never merged
        self.made = {i for i in self.strings if i in rank or len(self.strings[i].rstrip(END)) == 1}
        self.auto = ahocorasick.Automaton()
        for i in self.made:
            self.auto.add_word(self.strings[i], (i, len(self.strings[i]) - 1))
        self.auto.make_automaton()
        by = {self.strings[i]: i for i in self.made}
        self.shorter = {}
        for s, i in by.items():  # the longest token that begins it
            self.shorter[i] = next((by[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in by), None)
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces = regex.compile(PIECES)
        self.cut = regex.compile(f"[{SPACE}]+")
        self.named = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        blob, self.offsets, at = [], {}, 0  # all token strings in one text, and where each begins and ends
        for t, i in sorted({**own, **self.specials}.items(), key=lambda x: x[1]):
            blob.append(t)
            self.offsets[i] = (at, at + len(t))
            at += len(t)
        self.blob = "".join(blob)
        self.numbers = {i: str(i) for i in self.offsets}
        self.whole = {s: i for s, i in by.items() if s.endswith(END) or not suffix}
        self.known: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.mixed: dict[str, tuple[int, str, str]] = {}  # stretches of several pieces

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' letters leaves a border between them; undone merges are taken latest first."""
        key = (left, right)
        if (known := self.fits.get(key)) is not None:
            return known
        rank, halves, merged = self.rank, self.halves, self.merged
        bound, answer = float("inf"), True
        a, b = left, right
        while True:
            joined = merged.get((a, b))
            if joined is not None and rank[joined] < bound:
                answer = False
                break
            if rank[a] < 0 and rank[b] < 0:
                break
            if rank[a] > rank[b]:  # at equal merges the left one comes first
                bound, a = rank[a], halves[a][1]
            else:
                bound, b = rank[b] + 0.5, halves[b][0]
        if len(self.fits) >= self.keep:
            self.fits.clear()
        self.fits[key] = answer
        return answer

    def word(self, letters: str) -> list[int]:
        """Exact merges of one word of mapped bytes."""
        text = letters + END if self.suffix else letters
        if (only := self.whole.get(text)) is not None:
            return [only]
        longest: dict[int, int] = {}
        for end, (token, back) in self.auto.iter(text):  # ends come in order, so the last of a start is its longest
            longest[end - back] = token
        lengths, shorter, fits = self.lengths, self.shorter, self.fits
        out: list[int] = []
        dead, place, token, n = set(), 0, longest.get(0), len(text)
        while place < n:
            while token is not None:
                end = place + lengths[token]
                if (end == n or end in longest) and end not in dead:
                    if not out:
                        break
                    fit = fits.get((out[-1], token))
                    if self.compatible(out[-1], token) if fit is None else fit:
                        break
                token = shorter[token]
            if token is None:
                dead.add(place)
                if not out:
                    raise ValueError("a letter has no token")
                token = out.pop()
                place -= lengths[token]
                token = shorter[token]
                continue
            out.append(token)
            place = end
            token = longest.get(place)
        return out

    def chunk(self, chunk: str) -> tuple[int, str, str]:
        """Count, ids and decoded tokens, each joined by a space, of a stretch without white space."""
        got = self.older.get(chunk)
        if got is not None:  # asked for again: it moves to the newer half
            return self.keeps(chunk, got)
        got = self.mixed.get(chunk)
        if got is not None:
            return got
        if chunk.isascii():
            plain = chunk.lower()
            if chunk[-1] in ENDS and (head := plain[:-1]).isalpha():  # a word and the mark after it: two pieces
                n, ids, shown = self.known.get(head) or self.piece(head)
                m, mark, seen = self.known.get(chunk[-1]) or self.piece(chunk[-1])
                return n + m, f"{ids} {mark}", f"{shown} {seen}"
        else:  # letter by letter: no form for the end of a word
            plain = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        pieces = (plain,) if plain.isascii() and plain.isalpha() else self.pieces.findall(plain)
        if len(pieces) == 1:
            return self.piece(pieces[0])
        found = [self.known.get(p) or self.piece(p) for p in pieces]
        got = (sum([f[0] for f in found]), " ".join([f[1] for f in found]), " ".join([f[2] for f in found]))
        if len(chunk) < 100:
            if len(self.mixed) >= self.keep // 4:
                self.mixed.clear()
            self.mixed[chunk] = got
        return got

    def keeps(self, piece: str, got: tuple[int, str, str]) -> tuple[int, str, str]:
        if len(piece) < 100:
            if len(self.known) >= self.keep:
                self.older, self.known = self.known, {}
            self.known[piece] = got
        return got

    def piece(self, piece: str) -> tuple[int, str, str]:
        return self.keeps(piece, self.known.get(piece) or self.older.get(piece) or self.merge(piece))

    def merge(self, piece: str) -> tuple[int, str, str]:
        plain = piece.isascii() and piece.isprintable()
        ids = self.word(piece if plain else "".join(map(self.letters.__getitem__, piece.encode("utf-8", "replace"))))
        return len(ids), " ".join(map(self.numbers.__getitem__, ids)), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        offsets, blob = self.offsets, self.blob
        return " ".join([blob[offsets[i][0]: offsets[i][1]] for i in ids])

    def parts(self, text: str) -> list[tuple[int, str, str]]:
        if "<|" in text and self.named is not None:
            out, at = [], 0
            for m in self.named.finditer(text):
                out += self.parts_plain(text[at: m.start()])
                i = self.specials[m[0]]
                out.append((1, str(i), self.decode([i])))
                at = m.end()
            return out + self.parts_plain(text[at:])
        return self.parts_plain(text)

    def parts_plain(self, text: str) -> list[tuple[int, str, str]]:
        known, chunk = self.known, self.chunk
        cut = [c for c in self.cut.split(text) if c] if any(c in text for c in SEPARATORS) else text.split()
        return [known.get(c) or chunk(c) for c in cut]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in self.parts(text or "") for i in ids.split()]

    def digests(self, text: str | None) -> tuple[int, str, str]:
        parts = [p for p in self.parts(text or "") if p[0]]
        ids, shown = " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        return sum(p[0] for p in parts), sha(ids), sha(shown)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def encoded(docs: DataFrame, content: str, ids: bool = False, keep: int = KEEP) -> DataFrame:
    """doc_id, n_tokens and both digests for every row; with ids, the ids themselves too.

    The codec lives as long as its task: a Python worker that other stages use again keeps nothing of it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(content)  # one vocabulary file, of fixed size
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(batches):
        own = None
        for b in batches:
            if own is None:
                released()
                own = Codec(shared.value, keep)
            for at in range(0, b.num_rows, 256):  # a few texts at a time
                part = b.slice(at, 256)
                texts = part.column("text").to_pylist()
                n, hashes, decoded = zip(*(own.digests(t) for t in texts), strict=True)
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                if ids:
                    columns.append(pa.array([own.encode(t) for t in texts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), vocabulary())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: token counts and digests of every text that is left; a row for each row, null and empty texts have no tokens."""
    return encoded(docs, vocabulary(), keep=KEEP // 2)  # beside what earlier stages have left in the executor


QUERIES = {"op4_bpe": op4_bpe}
SQL: dict[str, str] = {}
