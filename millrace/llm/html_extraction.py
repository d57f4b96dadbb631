"""HTML extraction by equivalence-class template deduction.

1. Each page is a sequence of tokens: tags with the path that leads to them, and blocks of
   text with their path (headings of articles excepted, as "Summary" may head each article). For each host and token, the pages that hold it,
   its count, its mean place and text below it, and a digest of its occurrence vector (which
   page, how often) are aggregated; the digest is a sum over different pages, so no page list
   is kept and repeated rows count as one page.
2. Tokens of a host with the same vector form an equivalence class. Classes that hold on
   SUPPORT of the host's pages are valid if their places nest: a class lies in one gap of
   another or apart from it; crossing classes are left out. Text inside articles counts from
   COMMON of the pages. A host has at most (tokens of a
   mean page / SUPPORT) such tokens, so templates are bounded whatever the number of pages.
3. On each page the tokens of the template leave slots. Text that is itself template is
   dropped, slots below menus, footers, adverts, forms, comments and the like are dropped,
   and of the rest the slots below the template's article element are the page's text. Where
   template text is most of an article, the article is a copy of others and stays whole. One
   h1 before an article that has no heading of its own belongs to it.

Words of class, id and role mark divisions, lists and tables only, never headings, quotes or
running text; a paragraph goes only if a whole name of it says advert. Inside an article a name
marks only if all its words are marks or words of layout ("share-price" is none). An article
inside another that has text of its own is a reader's comment.

A page without that element (or on a host with fewer than LEAST_PAGES different pages) is cut
by its own slots: an article or main element that holds most of them, else the deepest element
beside which only short or linked text stands. Paths are hashes of element names and class
words without digits, so nesting of any depth costs a step an element. Defined results: a null
or empty html gives an empty text; a null url is a host of its own; repeated rows are read
alike; unclosed, cut off or misnested markup and stray quotes are read as browsers do.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SUPPORT, LEAST_PAGES, MAIN_SHARE = 0.5, 4, 0.75
#: Share of a host's pages from which text inside articles is template: near copies may be many on a small host.
COMMON = 0.9
#: Characters from which a block counts as running text.
RUNNING = 80
#: Template tokens up to which all templates are sent to every task; beyond it they are joined by host.
SENT_TOKENS, SALTS = 200_000, 32

#: Elements by how they are read, and words of class, id and role that mark what is not the article.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style noscript template textarea iframe svg title select".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q s samp small span strike strong sub sup time tt u var wbr".split())
HEAD = set("base link meta noscript script style template title".split())
ASIDE = set("nav header footer aside form button head menu dialog fieldset".split())
MARKS = set("nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus reply replies respond related recommended recommendations share sharing social breadcrumb breadcrumbs pagination pager widget search toolbar skip".split())
ADVERT_WORDS = set("ad ads advert adverts advertisement advertising sponsored".split())
LAYOUT_WORDS = set("site page main left right top bottom post posts story stories article articles entry area list box bar section wrap wrapper container block button buttons link links form item items slot unit inner outer content body text title group row column col panel module thread reader readers user users inline sticky".split())
MAIN_WORDS = set("article content entry main post story".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = set("p blockquote pre figcaption dd dt".split()) | HEADINGS
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
HOLDS = {"p": set("article body div section main td th li ul ol blockquote table nav header footer aside form".split()), "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

ATTRIBUTES = r"(?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+|=)*+"
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)({ATTRIBUTES})(?:>|\Z)", re.S)
NAMED = re.compile(r"(?<![^\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _hash(*parts) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("\n".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


class Block:
    """A stretch of text between block borders: its innermost element, characters in links, and its place."""

    __slots__ = ("aside", "element", "linked", "place", "text")

    def __init__(self, text, element, linked, aside, place):
        self.text, self.element, self.linked, self.aside, self.place = text, element, linked, aside, place


class Element:
    """An element: its parent's number, name, hashed path, whether it or one above is no article, whether it is below an article, and the element whose block it is in."""

    __slots__ = ("article", "aside", "block", "name", "path", "place", "up")

    def __init__(self, up, name, path, aside, article, place, block):
        self.up, self.name, self.path, self.aside, self.article, self.place, self.block = up, name, path, aside, article, place, block


def _marks(attributes: str, name: str = "div", inside: bool = False) -> tuple[bool, list[str]]:
    """Whether class, id or role mark an element (inside an article or not) as no article, and the words of its classes without digits."""
    marked, words = False, set()
    for m in NAMED.finditer(attributes):
        for one in (m[2] or m[3] or m[4] or "").split():
            own = {w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", one).lower()) if w}
            hits = own & MARKS
            if name == "p":
                hits &= ADVERT_WORDS
            if name in INLINE or (name in TEXTUAL and name != "p") or ((inside or name == "p") and own - MARKS - LAYOUT_WORDS):
                hits = set()
            marked |= bool(hits) and not (hits == {"header"} and own & MAIN_WORDS)  # the head of an article is part of it
            if m[1].lower() == "class":
                words |= own
    return marked, sorted(words)


def read(html: str | None) -> tuple[list[Element], list[Block]]:
    """Elements (the first is the page) and blocks of a page; tag soup is closed as browsers close it."""
    html = html or ""
    elements = [Element(0, "", 0, False, False, 0, 0)]
    stack: list[int] = []  # numbers of the open elements
    open_names: dict[str, int] = {}
    blocks, pieces = [], []
    at = place = links = linked = 0

    def name_of(n):
        return elements[n].name

    def put(text):
        nonlocal linked
        pieces.append(text)
        linked += len(text) if links else 0

    def flush():
        nonlocal place, linked
        text = " ".join(entities.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            place += 1
            blocks.append(Block(text, elements[stack[-1]].block if stack else 0, min(linked, len(text)), bool(stack) and elements[stack[-1]].aside, place))
        linked = 0

    def close(k):
        nonlocal links
        for n in stack[k:]:
            open_names[name_of(n)] -= 1
            links -= name_of(n) == "a"
        del stack[k:]

    while at < len(html):
        m = TAG.search(html, at)
        if not m:
            put(html[at:])
            break
        put(html[at: m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name or (open_names.get("math") and name != "math"):  # a formula is text within its line
            continue
        if m[1]:  # an end tag closes its element and what is open inside it
            if name not in INLINE and name not in RAW:
                flush()
            if open_names.get(name):
                close(next(k for k in range(len(stack) - 1, -1, -1) if name_of(stack[k]) == name))
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name not in INLINE and name != "br":
            flush()
        if name == "br":
            put(" ")
        if open_names.get("head") and name not in HEAD:  # the head ends where the page begins
            close(next(k for k, n in enumerate(stack) if name_of(n) == "head"))
        if name in CLOSES and any(open_names.get(c) for c in CLOSES[name]):  # an open element of the kind ends here, unless another list, cell or article holds it
            for k in range(len(stack) - 1, -1, -1):
                if name_of(stack[k]) in HOLDS[name]:
                    break
                if name_of(stack[k]) in CLOSES[name]:
                    close(k)
                    break
        if name in VOID or (m[3].rstrip().endswith("/") and name not in INLINE):
            continue
        up = stack[-1] if stack else 0
        above = elements[up]
        marked, words = _marks(m[3], name, above.article) if m[3] else (False, [])
        top = name in {"body", "html", "article", "main"}
        aside = above.aside or (marked and not top) or (name in ASIDE and not (name == "header" and above.article))
        if name not in INLINE:
            place += 1
        path = above.path if name in INLINE else _hash(above.path, name, *([] if top else words))
        stack.append(len(elements))
        open_names[name] = open_names.get(name, 0) + 1
        links += name == "a"
        elements.append(Element(up, name, path, aside, above.article or name in {"article", "main"}, place, above.block if name in INLINE else len(elements)))
    flush()
    _comments(elements, blocks)
    return elements, blocks


def _comments(elements: list[Element], blocks: list[Block]) -> None:
    """Marks articles inside an article that has text of its own: readers' comments."""
    holder = [0] * len(elements)  # the innermost article that holds an element, itself included
    for n, e in enumerate(elements):
        holder[n] = n if e.name == "article" else holder[e.up] if n else 0
    inner = {n for n, e in enumerate(elements) if e.name == "article" and holder[e.up]}
    if not inner:
        return
    own = {holder[b.element] for b in blocks if not b.aside and elements[b.element].name not in HEADINGS}
    below = [False] * len(elements)
    for n, e in enumerate(elements):
        below[n] = n > 0 and (below[e.up] or (n in inner and holder[e.up] in own))
        e.aside |= below[n]
    for b in blocks:
        b.aside |= below[b.element]


def _below(elements: list[Element], blocks: list[Block]) -> list[int]:
    """Characters of the blocks below each element."""
    below = [0] * len(elements)
    for b in blocks:
        below[b.element] += len(b.text)
    for n in range(len(elements) - 1, 0, -1):  # parents come before their children
        below[elements[n].up] += below[n]
    return below


def _host(url) -> "F.Column":
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def page_tokens(html: str | None) -> list[tuple]:
    """token, text (or tag), article, count, mean place, characters of article-like text below it: the page's row in the occurrence vectors."""
    elements, blocks = read(html)
    below = _below(elements, [b for b in blocks if not b.aside])
    got: dict[tuple, list] = {}
    for n, e in enumerate(elements):
        if n and e.name not in INLINE:
            one = got.setdefault((e.path, False, e.name in {"article", "main"}), [0, 0, 0])
            one[0] += 1
            one[1] += e.place
            one[2] += below[n]
    for b in blocks:
        if b.aside or not elements[b.element].article or elements[b.element].name not in HEADINGS:
            one = got.setdefault((_hash(elements[b.element].path, b.text), True, elements[b.element].article and not b.aside), [0, 0, 0])
            one[0] += 1
            one[1] += b.place
    return [(*t, c, p / c, x) for t, (c, p, x) in got.items()]


def occurrences(pages: DataFrame) -> DataFrame:
    """host, token, text, article, pages, count, place, below, vector: one row for each token of a host."""

    def run(batches):
        for pdf in batches:
            out = [(h, r, *t) for h, html, r in zip(pdf["host"], pdf["html"], pdf["page"], strict=True) for t in page_tokens(html)]
            yield pd.DataFrame(out, columns=["host", "page", "token", "text", "article", "count", "place", "below"])

    each = pages.select(_host(F.col("url")).alias("host"), "html", F.xxhash64("html").alias("page"))
    each = each.mapInPandas(run, "host string, page long, token long, text boolean, article boolean, count long, place double, below long")
    once = each.groupBy("host", "token", "page").agg(*(F.max(c).alias(c) for c in ("text", "article", "count", "place", "below")))  # a page that repeats counts once
    seen = F.xxhash64("page", "count")
    return once.groupBy("host", "token").agg(
        F.max("text").alias("text"), F.max("article").alias("article"), F.count("*").alias("pages"), F.sum("count").alias("count"), F.avg("place").alias("place"), F.sum("below").alias("below"),
        F.concat_ws(":", F.sum(F.shiftright(seen, 32)), F.sum(seen.bitwiseAND(F.lit(0xFFFFFFFF)))).alias("vector"),
    )


def nested(classes: pd.DataFrame) -> pd.DataFrame:
    """The tokens of one host's classes that nest: larger classes first, a class that crosses an accepted one is left out."""
    groups = sorted((g.sort_values("place") for _, g in classes.groupby("vector")), key=lambda g: (-len(g), g["place"].iloc[0]))
    accepted, kept = [], []
    for g in groups:
        places = g["place"].to_numpy()
        apart = True
        for other in accepted:
            gaps = np.unique(np.searchsorted(other, places))
            back = np.unique(np.searchsorted(places, other))
            if len(gaps) > 1 and len(back) > 1:  # neither lies in one gap of the other
                apart = False
                break
        if apart:
            accepted.append(places)
            kept.append(g)
    return pd.concat(kept) if kept else classes.iloc[:0]


def templates(pages: DataFrame) -> DataFrame:
    """host, tokens (the text of valid classes), main (the path of the element that holds the host's articles, or null)."""
    totals = pages.select(_host(F.col("url")).alias("host"), F.xxhash64("html").alias("page")).distinct().groupBy("host").agg(F.count("*").alias("total"))
    frequent = occurrences(pages).join(totals, "host").where((F.col("total") >= LEAST_PAGES) & (F.col("pages") >= F.when(F.col("text") & F.col("article"), COMMON).otherwise(SUPPORT) * F.col("total")))

    def deduce(pdf: pd.DataFrame) -> pd.DataFrame:
        valid = nested(pdf)
        tags = valid[~valid["text"] & (valid["count"] == valid["pages"])]
        clear = tags[tags["article"] & (tags["below"] > 0) & (tags["below"] >= MAIN_SHARE * (tags["below"].max() if len(tags) else 0))]
        main = int(clear.loc[clear["place"].idxmax(), "token"]) if len(clear) else None
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "tokens": [list(valid.loc[valid["text"], "token"])], "main": pd.array([main], dtype="Int64")})

    # a host's tokens on half of its pages are at most twice those of a mean page
    return frequent.groupBy("host").applyInPandas(deduce, "host string, tokens array<long>, main long")


def _cut(elements: list[Element], free: list[Block]) -> set[int]:
    """The elements that hold the page's own text, found on the page alone."""
    below = _below(elements, free)
    outer = [n for n, e in enumerate(elements) if e.name in {"article", "main"} and below[n] and not elements[e.up].article]
    if outer and sum(below[n] for n in outer) >= SUPPORT * below[0]:
        most = max(outer, key=below.__getitem__)
        return {most} if below[most] >= MAIN_SHARE * sum(below[n] for n in outer) else set(outer)
    running, under = [0] * len(elements), {}
    for b in free:
        running[b.element] += (elements[b.element].name in TEXTUAL or len(b.text) >= RUNNING) and 2 * b.linked <= len(b.text)
    for n in range(len(elements) - 1, 0, -1):
        running[elements[n].up] += running[n]
        if below[n] >= MAIN_SHARE * below[0] and elements[n].name not in TEXTUAL | INLINE:
            under[elements[elements[n].up].block] = n  # at most one child can hold so much
    here = 0
    while here in under and running[under[here]] == running[here]:
        here = under[here]
    return {here}


def extract(html: str | None, tokens: frozenset[int] = frozenset(), main: int | None = None) -> str:
    """The text of the slots that the template leaves below the main element."""
    elements, blocks = read(html)
    free = [b for b in blocks if not b.aside]
    if tokens:
        fixed = {b.place for b in free if _hash(elements[b.element].path, b.text) in tokens}
        told = [b for b in free if elements[b.element].article]
        if sum(len(b.text) for b in told if b.place in fixed) > SUPPORT * sum(len(b.text) for b in told):
            fixed -= {b.place for b in told}  # a copy of other articles of the host
        free = [b for b in free if b.place not in fixed]
    if not free:
        return ""
    inside = {n for n, e in enumerate(elements) if e.path == main and e.name not in INLINE} if main is not None else set()
    for tops in (inside, None):
        tops = _cut(elements, free) if tops is None else tops  # the page does not follow the template
        held = [False] * len(elements)
        for n, e in enumerate(elements):
            held[n] = n in tops or (n > 0 and held[e.up])
        found = [b for b in free if held[b.element]]
        if found:
            if not any(elements[b.element].name == "h1" for b in found) and elements[found[0].element].name not in HEADINGS:
                heads = [b for b in free if elements[b.element].name == "h1" and b.place < found[0].place]
                found = (heads if len(heads) == 1 else []) + found
            return "\n\n".join(b.text for b in found)
    return ""


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    fields = pages.schema
    pages = pages.select("page_id", "url", "html")
    deduced = stored(templates(pages))
    schema = f"page_id {fields['page_id'].dataType.simpleString()}, url {fields['url'].dataType.simpleString()}, text string, n_chars long"
    rows = pages.withColumn("host", _host(F.col("url")))
    size = deduced.agg(F.sum(F.size("tokens") + 1)).first()[0] or 0
    if size <= SENT_TOKENS:  # one row for each host, at most SENT_TOKENS tokens in all
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: (frozenset(r["tokens"]), r["main"]) for r in deduced.collect()})

        def run(batches):
            for pdf in batches:
                texts = [extract(html, *sent.value.get(host, (frozenset(), None))) for html, host in zip(pdf["html"], pdf["host"], strict=True)]
                yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

        return rows.mapInPandas(run, schema)

    def run_joined(batches):
        for pdf in batches:
            texts = [extract(html, frozenset(() if t is None else t), None if pd.isna(m) else int(m)) for html, t, m in zip(pdf["html"], pdf["tokens"], pdf["main"], strict=True)]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    salted = deduced.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return met.select("page_id", "url", "html", "tokens", F.col("main").cast("string").alias("main")).mapInPandas(run_joined, schema)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


QUERIES = {"op1_html_extraction": op1_html_extraction}
SQL: dict[str, str] = {}
