"""HTML main text by template deduction with equivalence classes of tokens.

The tokens of a page are the opening and closing tags of its block elements and the texts of its blocks, each told apart by its place (the path of open
elements). Over the pages of a host, tokens with the same occurrence vector (how often each page holds them) form an equivalence class; only those on
most pages of the host count. Two tests make a class valid:

* Order: a class is cut into pieces of tokens that follow each other, within the class, on nearly all of its pages; pieces that keep their order to
  each other are put together again. What moves about is a chain of its own.
* Nesting: all tokens of a round of a chain lie in one slot (between two neighbouring tokens) of the chain around it, the same on nearly all of its pages.
  Chains that fail are no template. The others, each with its parent and slot, are the tree of the host.

A token of a page belongs to the template if its chain stands in order and in its slot of the tree on that page; what is left is what the slots hold. Slots in
an element that is something else by name, role or class words (navigation, notice, advert, form and the like) are set aside, and where the
template or the page has an article the slots outside it. Names also break one tie: a paragraph, list, heading or the like that stands in an article
with no other kind of element between is its text, even if most pages share it.

Occurrence vectors are not gathered: a token's vector is represented by its number of pages, of occurrences and sums of hashes of (page, count), which Spark
adds up by host and token. Order and nesting are tested on all pages, from their tokens, and are counts by host as well.
Only classes that most pages of a host share reach the host's template, so a template is no larger than about twice a page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Land, landing, table, with_code
from .url_filter import host_of

#: A class counts if it is on at least this share of a host's pages.
SUPPORT = 0.5
#: Tokens have an order, and a chain has a slot, if it is the same on at least this share of their pages.
STEADY = 0.9
#: Pages of a host below which texts that repeat don't count as template text.
LEAST_PAGES = 4

#: Into how many shares the pages of each host are dealt to meet its template.
SHARES = 16

#: Pairs of pieces that a task counts at a time, and bits of a word of ``_pairs``.
CELLS, BITS = 1 << 20, 64

# fixed values: elements by what they are
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "template", "noscript", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
          "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "input", "dialog", "menu", "head", "svg", "canvas", "object", "audio", "video", "map",
               "script", "style", "template", "noscript", "textarea", "title", "iframe", "noembed", "noframes"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Words of a class or an id that mark an element as something other than the article.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
         "header", "masthead", "footer", "sidebar", "aside", "widget", "related", "recommended", "share", "sharing", "social", "cookie", "cookies", "consent", "gdpr", "notice", "popup",
         "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "form", "search", "comment", "comments", "disqus", "respond", "replies", "pagination", "pager", "skip"}
#: The same for an element that is an article by name.
ARTICLE_MARKS = {"ad", "ads", "advert", "advertisement", "sponsored", "promo", "related", "recommended", "comment", "comments", "reply", "replies"}
#: Elements that are closed by the next one of a kind, where they were left open.
CLOSERS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What closes an open paragraph when it begins.
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Within these an open element outside is not closed by one inside.
FENCES = {"table", "td", "th", "ul", "ol", "dl", "article", "section", "div", "body", "main", "aside", "nav", "header", "footer", "form"}

#: Elements that are the text of the article they stand in.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "pre", "blockquote"}
#: Kinds of tokens.
OPEN, CLOSE, TEXT = 1, 2, 3

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?", re.S)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_SPACES = re.compile(r"\s+")


class Element:
    """An open element: its name, its place in the template, and whether it is boilerplate by name, role or marks."""

    __slots__ = ("name", "place", "aside", "block")

    def __init__(self, name: str, place: str, aside: bool, block: int):
        self.name, self.place, self.aside, self.block = name, place, aside, block


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(raw):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return out


def _set_aside(name: str, attrs: dict[str, str]) -> bool:
    if name in BOILERPLATE or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    named = _CAMEL.sub(r"\1 \2", attrs.get("class", "") + " " + attrs.get("id", "")).lower()
    if name in ("html", "body"):
        return False
    return not (ARTICLE_MARKS if name in ("article", "main") else MARKS).isdisjoint(_WORDS.findall(named))


def scan(page: str | None) -> Iterator[tuple[str, int, bool, str | None]]:
    """A page in order: place of the innermost block, number of the block, whether set aside, and text. Tags of blocks come between, with ``OPEN`` or ``CLOSE`` as number and no text."""
    text, at = page or "", 0
    stack: list[Element] = []
    block = 0

    def slot(raw: str):
        inner = stack[-1].place if stack else ""
        return inner, block, any(e.aside for e in stack), raw

    while at < len(text):
        m = _TOKEN.search(text, at)
        stop = m.start() if m else len(text)
        if stop > at:
            yield slot(text[at:stop])
        if not m:
            return
        at = m.end()
        if not m[2]:
            continue  # comment, doctype, processing instruction
        name = m[2].lower()
        if m[1]:
            if name in (e.name for e in stack):
                while True:
                    e = stack.pop()
                    if e.name not in INLINE:
                        block += 1
                        yield e.place, CLOSE, e.aside, None
                    if e.name == name:
                        break
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        closed = CLOSERS.get(name, set()) | ({"p"} if name in ENDS_P else set())
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name in closed:
                for e in reversed(stack[i:]):
                    if e.name not in INLINE:
                        yield e.place, CLOSE, e.aside, None
                del stack[i:]
                break
            if stack[i].name in FENCES and stack[i].name not in closed:
                break
        if name not in INLINE:
            block += 1
            # open inline elements end with the block that they stand in
            while stack and stack[-1].name in INLINE:
                stack.pop()
        attrs = _attributes(m[3])
        if name == "br":
            yield slot(" ")
        if name in VOID:
            continue
        label = name + "".join(f".{c}" for c in sorted(set(attrs.get("class", "").split()))[:4])
        around = next((e.place for e in reversed(stack) if e.name not in INLINE), "")
        place = around if name in INLINE else f"{around}/{label}"
        stack.append(Element(name, place, _set_aside(name, attrs), block))
        if name not in INLINE:
            yield place, OPEN, stack[-1].aside, None


def clean(raw: str) -> str:
    """Text of a block: references decoded, white space to one space, trimmed."""
    return _SPACES.sub(" ", html.unescape(raw)).strip()


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) >> 1


@lru_cache(maxsize=50_000)
def _tag(kind: int, place: str, aside: bool) -> int:
    return _hash(kind, place, aside)


def tokens(page: str | None) -> list[tuple[int, int, str, bool, str]]:
    """The tokens of a page in order: hash, kind, place, whether set aside, and the text of a block."""
    out: list[tuple[int, int, str, bool, str]] = []
    held: list[str] = []
    last: tuple[str, int, bool] | None = None

    def flush() -> None:
        if held and (text := clean("".join(held))):
            out.append((_hash(TEXT, last[0], text), TEXT, last[0], last[2], text))
        held.clear()

    for place, block, aside, raw in scan(page):
        if raw is None:
            flush()
            out.append((_tag(block, place, aside), block, place, aside, ""))
            continue
        now = (place, block, aside)
        if now != last:
            flush()
        last = now
        held.append(raw)
    flush()
    return out


def sequences(pages: DataFrame) -> DataFrame:
    """``host, page, tokens``: the hashes of each page's tokens in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"host": batch["host"], "page": batch["page"], "tokens": [[t[0] for t in tokens(page)] for page in batch["html"]]})

    return pages.select("host", "page", "html").mapInPandas(run, "host string, page long, tokens array<long>")


def _added(rows: DataFrame, count, kinds: str, sums: int) -> DataFrame:
    """Rows of keys and numbers that ``count(held, row)`` adds up in a dictionary, over the rows of a task some at a time."""
    names = [k.split()[0] for k in kinds.split(", ")]

    def frame(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(*k, *v) for k, v in held.items()], columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                count(held, row)
                if len(held) > 50_000:
                    yield frame(held)
                    held = {}
        yield frame(held)

    return rows.mapInPandas(run, kinds).groupBy(*names[:-sums])


def vectors(seen: DataFrame) -> DataFrame:
    """``host, token, pages, n, vector``: each token's occurrence vector over the pages of its host, as a sum of hashes; token -1 counts the pages."""

    def count(held: dict, row) -> None:
        held.setdefault((row.host, -1), [0, 0, 0])[0] += 1
        for token, n in Counter(row.tokens.tolist()).items():
            own = held.setdefault((row.host, token), [0, 0, 0])
            own[0] += 1
            own[1] += n
            own[2] ^= _hash(row.page, n)

    found = _added(seen, count, "host string, token long, pages long, n long, vector long", 3)
    return found.agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.bit_xor("vector").alias("vector"))


def _met(pages: DataFrame, known: DataFrame, host: str = "host", page: str = "page") -> DataFrame:
    """Pages with the row of their host: the pages of a host are dealt out, its row goes to each share."""
    spread = pages.withColumn("__share", F.pmod(F.xxhash64(page), F.lit(SHARES)))
    copies = known.withColumnRenamed("host", "__at").withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return spread.join(copies, (F.col(host) == F.col("__at")) & (F.col("__share") == F.col("__part")), "left").drop("__share", "__at", "__part")


def _edges(seen: DataFrame, classes: DataFrame) -> DataFrame:
    """``host, before, token, n``: on how many pages each occurrence of a token has ``before`` as the token before it in its class."""
    maps = classes.groupBy("host").agg(F.collect_list(F.struct("token", "kind")).alias("t")).select("host", F.col("t.token").alias("ids"), F.col("t.kind").alias("kinds"))

    def count(held: dict, row) -> None:
        if row.ids is None:
            return
        kind, last, before = dict(zip(row.ids.tolist(), row.kinds.tolist())), {}, {}
        for token in row.tokens.tolist():
            if (k := kind.get(token)) is not None:
                one = last.get(k, -1)
                before[token] = one if before.get(token, one) == one else -1
                last[k] = token
        for token, one in before.items():
            if one >= 0:
                held.setdefault((row.host, one, token), [0])[0] += 1

    return _added(_met(seen, maps), count, "host string, before long, token long, n long", 1).agg(F.sum("n").alias("n"))


def pieces(host: pd.DataFrame) -> pd.DataFrame:
    """One row ``host, ids, chain, pos, kind, pages, n`` from a host's rows ``token, pages, n, kind, before``: a number for each piece, and by piece its class, pages and occurrences."""
    after = {b: t for b, t in zip(host["before"], host["token"]) if b >= 0}
    found, seen = [], set()
    # those that follow nothing begin a piece; tokens that follow each other in a circle have no order
    for row in sorted(host.itertuples(index=False), key=lambda r: (r.before >= 0, r.token)):
        own, at = [], row.token
        while at is not None and at not in seen:
            own.append(at)
            seen.add(at)
            at = after.get(at) if row.before < 0 else None
        if own:
            found.append((own, row.kind, row.pages, row.n))
    flat = [(t, c, i) for c, (own, *_) in enumerate(found) for i, t in enumerate(own)]
    return _row(host["host"].iloc[0], *zip(*flat), *list(zip(*found))[1:])


PIECES = "host string, ids array<long>, chain array<long>, pos array<long>, kind array<long>, pages array<long>, n array<long>"


def _row(host: str, *lists) -> pd.DataFrame:
    names = [k.split()[0] for k in PIECES.split(", ")]
    return pd.DataFrame({k: [v] for k, v in zip(names, (host, *(list(map(int, x)) for x in lists)))})


def members(kinds) -> dict[int, list[int]]:
    """The pieces of each class, in ascending order."""
    by_kind: dict[int, list[int]] = {}
    for c, k in enumerate(kinds):
        by_kind.setdefault(int(k), []).append(c)
    return by_kind


def _orders(seen: DataFrame, cut: DataFrame) -> DataFrame:
    """``host, kind, pages, size, share, at``: for each page and class in several pieces the pieces, by place in the class, as their first tokens come on the page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                several = {k: own for k, own in members(row.kind).items() if len(own) > 1}
                place = {c: (k, i) for k, own in several.items() for i, c in enumerate(own)}
                heads = {t: place[c] for t, c, p in zip(row.ids.tolist(), row.chain.tolist(), row.pos.tolist()) if p == 0 and c in place}
                orders: dict[int, list[int]] = {}
                for token in row.tokens.tolist():
                    if (known := heads.get(token)) is not None:
                        orders.setdefault(known[0], []).append(known[1])
                found += [(row.host, k, row.pages[several[k][0]], len(several[k]), row.page % SHARES, at) for k, at in orders.items()]
            yield pd.DataFrame(found, columns=["host", "kind", "pages", "size", "share", "at"])

    several = cut.where(F.size("kind") > F.size(F.array_distinct("kind")))
    return _met(seen, several).where("ids is not null").mapInPandas(run, "host string, kind long, pages long, size int, share int, at array<int>")


def in_turns(at: np.ndarray, low: int, counts: np.ndarray) -> None:
    """Adds a page to ``counts``, a row for each piece of a class from ``low`` on and a column for each piece: 1 where the one comes before the other, in turns where they repeat."""
    times = np.bincount(at, minlength=counts.shape[1])
    places, first = np.argsort(at, kind="stable"), np.cumsum(times) - times
    for n in np.unique(times[times > 0]).tolist():
        both = np.flatnonzero(times == n)
        one = both[(both >= low) & (both < low + len(counts))]
        x, y = (places[first[c][:, None] + np.arange(n)] for c in (one, both))
        before = x[:, :1] < y[:, 0]
        for i in range(1, n):
            if not before.any():
                break
            before &= (y[:, i - 1] < x[:, i : i + 1]) & (x[:, i : i + 1] < y[:, i])
        if before.any():
            counts[np.ix_(one - low, both)] += before


def _pairs(seen: DataFrame, cut: DataFrame, cells: int = CELLS) -> DataFrame:
    """``host, of, one, word, mask``: for piece ``one`` of class ``of`` the pieces that it comes before on nearly all of its pages, as bits of words; pieces by place in the class.

    The pairs of a class are counted in tiles of ``cells`` (or one row, if that is longer), each over the pages of its host one after another: a task holds one tile, however
    many pieces a class has.
    """
    tiles = F.least(F.col("size").cast("long"), F.ceil(F.col("size").cast("double") * F.col("size") / cells))
    dealt = _orders(seen, cut).withColumn("tiles", tiles.cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    # a class in many tiles is spread by them
    dealt = dealt.withColumn("share", F.pmod("share", F.greatest(F.lit(1), F.floor(F.lit(SHARES) / F.col("tiles"))).cast("int")))
    key = ["host", "kind", "tile", "share"]

    def rows(now: tuple, counts: np.ndarray, low: int) -> Iterator[pd.DataFrame]:
        step = max(1, cells // (8 * counts.shape[1]))
        for i in range(0, len(counts), step):
            found = [(now[0], now[1], now[4], low + i + j, two := np.flatnonzero(c), c[two]) for j, c in enumerate(counts[i : i + step])]
            yield pd.DataFrame([f for f in found if len(f[4])], columns=["host", "of", "pages", "one", "two", "n"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, counts, low = None, None, 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                now = (row.host, row.kind, row.tile, row.share, row.pages)
                if now != last:
                    if last is not None:
                        yield from rows(last, counts, low)
                    height = -(-row.size // row.tiles)
                    last, low = now, row.tile * height
                    counts = np.zeros((max(0, min(row.size, low + height) - low), row.size), np.int32)
                in_turns(row.at, low, counts)
        if last is not None:
            yield from rows(last, counts, low)

    counted = dealt.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, "host string, of long, pages long, one int, two array<int>, n array<long>")
    pairs = counted.select("host", "of", "pages", "one", F.explode(F.arrays_zip("two", "n")).alias("p")).groupBy("host", "of", "pages", "one", F.col("p.two").alias("two")).agg(F.sum("p.n").alias("n"))
    steady = pairs.where(F.col("n") >= STEADY * F.col("pages"))
    return steady.groupBy("host", "of", "one", F.floor(F.col("two") / BITS).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, two % {BITS})")).alias("mask"))


def steady_pairs(row) -> dict[int, np.ndarray]:
    """By class the pairs of its pieces in a steady order, from a host's row with the columns of ``_pairs``."""
    out: dict[int, np.ndarray] = {}
    if row["of"] is None:
        return out
    sizes = {k: len(own) for k, own in members(row["kind"]).items()}
    of, one, word = (np.asarray(row[c], np.int64) for c in ("of", "one", "word"))
    bits = np.unpackbits(np.asarray(row["mask"], "<i8").view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little").astype(bool)
    for k in np.unique(of).tolist():
        own = of == k
        held = np.zeros((sizes[k], -(-sizes[k] // BITS), BITS), bool)
        held[one[own], word[own]] = bits[own]
        out[k] = held.reshape(sizes[k], -1)[:, : sizes[k]]
    return out


def joined(host: pd.DataFrame) -> pd.DataFrame:
    """A host's row of pieces with the chains that pieces of a class in a steady order make, numbered from those on most pages and least often on a page."""
    row = host.iloc[0]
    pairs = steady_pairs(row)
    own: dict[int, list[int]] = {}
    for t, c in zip(row["ids"], row["chain"]):
        own.setdefault(c, []).append(t)
    found = []
    for kind, some in members(row["kind"]).items():
        if (before := pairs.get(kind)) is None:
            # no two in a steady order
            chains = [[c] for c in some]
        else:
            either, steady, held, kept = before | before.T, before.sum(0) + before.sum(1), [], np.zeros(len(some), bool)
            for i in sorted(range(len(some)), key=lambda i: (-steady[i], -len(own[some[i]]), own[some[i]][0])):
                if (either[i] | ~kept).all():
                    held.append(i)
                    kept[i] = True
            # of those held each comes before as many as follow it
            turns = np.argsort(before[np.ix_(held, held)].sum(0), kind="stable")
            chains = [[some[held[i]] for i in turns], *([c] for c, k in zip(some, kept) if not k)]
        for chain in chains:
            found.append((-row["pages"][chain[0]], row["n"][chain[0]], [t for c in chain for t in own[c]], kind))
    found.sort(key=lambda x: (x[0], x[1], -len(x[2]), x[2][0]))
    flat = [(t, c, i) for c, (_, _, tokens_, _) in enumerate(found) for i, t in enumerate(tokens_)]
    return _row(row["host"], *zip(*flat), [x[3] for x in found], [-x[0] for x in found], [x[1] for x in found])


class Round:
    """One run through a chain on a page: the position due, where its last token is, the indexes of its tokens, its slot, and whether it stayed in it."""

    __slots__ = ("chain", "due", "last", "at", "slot", "whole")

    def __init__(self, chain: int, slot: tuple):
        self.chain, self.due, self.last, self.at, self.slot, self.whole = chain, 0, -1, [], slot, True


def rounds(sequence: list[int], of: dict[int, tuple[int, int]], sizes: dict[int, int]) -> list[Round]:
    """The rounds of chains on a page. A slot is the innermost one of lower-numbered chains: chain, position and where it begins; (-1, -1, -1) is the page."""
    out: list[Round] = []
    live: dict[int, Round] = {}
    for i, token in enumerate(sequence):
        if (known := of.get(token)) is None:
            continue
        c, p = known
        around = max((r for k, r in live.items() if k < c), key=lambda r: r.last, default=None)
        slot = (-1, -1, -1) if around is None else (around.chain, around.due, around.last)
        if p == 0:
            live[c] = now = Round(c, slot)
            out.append(now)
        elif (now := live.get(c)) is None or p < now.due:
            continue  # out of order on this page
        now.whole = now.whole and now.slot == slot
        now.due, now.last = p + 1, i
        now.at.append(i)
        if p == sizes[c] - 1:
            del live[c]
    return out


def _slots(seen: DataFrame, chained: DataFrame) -> DataFrame:
    """``host, of, parents, places``: for each chain that nests the chain around it and the position of its slot, the same on nearly all pages of the chain."""

    def count(held: dict, row) -> None:
        if row.ids is None:
            return
        of, sizes = lookup(row)
        found: dict[int, tuple[int, int]] = {}
        for r in rounds(row.tokens.tolist(), of, sizes):
            own = r.slot[:2] if r.whole else (-2, -2)
            found[r.chain] = own if found.get(r.chain, own) == own else (-2, -2)
        for c, own in found.items():
            held.setdefault((row.host, c, *own), [0])[0] += 1

    rows = _added(_met(seen, chained), count, "host string, of long, parent long, place long, n long", 1).agg(F.sum("n").alias("n"))
    best = rows.groupBy("host", "of").agg(F.max(F.struct("n", "parent", "place")).alias("b"), F.sum("n").alias("n"))
    kept = best.where((F.col("b.n") >= STEADY * F.col("n")) & (F.col("b.parent") > -2))
    held = kept.groupBy("host").agg(F.collect_list(F.struct("of", "b.parent", "b.place")).alias("t"))
    return held.select("host", F.col("t.of").alias("of"), F.col("t.parent").alias("parents"), F.col("t.place").alias("places"))


def lookup(row) -> tuple[dict[int, tuple[int, int]], dict[int, int]]:
    """Chain and position by token, and the sizes of chains."""
    chain = row.chain.tolist()
    return dict(zip(row.ids.tolist(), zip(chain, row.pos.tolist()))), Counter(chain)


def templates(pages: DataFrame, land: Land, support: float = SUPPORT, least: int = LEAST_PAGES) -> DataFrame:
    """``host, worded, ids, chain, pos, of, parents, places``: by host the chains of its template, and the slots of those that nest.

    Classes are tokens of a host with equal vectors, on ``support`` of the host's pages or more; a host with less than
    ``least`` pages has a template of tags only (``worded`` is false).
    """
    seen = land.compressed(sequences(pages))
    found = land.compressed(vectors(seen))
    hosts = found.where("token = -1").select("host", F.col("pages").alias("all_pages"))
    common = found.where("token >= 0").join(hosts, "host").where(F.col("pages") >= support * F.col("all_pages"))
    classes = land(common.select("host", "token", "pages", "n", F.xxhash64("pages", "n", "vector").alias("kind")))
    edges = _edges(seen, classes)
    ordered = classes.join(edges.withColumnRenamed("n", "follows"), ["host", "token"], "left").groupBy("host", "token", "pages", "n", "kind").agg(
        F.coalesce(F.max(F.when(F.col("follows") >= STEADY * F.col("pages"), F.col("before"))), F.lit(-1)).alias("before"))
    cut = land(ordered.groupBy("host").applyInPandas(pieces, PIECES))
    pairs = _pairs(seen, cut).groupBy("host").agg(F.collect_list(F.struct("of", "one", "word", "mask")).alias("p")).select(
        "host", *(F.col(f"p.{c}").alias(c) for c in ("of", "one", "word", "mask")))
    chained = land(cut.join(pairs, "host", "left").groupBy("host").applyInPandas(joined, PIECES)).select("host", "ids", "chain", "pos")
    worded = hosts.select("host", (F.col("all_pages") >= least).alias("worded"))
    return worded.join(chained, "host", "left").join(_slots(seen, chained), "host", "left")


def main_blocks(page: str | None, worded: bool, of: dict, sizes: dict, tree: dict[int, tuple[int, int]]) -> list[str]:
    """The blocks of the slots that hold the main text."""
    found = tokens(page)
    held: set[int] = set()
    for r in rounds([t[0] for t in found], of, sizes):
        # a chain around that doesn't nest itself fixes no slot
        if r.chain in tree and (r.whole and r.slot[:2] == tree[r.chain] or tree[r.chain][0] >= 0 and tree[r.chain][0] not in tree):
            held.update(r.at)
    texts = [(i, place, text) for i, (_, kind, place, aside, text) in enumerate(found) if kind == TEXT and not aside]
    inside = lambda p, a: p == a or p.startswith(a + "/")
    named = lambda p: p.rsplit("/", 1)[-1].split(".")[0]
    own = {place for i, (_, kind, place, _, _) in enumerate(found) if kind == OPEN and i in held and named(place) in ("article", "main")}
    own = {a for a in own if any(inside(p, a) for _, p, _ in texts)}
    if not own:  # a page that the template doesn't fit, or a host without article: any article element of its own, else the whole page
        own = {m[0] for _, p, _ in texts if (m := re.match(r".*?/(?:article|main)(?:\.[^/]*)?(?=/|$)", p))}

    def prose(place: str) -> bool:
        for step in reversed(place.split("/")):
            if (name := step.split(".")[0]) not in PROSE:
                return name == "article"
        return False

    kept = [(i, p, t) for i, p, t in texts if not own or any(inside(p, a) for a in own)]
    return [t for i, p, t in kept if not worded or i not in held or prose(p)]


def extract(pages: DataFrame, land: Land, support: float = SUPPORT) -> DataFrame:
    """Adds ``text`` and ``n_chars`` to rows with ``page_id, url, html``; columns of these names are replaced.

    A null or empty page has an empty text. Pages of null or hostless urls share a template. Cut-off pages are read as far as they go.
    """
    with_code(pages.sparkSession)
    names = [c for c in pages.columns if c not in ("text", "n_chars")]
    hosted = pages.select(*names).withColumn("__host", host_of(F.col("url"))).withColumn("__page", F.xxhash64("page_id", "url"))
    seen = hosted.select(F.col("__host").alias("host"), F.col("__page").alias("page"), "html")
    known = templates(seen, land, support)
    fields = [c for c in known.columns if c != "host"]
    known = known.select("host", F.struct(*fields).alias("__tree"))

    @F.pandas_udf("string")
    def text(page: pd.Series, trees: pd.DataFrame) -> pd.Series:
        # a null list means a host without chains, or without any that nest
        out = []
        for html_, row in zip(page, trees.itertuples(index=False)):
            of, sizes = lookup(row) if row.ids is not None else ({}, {})
            tree = dict(zip(row.of.tolist(), zip(row.parents.tolist(), row.places.tolist()))) if row.of is not None else {}
            out.append("\n\n".join(main_blocks(html_, bool(row.worded), of, sizes, tree)))
        return pd.Series(out, dtype=object)

    out = _met(hosted, known, "__host", "__page").withColumn("text", text("html", "__tree"))
    return out.select(*names, "text", F.char_length("text").cast("long").alias("n_chars"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extract(table(spark, sf_dir, "pages"), landing(spark)).select("page_id", "url", "text", "n_chars")
