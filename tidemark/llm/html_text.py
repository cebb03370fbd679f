"""Main text of web pages by wrappers inferred for each host.

A page is read as a stream of block tags and text slots; inline tags are part of
the text. Groups that repeat on the spot are folded, ``<li>#</li><li>#</li>``
into ``(<li>#</li>)+``, which leaves few different streams on a host. These are
aligned one after the other: what two streams have in common stays, what only one
has becomes optional, and optional groups that now stand beside their like are
folded again. The result is the host's wrapper, an expression of tags, slots,
``( )?`` and ``( )+`` without alternatives.

Every slot of a wrapper knows how much text the pages have there, how much of it
is linked, and whether it is the same on all pages. The main text is what stands
in the slots of the article. Slots under menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and comments are never part of it. A
class or id counts as a whole (``sidebar``, not ``with-sidebar``); inside an
article ids count for nothing, and headings and text blocks are never dropped by
name. Of several articles on a page the one with most text that is no link is the
story; those that lead elsewhere by links, and comments marked up as articles, go.
Where the main element around them has more text of its own, on the page and on
all pages of the host, that is the story. On a page without an article or main element, slots named like an article are
taken alone if they hold at least half of the text left over on the host's pages;
else the other slots count too, unless they are the same on all pages of the host
or consist of links.

Pages of a host are first folded into their different streams in the task that
reads them, then aligned in a tree: parts of about ``FAN`` streams, then parts of
the results, until a host has one wrapper, so a host with most of the pages is not
the work of one task, however many streams it has.

Edge cases: null, empty and text-free pages have an empty text; broken markup is
read as far as it goes, without closing tags where need be; a page without a
usable url belongs to the host ``""``; repeated rows are extracted each; other
columns pass through :func:`extract`.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.rows import quoted, with_arrow_column
from tidemark.session import cut

#: Streams of a host that are aligned in one part, on the average.
FAN = 32

#: Longest group, in tokens, that is looked for next to itself.
PERIOD = 24

#: Share of linked characters from which a slot outside any article is a menu.
LINKED = 0.5

#: Pages that must agree before a slot outside any article counts as fixed.
AGREE = 3

_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe svg math canvas object textarea title select".split())
_DROPPED = frozenset("nav footer aside form button menu dialog head".split())
_DROPPED_ROLES = frozenset("navigation contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_DROPPED_NAMES = frozenset(
    (
        "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar nav navbar navigation menu "
        "breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
        "comment comments disqus respond replies share sharing social related recommended pagination pager toolbar copyright login search"
    ).split()
)
_COMMENTS = frozenset("comment comments disqus reply replies respond".split())
#: Words beside a dropped one that leave it what it is: ``comment-list``, ``ad-block``; and more for comments alone.
_AROUND = frozenset("area bar block box container item items list panel section thread widget wrap wrapper".split())
_AROUND_COMMENTS = _AROUND | frozenset("author body card content entry meta post text user".split())
#: Dropped only outside an article, which may have a header of its own.
_OUTER = frozenset("header banner masthead topbar".split())
_MAIN_NAMES = frozenset("article content main maincontent post entry story".split())
_MAIN_WORDS = _MAIN_NAMES | {"body", "text"}
#: Text of their own, whose id is a link target and says nothing about them.
_TEXTS = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd blockquote pre table td th figure".split())
#: A new one of these ends an open one.
_ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())

# no repeat gives back what it took, so an attempt that fails costs no more than the rest of the page
_MARKED = r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)"
_TOKEN = re.compile(_MARKED + r"""((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_UNQUOTED = re.compile(_MARKED + r"([^>]*+)>", re.S)

#: Lengths of a page that may be read in vain for ends of quotes.
ATTEMPTS = 16

_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[a-z]+")


def _attributes(source: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(source)} if source.strip(" /") else {}


@lru_cache(maxsize=1 << 14)
def _names(source: str) -> tuple[bool, bool, bool, bool]:
    """Whether one of these names is dropped, dropped outside an article, an article's or a comment's: with all its words."""
    found = [words for words in map(set, map(_NAME.findall, source.split())) if words]
    main = any(words <= _MAIN_WORDS and words & _MAIN_NAMES for words in found)
    comment = any(words & _COMMENTS and words <= _COMMENTS | _AROUND_COMMENTS for words in found)
    dropped = comment or any(words & _DROPPED_NAMES and words <= _DROPPED_NAMES | _AROUND for words in found)
    return dropped, any(words <= _OUTER for words in found), main, comment


def _rank(name: str, attributes: dict[str, str], inside: int) -> int:
    """Rank of text in an element: -1 dropped, 0 none, 1 named like, 2 main part, 3 article; ``inside`` is its parent's."""
    if inside < 0 or name in _DROPPED or name in _RAW:
        return -1
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""):
        return -1
    role = attributes.get("role", "")
    classes, ids = attributes.get("class", ""), attributes.get("id", "")
    if inside == 3 or name in _TEXTS:
        ids = ""
    dropped, outer, main, comment = _names(f"{classes} {ids}")
    by_name = name not in ("body", "html", "article", "main") and not main and not (inside == 3 and name in _TEXTS)
    if role in _DROPPED_ROLES or (dropped and by_name):
        return -1
    if inside == 0 and (name in _OUTER or role in _OUTER or (outer and not main)) and name not in ("body", "html"):
        return -1
    if name == "article" or role == "article":
        if comment:  # a comment beside a story is no part of it, and one outside all stories no story
            return -1 if inside else 0
        return 3
    if name == "main" or role == "main":
        return max(inside, 2)
    if main and name not in ("body", "html"):
        return max(inside, 1)
    return inside


def _search(page: str) -> Callable[[int], re.Match[str] | None]:
    """The next comment, declaration or tag from a place on; in order, the whole page takes time linear in its length.

    Quotes hide a ``>`` in a tag. A tag that its quotes would leave open to the end
    of the page ends at its next ``>``. Each such tag costs the reading of the rest;
    after ``ATTEMPTS`` lengths of the page, quotes hide nothing in what is left.
    """
    last, spare = page.rfind(">"), ATTEMPTS * len(page)

    def search(at: int) -> re.Match[str] | None:
        nonlocal spare
        while (at := page.find("<", at)) >= 0:
            if at > last and (at := page.find("<!--", at)) < 0:  # only a comment ends without it
                return None
            found = _TOKEN.match(page, at) if spare > 0 else None
            if not found and (found := _UNQUOTED.match(page, at)):
                spare -= len(page) - at
            if found:
                return found
            at += 1
        return None

    return search


def read(page: str) -> tuple[list[str], list[tuple[str, int]], list[int]]:
    """Stream of a page, the text and linked characters of each slot, and its innermost article; a slot is ``#`` and its rank.

    Articles are numbered from 1 in page order; 0 is none.
    """
    stream: list[str] = []
    slots: list[tuple[str, int]] = []
    articles: list[int] = []
    open_tags: list[tuple[str, int, int]] = []
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()
    parts: list[str] = []
    linked = links = at = numbered = 0
    last = page.rfind(">") + 1

    def end() -> str:
        ended = open_tags.pop()[0]
        opened[ended] -= 1
        return ended

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            stream.append(f"#{open_tags[-1][1] if open_tags else 0}")
            slots.append((text, linked))
            articles.append(open_tags[-1][2] if open_tags else 0)
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text)
            parts.append(text)
            if links:
                linked += len(text)

    search = _search(page)
    while True:
        found = search(at)
        take(page[at : found.start() if found else len(page)])
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if name in _INLINE:
            links = max(0, links + (-1 if found[1] else 1)) if name == "a" else links
            continue
        flush()
        links = 0
        if found[1]:
            if opened[name]:
                while end() != name:
                    pass
                stream.append(f"/{name}")
            continue
        attributes = _attributes(found[3])
        ends = _ENDS.get(name, ("p",) if name in _BLOCKS else ())
        if open_tags and open_tags[-1][0] in ends:
            end()
        rank = _rank(name, attributes, open_tags[-1][1] if open_tags else 0)
        stream.append(f"{name}:{rank}")
        if name in _RAW:
            # no close from here on is none later on
            close = None if name in unclosed else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at, last)
            if not close:
                unclosed.add(name)
            at = close.end() if close else (len(page) if name in ("script", "style") else at)
        elif name not in _VOID and not found[3].rstrip().endswith("/"):
            own = rank == 3 and (name == "article" or attributes.get("role") == "article")
            numbered += own
            open_tags.append((name, rank, numbered if own else open_tags[-1][2] if open_tags else 0))
            opened[name] += 1
    flush()
    return stream, slots, articles


# --- wrappers --------------------------------------------------------------
# A node is a token, or a group that repeats: ("+", node, node, ...). An entry is
# a node, whether it is optional, and what belongs to each slot in it.


def fold(stream: list[str]) -> list[tuple]:
    """Entries of a stream in which groups that stand beside themselves are folded; a slot has the numbers of its texts."""
    nodes: list = []
    held: list[list[list[int]]] = []
    slot = 0
    for token in stream:
        nodes.append(token)
        held.append([])
        if token[0] == "#":
            held[-1] = [[slot]]
            slot += 1
        folded = True
        while folded:
            folded, size = False, len(nodes)
            for p in range(1, min(PERIOD, size - 1) + 1):
                before = nodes[size - p - 1]
                if len(before) == p + 1 and before[-1] == nodes[-1] and isinstance(before, tuple) and list(before[1:]) == nodes[size - p :]:
                    first = size - p - 1
                elif before == nodes[-1] and 2 * p <= size and nodes[size - 2 * p : size - p] == nodes[size - p :]:
                    first = size - 2 * p
                    before = ("+", *nodes[size - p :])
                else:
                    continue
                once = [s for h in held[first : size - p] for s in h]
                again = [s for h in held[size - p :] for s in h]
                nodes[first:], held[first:] = [before], [[x + y for x, y in zip(once, again)]]
                folded = True
                break
    return [(node, False, slots) for node, slots in zip(nodes, held)]


def bodies_of(entries: list[tuple]) -> set[tuple]:
    return {node[1:] for node, _, _ in entries if isinstance(node, tuple)}


def promote(entries: list[tuple], bodies: set[tuple], unite) -> list[tuple]:
    """Groups that repeat elsewhere become repeated groups here, and those that stand side by side one."""
    sizes = sorted({len(b) for b in bodies}, reverse=True)
    nodes = [node for node, _, _ in entries]
    out: list[tuple] = []
    at = 0
    while at < len(entries):
        size = next((n for n in sizes if tuple(nodes[at : at + n]) in bodies), 0)
        node = ("+", *nodes[at : at + size]) if size else nodes[at]
        part = entries[at : at + max(size, 1)]
        may, slots = all(o for _, o, _ in part), [s for _, _, x in part for s in x]
        at += len(part)
        if out and isinstance(node, tuple) and out[-1][0] == node:
            out[-1] = (node, out[-1][1] and may, [unite(p, q) for p, q in zip(out[-1][2], slots)])
        else:
            out.append((node, may, slots))
    return out


def match(wrapper: list[tuple], entries: list[tuple]) -> list[tuple[int, int]]:
    """Positions of equal nodes in two lists of entries, in order."""
    matcher = SequenceMatcher(None, [e[0] for e in wrapper], [e[0] for e in entries], autojunk=False)
    return [(a + k, b + k) for a, b, n in matcher.get_matching_blocks() for k in range(n)]


def both(p: list[int], q: list[int]) -> list[int]:
    """Facts of a slot over two sets of pages: pages, characters, linked characters, least and greatest checksum of a text."""
    return [p[0] + q[0], p[1] + q[1], p[2] + q[2], min(p[3], q[3]), max(p[4], q[4])]


def align(one: list[tuple], two: list[tuple]) -> list[tuple]:
    """The wrapper of the pages of both wrappers."""
    bodies = bodies_of(one) | bodies_of(two)
    one, two = promote(one, bodies, both), promote(two, bodies, both)
    out: list[tuple] = []
    a = b = 0
    for x, y in [*match(one, two), (len(one), len(two))]:
        out += [(node, True, facts) for node, _, facts in [*one[a:x], *two[b:y]]]
        if x < len(one):
            out.append((one[x][0], one[x][1] or two[y][1], [both(p, q) for p, q in zip(one[x][2], two[y][2])]))
        a, b = x + 1, y + 1
    return promote(out, bodies, both)


def of_page(page: str) -> list[tuple]:
    """The wrapper of one page."""
    stream, slots, _ = read(page)

    def facts(group: list[int]) -> list[int]:
        marks = [zlib.crc32(slots[k][0].encode()) for k in group]
        return [1, sum(len(slots[k][0]) for k in group), sum(slots[k][1] for k in group), min(marks), max(marks)]

    return [(node, may, [facts(g) for g in groups]) for node, may, groups in fold(stream)]


def _frozen(node):
    return tuple(map(_frozen, node)) if isinstance(node, list) else node


def load(text: str) -> list[tuple]:
    return [(_frozen(node), may, facts) for node, may, facts in json.loads(text)]


def _gather(found: dict[tuple, list[tuple]], key: tuple, entries: list[tuple]) -> None:
    """Unite the facts of equal streams."""
    if key in found:
        entries = [(n, o, [both(p, q) for p, q in zip(x, y)]) for (n, o, x), (_, _, y) in zip(found[key], entries)]
    found[key] = entries


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different streams of each host in a batch, as wrappers of their pages."""
    for batch in batches:
        seen: dict[tuple, list[tuple]] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            entries = of_page(page or "")
            _gather(seen, (host, *[e[0] for e in entries]), entries)
        marks = [zlib.crc32(repr(key).encode()) for key in seen]
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0] for key in seen], pa.string()), pa.array(marks, pa.int64()), pa.array(map(json.dumps, seen.values()), pa.string())],
            names=["host", "mark", "wrapper"],
        )


def _aligned(rows: pd.DataFrame) -> pd.DataFrame:
    """One wrapper for all rows; longer streams come first, equal ones once, so the result repeats."""
    same: dict[tuple, list[tuple]] = {}
    for text in rows["wrapper"]:
        entries = load(text)
        _gather(same, tuple((node, may) for node, may, _ in entries), entries)
    order = sorted(same, key=lambda key: (-len(key), repr(key)))
    found = same[order[0]]
    for key in order[1:]:
        found = align(found, same[key])
    return pd.DataFrame({"host": rows["host"].iloc[:1], "wrapper": [json.dumps(found)]})


def host_of(url: str) -> Column:
    """Host of a url column, lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper``: the wrapper of each host's pages."""
    slim = pages.select(host_of("url").alias("host"), F.col("html").cast("string").alias("html"))
    rows = cut(slim.mapInArrow(_streams, "host string, mark long, wrapper string"))
    while True:
        # a stream that several tasks have read has one mark, so its rows stay together
        counts = rows.groupBy("host").agg(F.count_distinct("mark").alias("n"))
        parts = cut(counts.select("host", F.ceil(F.col("n") / FAN).alias("parts")))
        most = parts.agg(F.max("parts")).first()[0] or 1
        dealt = rows.join(parts, "host").select("host", F.expr("pmod(mark, parts)").alias("mark"), "wrapper")
        aligned = dealt.groupBy("host", "mark").applyInPandas(lambda key, group: _aligned(group).assign(mark=key[1]), "host string, mark long, wrapper string")
        if most == 1:
            return aligned.select("host", "wrapper")
        rows = cut(aligned)


# --- extraction ------------------------------------------------------------


def _ranks(node) -> list[int]:
    """Ranks of the slots in a node."""
    if isinstance(node, tuple):
        return [r for part in node[1:] for r in _ranks(part)]
    return [int(node[1:])] if node[0] == "#" else []


class Extractor:
    """Reads pages of one host by its wrapper."""

    def __init__(self, wrapper: list[tuple]):
        self.wrapper = wrapper
        self.bodies = bodies_of(wrapper)
        self.weights = [[self._weight(r, f) for r, f in zip(_ranks(node), facts)] for node, _, facts in wrapper]
        self.known: dict[tuple, list[list[int]]] = {}
        chars, plain = [0, 0], [0, 0, 0, 0]
        for (_, _, facts), weights in zip(wrapper, self.weights):
            for f, w in zip(facts, weights):
                if w in (0, 1):
                    chars[w] += f[1]
                plain[w] += f[1] - f[2] if w >= 0 else 0
        #: Least rank of the slots that are taken beside named ones.
        self.least = 1 if chars[1] >= chars[0] else 0
        #: Whether the host's main elements hold more text of their own than the articles.
        self.main = plain[2] > plain[3]

    @staticmethod
    def _weight(rank: int, facts: list[int]) -> int:
        """The rank of a slot; outside any article, -1 if it is fixed or a menu."""
        pages, chars, linked, low, high = facts
        fixed = pages >= AGREE and low == high
        return -1 if rank == 0 and (fixed or linked >= LINKED * chars) else rank

    def text(self, page: str) -> str:
        stream, slots, articles = read(page)
        entries = promote(fold(stream), self.bodies, list.__add__)
        nodes = tuple(e[0] for e in entries)
        if nodes not in self.known:
            weights = [_ranks(node) for node in nodes]  # a node that finds no match goes by its own marks
            for a, b in match(self.wrapper, entries):
                weights[b] = self.weights[a]
            self.known[nodes] = weights
        weight = [-1] * len(slots)
        for (_, _, groups), weights in zip(entries, self.known[nodes]):
            for group, w in zip(groups, weights):
                for k in group:
                    weight[k] = w
        best = max(0, *weight) if weight else 0
        if best == 3:
            return " ".join(slots[k][0] for k in self._story(slots, articles, weight))
        best = min(best, self.least) if best == 1 else best
        return " ".join(text for (text, _), w in zip(slots, weight) if w >= best)

    def _story(self, slots: list[tuple[str, int]], articles: list[int], weight: list[int]) -> list[int]:
        """Slots of the story on a page with articles.

        Where a main element has more text of its own than the articles, on the page
        and on the host, these are cards beside the story. Else the article with most
        text that is no link is the story, and others belong to it unless they lead
        elsewhere: their first slot, or at least ``LINKED`` of their text, is a link.
        """
        plain: Counter[int] = Counter()
        for (text, linked), w in zip(slots, weight):
            plain[w] += max(0, len(text) - linked)
        if self.main and plain[2] > plain[3]:
            return [k for k, w in enumerate(weight) if w == 2]
        held: dict[int, list[int]] = {}
        for k, w in enumerate(weight):
            if w == 3:
                held.setdefault(articles[k], []).append(k)
        facts = {a: (sum(len(slots[k][0]) for k in ks), sum(slots[k][1] for k in ks)) for a, ks in held.items()}
        story = max(facts, key=lambda a: (facts[a][0] - facts[a][1], -a))
        leads = {a for a, ks in held.items() if slots[ks[0]][1] >= len(slots[ks[0]][0]) or facts[a][1] >= LINKED * facts[a][0]}
        return [k for k, w in enumerate(weight) if w == 3 and (articles[k] == story or articles[k] not in leads)]


def extract(pages: DataFrame, name: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html`` in a column ``name``."""
    # written first, so that Spark knows their bytes: few wrappers go to the pages, and no page moves
    found = cut(wrappers(pages).select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper")))
    joined = pages.withColumn("__of", host_of("url")).join(found, F.col("__of") == F.col("__host"), "left")

    def run(columns: list[pa.Array]) -> pa.Array:
        readers: dict[str, Extractor] = {}
        out = []
        for page, wrapper in zip(columns[0].to_pylist(), columns[1].to_pylist()):
            if wrapper not in readers:
                readers[wrapper] = Extractor(load(wrapper or "[]"))
            out.append(readers[wrapper].text(page or ""))
        return pa.array(out, pa.string())

    wanted = [quoted(c) for c in pages.columns if c != name]
    slim = joined.select(*wanted, "__wrapper", F.col("html").cast("string").alias("__html"))
    return with_arrow_column(slim, name, "string", [F.col("__html"), F.col("__wrapper")], run).drop("__wrapper", "__html")


def report(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    found = extract(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
