"""Main text of web pages, by consensus of the pages of a host.

Each page is parsed, in time linear in its length, into blocks of text and a light tree. Its containers are scored by the
text of their blocks that isn't boilerplate or mostly links, and the page votes for the path of its best container, of
tags and classes with numbers generalised. It also tells which texts it holds on which paths. Both are counted by host
in Spark: the path with most votes wins, and a text that stands on the same path of most of a host's different pages is
boilerplate whatever it is called. Then each page is parsed again and its text taken from the containers on its host's
winning path, without what repeats; where a page has none, or next to no text there, from its own best container.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .urls import host

#: Bytes of winning paths and repeated texts' hashes up to which they are broadcast; more are joined.
BROADCAST = 4 << 20
#: A text is boilerplate that stands on this share of a host's different pages, and on this many.
SHARE, LEAST = 0.5, 4
#: A name of JUNK doesn't condemn an element with this share of a page's text, or with a title and half of the text.
MOST, HALF = 0.8, 0.5

# Tags and class words by the part that they play in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
DROPPED = frozenset("nav footer aside form noscript template svg math object canvas video audio select button dialog menu fieldset datalist map applet frameset head".split())
CONTAINERS = frozenset("body article main section div td center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
JUNK = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle banner sponsor sponsored promo promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar skip "
    "footer foot colophon copyright sidebar rail widget widgets aside related recommended recommendations trending popular "
    "cookie cookies consent gdpr notice notices notification notifications alert announcement disclaimer popup modal overlay newsletter subscribe subscription paywall "
    "form search login signup signin register comment comments commentlist disqus respond responses replies reply discussion feedback reviews "
    "share sharing social follow masthead topbar".split()
)
#: Of JUNK, what as often names a topic or a part of an article: never enough alone.
TOPICS = frozenset(
    "advertising promo promotion navigation menu banner foot related recommended recommendations trending popular consent notice notices notification notifications "
    "alert announcement disclaimer search register comment respond responses replies reply discussion feedback reviews social follow form".split()
)
ADS = frozenset("ad ads advert adverts advertisement adsense adsbygoogle".split())
#: With one of these, what is named a header is an article's.
TITLED = frozenset("content article post entry story".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: A start tag of the first kind ends an open element of the second kinds.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"),
}
SCOPES = frozenset("table ul ol dl body article main section div td".split())
#: What ends the search for an element that a start tag ends.
BOUNDS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)} | dict.fromkeys(("tr", "td", "th", "tbody", "tfoot"), ("table",))

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|(?P<open>\Z)))"
    r"|<(?P<raw>script|style|textarea|title|iframe|noframes|noembed|xmp)\b[^>]*>.*?(?:</(?P=raw)\s*>|(?P<open2>\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?][^>]*(?:>|\Z)|</[^>]*>",
    re.S | re.I,
)
#: What is left open at the end of a page: a comment, a declaration, or a tag that has an attribute or ends an element.
_CUT = re.compile(r"<(?:[!?]|/[a-zA-Z]|[a-zA-Z][\w-]*\s+[\w-]+\s*=|(?:script|style|textarea|title|iframe|noframes|noembed|xmp)\b)", re.I)
_ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_TOLD = re.compile("class|id|role|style|hidden", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_NUMBER = re.compile(r"\d+")
#: Whole classes that are clear cases anywhere: menus, comments, share bars, sponsors' blocks.
_CLEAR = re.compile(
    r"(?<!\S)(?:comments?|commentlist|disqus|share|sharing|sponsored|comments?[-_]+(?:list|area|section|thread|body|text|content|item|author|meta)"
    r"|(?:main|nav|site|top|primary|side)[-_]*menu|menu[-_]*(?:bar|items?|list)"
    r"|(?:social[-_]+)?shar(?:e|ing)[-_]+(?:bar|box|buttons?|icons?|links?|tools?)|social[-_]+shar(?:e|ing))(?!\S)",
    re.I,
)
#: What says that an element is laid out beside something, not that it is one.
_BESIDE = re.compile(r"(?:has|with|without|no|and)[-_]*(?:left|right)?[-_]*sidebars?|sidebars?[-_]*(?:left|right)?[-_]*(?:layout|page|none|off)", re.I)
#: Whole classes of what is an article's text by name.
_BODY = re.compile(r"(?<!\S)(?:entry|post|article|story)[-_]*(?:content|body|text)(?!\S)", re.I)
#: Classes that hide, and those that show again on some screens.
_HIDDEN = re.compile(r"(?<!\S)(?:is-|visually-)?hidden(?!\S)", re.I)
_SHOWN = re.compile(r":(?:block|flex|grid|inline|table|contents|visible)")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element; ``index`` to ``end`` number it and those within, ``start`` to ``last`` the blocks in it."""

    __slots__ = ("body", "end", "holder", "index", "inside", "junk", "key", "last", "start", "tag")

    def __init__(self, tag: str, parent: Node | None, index: int, start: int):
        self.tag, self.index, self.start = tag, index, start
        self.end = self.last = -1
        self.junk = parent.junk if parent else False
        self.inside = parent is not None and (parent.inside or parent.body)
        self.holder = None if parent is None else parent if parent.tag in CONTAINERS else parent.holder
        self.body = tag in ("article", "main")
        self.key = 0


def _attributes(raw: str) -> dict[str, str]:
    if not _TOLD.search(raw):
        return {}
    found: dict[str, str] = {}
    for k, a, b, c in _ATTR.findall(raw):
        found.setdefault(k.lower(), entities.unescape(a or b or c or ""))  # the first counts
    return found


class _Stack:
    """The open elements. It knows where the last of each tag is, so that nothing is searched for."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.at: dict[str, list[int]] = {}
        self.solid, self.scopes = [0], [0]
        self.links = self.headings = 0

    def push(self, node: Node) -> None:
        k, tag = len(self.nodes), node.tag
        self.nodes.append(node)
        self.at.setdefault(tag, []).append(k)
        if tag not in INLINE:
            self.solid.append(k)
        if tag in SCOPES:
            self.scopes.append(k)
        self.links += tag == "a"
        self.headings += tag in HEADINGS

    def last(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def pop_to(self, k: int, end: int, blocks: int) -> None:
        for n in reversed(self.nodes[k:]):
            n.end, n.last = end, blocks
            self.at[n.tag].pop()
            if n.tag not in INLINE:
                self.solid.pop()
            if n.tag in SCOPES:
                self.scopes.pop()
            self.links -= n.tag == "a"
            self.headings -= n.tag in HEADINGS
        del self.nodes[k:]


class Page:
    """A parsed page: ``blocks`` (text, length of its link text, heading, path) and containers in page order."""

    def __init__(self, source: str | None):
        self.blocks: list[tuple[str, int, bool, int]] = []
        self.root = Node("body", None, 0, 0)
        self.containers, self.lists = [self.root], []
        self.named: list[tuple[Node, int]] = []  # elements with names of JUNK: 1 a topic's, 2 one with a sign more, 3 plain
        self.titles: list[int] = []  # numbers of articles and first headings, and of forms
        self.forms: list[int] = []
        self.count = 1
        self._parse(source or "")
        self._weigh()

    # ---- parsing

    def _flush(self) -> None:
        if self.parts:
            raw = "".join(self.parts)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                self.blocks.append((text, self.linked, self.stack.headings > 0, self.stack.nodes[self.stack.solid[-1]].key))
            self.parts, self.linked = [], 0

    def _parse(self, source: str) -> None:
        self.parts: list[str] = []
        self.linked = 0
        self.stack = stack = _Stack(self.root)
        at, limit = 0, source.rfind(">") + 1
        for m in _TAG.finditer(source, 0, limit):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            name = (m["name"] or m["name2"] or "").lower()
            if not name:
                if m["raw"] and m["raw"].lower() not in ("script", "style"):
                    self.parts.append(" ")
                if m["open"] is not None or m["open2"] is not None:
                    at = len(source)
            elif m["end"] or m["end2"]:
                self._end(name)
            else:
                self._start(name, m["attrs"] if m["name"] else m["attrs2"])
        if at < len(source):
            rest = source[at:]
            left = _CUT.search(rest)
            self._text(rest[: left.start()] if left else rest)
        self._flush()
        stack.pop_to(1, self.count, len(self.blocks))
        self.root.end, self.root.last = self.count, len(self.blocks)

    def _text(self, raw: str) -> None:
        if not self.stack.nodes[-1].junk:
            self.parts.append(raw)
            if self.stack.links:
                self.linked += len(raw.strip())

    def _end(self, name: str) -> None:
        stack = self.stack
        k = stack.last(name)
        if not k or (name in INLINE and k < stack.solid[-1]):
            return
        if name not in INLINE:
            self._flush()
        stack.pop_to(k, self.count, len(self.blocks))

    def _start(self, name: str, raw: str) -> None:
        stack = self.stack
        if name in ("html", "body", "head"):
            self._flush()
            if name != "head":
                return
        if name not in INLINE:
            if name in ("br", "img", "input", "wbr", "embed"):
                if name != "wbr":
                    self.parts.append(" ")
                return
            self._flush()
            if name in VOID:
                return
            ended = [k for k in [stack.last("p")] if k > stack.scopes[-1]]
            if name in ENDS:
                bound = stack.last(*BOUNDS[name])
                ended += [k for k in (stack.at[t][-1] for t in ENDS[name] if stack.at.get(t)) if k > bound]
            if ended:
                stack.pop_to(min(ended), self.count, len(self.blocks))
            if stack.nodes[-1].tag == "head":
                stack.pop_to(len(stack.nodes) - 1, self.count, len(self.blocks))
        if raw.rstrip().endswith("/") and name in ("svg", "path", "g"):
            return
        node = Node(name, stack.nodes[-1], self.count, len(self.blocks))
        self.count += 1
        self._describe(node, stack.nodes[-1].key, raw)
        stack.push(node)
        if name in CONTAINERS and not node.junk:
            self.containers.append(node)
        elif name in ("ul", "ol", "table") and not node.inside and not node.junk:
            self.lists.append(node)

    def _describe(self, node: Node, above: int, raw: str) -> None:
        if node.junk:
            return
        attrs = _attributes(raw)
        classes = attrs.get("class", "")
        first = classes.split(None, 1)
        node.key = xxhash.xxh64_intdigest(f"{node.tag}.{_NUMBER.sub('N', first[0])}" if first else node.tag, above)
        node.body = node.body or _BODY.search(classes) is not None
        if node.tag in ("article", "main", "h1"):
            self.titles.append(node.index)
        elif node.tag == "form":
            self.forms.append(node.index)
        if node.tag == "form":
            self.named.append((node, 3))
        elif node.tag in DROPPED or (node.tag == "header" and not node.inside) or attrs.get("role", "").lower() in ROLES:
            node.junk = True
        elif "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _INVISIBLE.search(attrs.get("style", "")):
            node.junk = True
        elif _HIDDEN.search(classes) and not _SHOWN.search(classes):
            node.junk = True
        elif node.tag in INLINE or node.tag in HEADINGS:  # their names are those of anchors, of code and of topics
            node.junk = not ADS.isdisjoint(classes.lower().split())
        elif node.tag not in ("article", "main") and (classes or "id" in attrs):
            self._judge(node, _BESIDE.sub(" ", classes), attrs.get("id", ""))

    def _judge(self, node: Node, classes: str, name: str) -> None:
        own = {w.lower() for w in _WORDS.findall(classes)}
        words = own | {w.lower() for w in _WORDS.findall(_BESIDE.sub(" ", name))}
        if own & ADS or _CLEAR.search(classes):
            node.junk = True
        elif words & JUNK:
            self.named.append((node, 3 if not node.inside and words & JUNK - TOPICS else 2 if own & JUNK - TOPICS else 1))
        elif "header" in words and not node.inside and not words & TITLED:
            self.named.append((node, 4))

    # ---- weighing

    def _weigh(self) -> None:
        """Decides which blocks are kept, and adds up what the containers hold of them.

        Lists of little but links outside an article are menus. An element with a name of JUNK goes, outside an article, but
        if it holds most of the page's text, or a title and half of the text; inside of one, or with a name that is as often
        a topic's, if it is mostly links or asks for something by a form. What is named a header goes but with the page's
        only title.
        """
        n = len(self.blocks)
        size = [0, *accumulate(len(b[0]) for b in self.blocks)]
        linked = [0, *accumulate(b[1] for b in self.blocks)]
        links = [0, *accumulate(b[1] > 0 for b in self.blocks)]
        gone = [0] * (n + 1)

        def holds(numbers: list[int], node: Node) -> int:
            return bisect_right(numbers, node.end - 1) - bisect_right(numbers, node.index)

        def goes(node: Node, kind: int) -> bool:
            own = size[node.last] - size[node.start]
            if kind == 4:
                return not (len(self.titles) == 1 and holds(self.titles, node))
            title = holds(self.titles, node)
            if kind == 3:
                return own < (HALF if title else MOST) * size[n]
            return not title and (2 * (linked[node.last] - linked[node.start]) > own or (kind == 2 and holds(self.forms, node) > 0))

        for node, kind in self.named:
            if node.start < node.last and goes(node, kind):
                gone[node.start] += 1
                gone[node.last] -= 1
        for node in self.lists:
            a, z = node.start, node.last
            text, count = size[z] - size[a], links[z] - links[a]
            if count >= 3 and linked[z] - linked[a] >= 0.9 * text and text < 40 * count:
                gone[a] += 1
                gone[z] -= 1
        self.kept = [depth == 0 for depth in accumulate(gone[:n])]
        self.good = [0, *accumulate(len(b[0]) if k and 2 * b[1] <= len(b[0]) else 0 for k, b in zip(self.kept, self.blocks))]
        self.heads = [0, *accumulate(k and b[2] for k, b in zip(self.kept, self.blocks))]

    def content(self, node: Node) -> int:
        """Length of a node's text that is kept and isn't mostly links."""
        return self.good[node.last] - self.good[node.start]

    def best(self) -> Node:
        """From the body down, into the container with most text, while that holds nearly all of it and leaves no heading behind."""
        below: dict[int, list[Node]] = {}
        for c in self.containers[1:]:
            if self.content(c):
                below.setdefault(c.holder.index, []).append(c)
        node = above = self.root
        while node.tag != "article" and node.index in below:
            within = below[node.index]
            child = max(within, key=lambda c: (self.content(c), -c.start))
            wanted = 0.3 if child.tag in ("article", "main") and sum(c.tag == child.tag for c in within) == 1 else 0.7
            headed = self.heads[node.last] > self.heads[node.start] and self.heads[child.last] == self.heads[child.start]
            if self.content(child) < wanted * self.content(above) or (node.tag == "main" and headed):
                break
            node = child
            above = node if node.body else above  # what is left behind adds up
        return node

    def marks(self) -> list[int]:
        """A hash of each block and its path."""
        return [_signed(xxhash.xxh64_intdigest(text, path)) for text, _, _, path in self.blocks]

    def text(self, nodes: list[Node], repeated: frozenset[int] = frozenset()) -> str:
        """The text of the nodes without the blocks whose marks are ``repeated``, unless these are most of it: then it is a copy's."""
        at = [k for n in nodes for k in range(n.start, n.last) if self.kept[k]]
        if repeated:
            marks = self.marks()
            own = [k for k in at if marks[k] not in repeated]
            if 2 * sum(len(self.blocks[k][0]) for k in own) >= sum(len(self.blocks[k][0]) for k in at):
                at = own
        return "\n".join(self.blocks[k][0] for k in at)

    def extract(self, winner: int | None, repeated: frozenset[int] = frozenset()) -> str:
        """The text on the path of hash ``winner``, or of the best container."""
        own = self.best()
        if winner is None or key(own) == winner:
            return self.text([own] if winner is None else self._matches(winner), repeated)
        there = self._matches(winner)
        above = any(n.index <= own.index < n.end for n in there)
        if not there or (above and own.tag in ("article", "main")) or (not above and sum(map(self.content, there)) < 0.3 * self.content(own)):
            return self.text([own], repeated)
        return self.text(there, repeated)

    def _matches(self, winner: int) -> list[Node]:
        found: list[Node] = []
        for c in self.containers:
            if key(c) == winner and not (found and c.index < found[-1].end):
                found.append(c)
        return found


def _signed(h: int) -> int:
    return h - (1 << 63)


def key(node: Node) -> int:
    return _signed(node.key)


VOTES = "host long, path long, page long, votes long"


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page with text: a vote for its best container's path (page is null), and a row for each mark, by the hash of its text."""
    for b in batches:
        for i in range(0, b.num_rows, 512):
            votes: Counter = Counter()
            told: list[tuple[int, int, int]] = []
            for name, source in zip(b.column("host").slice(i, 512).to_pylist(), b.column("html").slice(i, 512)):
                page = Page(source.as_py())
                best = page.best()
                if page.content(best):
                    votes[name, key(best)] += 1
                    text = _signed(xxhash.xxh64_intdigest(page.text([best])))
                    told += [(name, m, text) for m in {m for m, k in zip(page.marks(), page.kept) if k}]
            if votes:
                names, paths, texts = zip(*((*v, None) for v in votes), *told)
                cols = {"host": names, "path": paths, "page": texts, "votes": [*votes.values(), *([1] * len(told))]}
                yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in cols.items()})


def consensus(pages: DataFrame) -> DataFrame:
    """(host, path, repeated), the first by its hash: what the pages of a host agree on.

    path is the one that most pages vote for (of equals, the smaller hash). repeated lists the marks that stand on at least
    SHARE of the host's pages, and on LEAST, pages of equal text counted once. It is no longer than the pages' blocks by
    SHARE, so it fits a row.
    """
    found = cut(pages.select(F.xxhash64(host("url")).alias("host"), "html").mapInArrow(_vote, VOTES).groupBy("host", "path", "page").agg(F.sum("votes").alias("votes")))
    best = F.max(F.struct("votes", F.bitwise_not("path").alias("rank"))).alias("best")
    paths = found.where("page is null").groupBy("host").agg(best).select("host", F.bitwise_not("best.rank").alias("path"))
    marks = found.where("page is not null")
    every = marks.select("host", "page").distinct().groupBy(F.col("host").alias("h")).agg(F.count("*").alias("all"))
    often = marks.groupBy("host", "path").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    often = often.join(every, F.col("host") == F.col("h")).where(F.col("n") >= SHARE * F.col("all"))
    return paths.join(often.groupBy("host").agg(F.collect_list("path").alias("repeated")), "host", "left")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 512):
            part = b.slice(i, 512)
            text = [Page(h.as_py()).extract(p.as_py(), frozenset(r.as_py() or ())) for h, p, r in zip(part.column("html"), part.column("path"), part.column("repeated"))]
            yield pa.RecordBatch.from_pydict({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(text, pa.string()), "n_chars": pa.array(map(len, text), pa.int64())})


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Character references are decoded, white space in a block becomes one space, and blocks are joined by line feeds.
    Null html, and a page without text, gives an empty text. Pages without a host (null url) vote together. Rows are
    kept whole, repeated or not, and repeated ones count once where texts are looked for that repeat. Other columns are
    ignored; an empty table gives an empty result.
    """
    agreed = cut(consensus(pages))
    size = agreed.agg(F.sum(F.lit(24) + 8 * F.coalesce(F.size("repeated"), F.lit(0)))).first()[0] or 0
    if size <= BROADCAST:
        agreed = F.broadcast(agreed)
    rows = pages.select("page_id", "url", "html", F.xxhash64(host("url")).alias("host")).join(agreed, "host", "left")
    return rows.select(F.col("page_id").cast("long"), "url", "html", "path", "repeated").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
