"""Main text of web pages by wrapper induction.

Pages of one host are taken in groups of up to ``CHUNK``. Each page becomes a tree of its block
elements, in which siblings of the same tag and class are one node (a list of paragraphs has one
slot). The trees are aligned with a growing template by simple tree matching. A text that stands in
the same template node on ``CONSTANT`` of the group's pages is template; what varies from page to
page is content. Pages with equal content count once, so copies of an article are not taken for a
template, and below ``LEAST`` different pages nothing is.

Of the varying slots, those that HTML itself marks as something else are left out: navigation,
headers, footers, sidebars, forms, scripts, styles and elements whose class, id or role names an
advert, a notice, a menu or reader comments. If a page has an article or main element with text, its
slots alone are content.

Null or empty HTML gives an empty text. Character references are decoded, white space inside a block
becomes one space, blocks are joined by one space. Pages without a host are a group of their own.
Repeated rows are pages of their own; other columns are ignored. Hosts with many pages are dealt over
tasks by a hash of the page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stream import map_groups

CHUNK, LEAST, CONSTANT = 64, 8, 0.8
#: Hosts dealt over tasks: those with more than this share of all pages, so 20,000 at most.
SHARE = 20_000
DEEPEST = 200

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
                    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.DOTALL)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden|aria-hidden\s*=\s*[\"']?true)(?:[\s\"'=]|$)", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")

# Fixed values of HTML.
RAW = frozenset("script style noscript template iframe textarea title svg math object".split())
NEVER_EMPTY = RAW - {"svg", "math", "object"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"},
              "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NOISE_TAGS = frozenset("nav footer aside form button select dialog menu head".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies "
    "consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login "
    "share sharing social comment comments commentlist disqus reply replies respond discussion "
    "related recommended widget toolbar search pagination pager skip "
    "complementary contentinfo dialog".split())


class Node:
    __slots__ = ("label", "children", "texts")

    def __init__(self, label: str) -> None:
        self.label = label
        self.children: dict[str, Node] = {}
        self.texts: Counter = Counter()


class Page:
    """Tree of a page and its blocks: (node, text, whether it may be content)."""

    def __init__(self, source: str) -> None:
        self.root = Node("")
        self.blocks: list[tuple[Node, str, bool]] = []
        _Parser(self, source)

    def shape(self) -> str:
        def write(node: Node) -> str:
            return node.label + "(" + " ".join(map(write, node.children.values())) + ")"
        return write(self.root)


class _Parser:
    """One pass over the tags, closing elements as browsers do where an end tag is missing."""

    def __init__(self, page: Page, source: str) -> None:
        self.page = page
        # tag, node, noise, inside an article
        self.open: list[tuple[str, Node, bool, bool]] = [("", page.root, False, False)]
        self.pieces: list[str] = []
        self.marked: list[tuple[Node, str, bool, bool]] = []
        at = 0
        while True:
            m = _TOKEN.search(source, at)
            if m is None:
                break
            if m.start() > at:
                self.text(source[at:m.start()])
            at = m.end()
            tag = m.group(2) or m.group(5)
            if tag is None:
                if m.group().startswith("<![CDATA["):
                    self.text(m.group()[9:-3])
                continue
            tag = tag.lower()
            if m.group(1) or m.group(4):
                self.end(tag)
            elif tag in RAW:
                if tag in NEVER_EMPTY or not m.group().endswith("/>"):
                    close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                    at = close.end() if close else len(source)
                self.pieces.append(" ")
            else:
                self.start(tag, m.group(3) if m.group(2) else m.group(6))
        if at < len(source):
            self.text(source[at:])
        self.flush()
        inside = any(a and not noise for _, _, noise, a in self.marked)
        page.blocks = [(node, text, not noise and (a or not inside))
                       for node, text, noise, a in self.marked]

    def text(self, raw: str) -> None:
        if not self.open[-1][2]:
            self.pieces.append(raw)

    def flush(self) -> None:
        if not self.pieces:
            return
        raw = "".join(self.pieces)
        self.pieces = []
        text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
        if text:
            tag, node, noise, article = self.open[-1]
            self.marked.append((node, text, noise, article))

    def start(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                self.pieces.append("" if tag == "wbr" else " ")
            return
        inline = tag in INLINE
        if not inline:
            self.imply(tag)
            self.flush()
        _, node, noise, article = self.open[-1]
        names: list[str] = []
        if attributes and not attributes.isspace():
            for _, a, b, c in _NAMES.findall(attributes):
                names += [n for n in (a or b or c).lower().split() if n]
        if tag in ("article", "main"):
            # Comments are often articles inside an article.
            article = True
        if not noise and tag not in ("html", "body", "main"):
            words = {w for n in names for w in _SPLIT.split(n)}
            noise = (tag in NOISE_TAGS or tag == "header" and not article
                     or not words.isdisjoint(NOISE_NAMES)
                     or "header" in words and not article and tag != "article"
                     or bool(attributes) and _HIDDEN.search(attributes) is not None)
        if inline:
            if noise != self.open[-1][2]:
                self.pieces.append(" ")
        elif len(self.open) < DEEPEST:
            label = tag + "".join(f".{n}" for n in names[:2])
            if label not in node.children:
                node.children[label] = Node(label)
            node = node.children[label]
        self.open.append((tag, node, noise, article))

    def imply(self, tag: str) -> None:
        """End what a block ends by beginning."""
        for i in range(len(self.open) - 1, 0, -1):
            was = self.open[i][0]
            if was == "p":
                self.close(i)
                break
            if was not in INLINE:
                break
        if tag in CLOSES:
            for i in range(len(self.open) - 1, 0, -1):
                was = self.open[i][0]
                if was in CLOSES[tag]:
                    self.close(i)
                    if tag != "tr" or was == "tr":
                        break
                elif was in CONTAINERS[tag]:
                    break

    def close(self, i: int) -> None:
        self.flush()
        del self.open[i:]

    def end(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                if tag in INLINE and all(o[0] in INLINE for o in self.open[i:]):
                    if self.open[i][2] != self.open[i - 1][2]:
                        self.pieces.append(" ")
                    del self.open[i:]
                elif tag not in INLINE:
                    self.close(i)
                return


def match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: size of the largest order-preserving match of two trees with equal
    roots, and the matched nodes."""
    xs, ys = list(a.children.values()), list(b.children.values())
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    inner: dict[tuple[int, int], tuple[int, list]] = {}
    for i, x in enumerate(xs, 1):
        for j, y in enumerate(ys, 1):
            most = max(best[i - 1][j], best[i][j - 1])
            if x.label == y.label:
                inner[i, j] = match(x, y)
                most = max(most, best[i - 1][j - 1] + inner[i, j][0])
            best[i][j] = most
    pairs = [(a, b)]
    i, j = len(xs), len(ys)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs += inner[i, j][1]
            i, j = i - 1, j - 1
    return 1 + best[-1][-1], pairs


def align(template: Node, page: Node) -> dict[int, Node]:
    """Template node of each page node, by the id of the latter. What doesn't match is added to the
    template under the node that its parent is matched with."""
    to = {id(p): t for t, p in match(template, page)[1]}
    work = [page]
    while work:
        node = work.pop()
        for label, child in node.children.items():
            if id(child) not in to:
                home = to[id(node)]
                if label not in home.children:
                    home.children[label] = Node(label)
                to[id(child)] = home.children[label]
            work.append(child)
    return to


def _content(pages: list[Page]) -> list[str]:
    """Texts of pages of one host."""
    template = Node("")
    shapes: dict[str, list] = {}
    seen: set[int] = set()
    slots: list[list[tuple[Node, str]]] = []
    for page in pages:
        to = align(template, page.root)
        found = [(to[id(node)], text) for node, text, good in page.blocks if good]
        slots.append(found)
        key = hash(tuple(text for _, text in found))
        if key not in seen:
            seen.add(key)
            for slot, text in dict.fromkeys(found):
                slot.texts[text] += 1
    if len(seen) < LEAST:
        return [" ".join(text for _, text in found) for found in slots]
    least = CONSTANT * len(seen)
    return [" ".join(text for slot, text in found if slot.texts[text] < least) for found in slots]


def _extract(group: pd.DataFrame) -> pd.DataFrame:
    texts = _content([Page(h or "") for h in group["html"]])
    return pd.DataFrame({"page_id": group["page_id"].to_numpy(), "url": group["url"].to_numpy(),
                         "text": texts})


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of each row of ``pages`` (page_id, url, html)."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://"
                                               r"(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    counts = pages.select(host.alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    total = pages.count()
    most = max(CHUNK, -(-total // SHARE))
    # Fewer than SHARE hosts have more than total / SHARE pages: small at any size.
    large = counts.where(F.col("n") > most).select(
        "host", F.ceil(F.col("n") / most).cast("int").alias("tasks"))
    # Ids travel as text, as null has no place among the numbers of a pandas column.
    dealt = (pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html",
                          host.alias("host"))
             .join(F.broadcast(large), "host", "left")
             .withColumn("order", F.xxhash64("page_id", "url"))
             .withColumn("task", F.pmod("order", F.coalesce("tasks", F.lit(1))).cast("int"))
             .drop("tasks"))
    return map_groups(dealt, ["host", "task"], _extract, "page_id string, url string, text string",
                      order=["order"], most=CHUNK) \
        .withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))
