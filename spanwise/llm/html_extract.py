"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes its blocks: the runs of text between block-level tags, each with its ancestors, the share of its
characters inside links, and its position in the tree. A linear classifier turns these into costs for the labels content
and boilerplate, which are the capacities of the arcs to the two terminals. Neighbouring blocks are joined by arcs whose
capacity grows with their proximity in the tree (the share of ancestors that they have in common), siblings that others
separate likewise. The minimum cut, found by maximum flow, then labels all blocks at once: a short line between two
paragraphs follows them, while strong evidence (a nav, an advert, a form) outweighs any neighbour. Names and
forms count by how little of the page's text they hold: what wraps a whole page is its layout. A form that holds half of
the text, or an element whose name speaks both ways ("login-layout"), isn't doubted, and what stands outside of it is.

Pages are rows, so the work needs no shuffle, and a page takes time in proportion to its length, its flow and the blocks
that separate neighbours; inline elements may be nested to any depth.

Defined results: a null, empty or textless page gives the empty text; broken markup is read as far as it goes (unclosed
tags, a cut-off page); references that don't decode stay as they are; repeated rows give repeated results; an empty
table gives no rows; a very long page is read whole; a block whose evidence is exactly zero costs nothing either way and
follows its neighbours, as boilerplate where they don't decide, and of several minimum cuts the one with the fewest
content blocks is taken; columns beside page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import bounded_batches
from spanwise.llm.flow import Network

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option select".split()
)
CLOSES_P = BLOCK - frozenset("body head html option select".split())
#: An end tag of these doesn't reach outside the nearest of those.
SAME_AGAIN = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "p": ()}
NEVER = frozenset("nav footer aside script style noscript template button select option iframe svg menu dialog head title textarea object embed canvas audio video map label input".split())
GOOD = frozenset("article main".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar side footer header masthead comment comments respond reply replies disqus share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager tags toolbar widget copyright legal disclaimer skip hidden".split()
)
GOOD_WORDS = frozenset("article articlebody content body post entry story text main maincontent prose".split())
#: Of these, words that say what a text is, which a page's layout rarely goes by.
TALK = frozenset("comment comments respond reply replies disqus".split())
#: A name with one of these tells of an element's layout or subject ("has-sidebar", "category-legal"), not of its part.
MODIFIERS = frozenset("has with no without category tag cat topic".split())
#: Beside a bad word, words that tell of a layout or of content ("login-layout", "header-and-body"), as all good words do.
LAYOUT = frozenset("layout wrap wrapper container page grid view shell root app".split())
BAD_ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog menu menubar toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<(?![a-zA-Z/!?]))", re.DOTALL)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|itemprop|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# The classifier: weights of the evidence for content, in nats.
BIAS, PER_LOG_CHAR, LINKED, SENTENCE, IN_GOOD, NAMED_GOOD, HEADING = -1.8, 0.5, -4.0, 0.7, 5.0, 2.0, 0.4
STRONG = 60.0
#: A bad name, or a form, unless it holds most of the page's text: full weight up to the first share, none from the second.
#: Forms and names that speak both ways lose their weight earlier, and where one holds the page, what stands outside of it
#: is in doubt instead.
NAMED_BAD, WRAPS, TALK_WRAPS, MIXED_WRAPS, OUTSIDE = 20.0, (0.6, 0.9), (0.9, 1.0), (0.3, 0.5), 4.0
SMOOTH, SIBLING = 1.2, 0.5


class Node:
    """An open element: its tag, the nearest block from here up, its depth in blocks, and what it says about the text inside."""

    __slots__ = ("tag", "up", "block", "depth", "verdict", "good", "linked", "main", "wraps", "doubt", "held", "against", "holds")

    def __init__(self, tag: str, up: Node | None, attributes: str):
        self.tag, self.up = tag, up
        self.block = self if up is None or tag in BLOCK else up.block
        self.depth = 0 if up is None else up.depth + (self.block is self)
        self.verdict = up.verdict if up else 0.0
        self.good = up.good if up else 0.0
        self.linked = tag == "a" or bool(up and up.linked)
        self.main = bool(up and up.main)
        self.wraps = MIXED_WRAPS if tag in ("form", "fieldset") else None
        if tag in NEVER or tag == "header" and not self.good:
            self.verdict = -STRONG
        if attributes and not attributes.isspace() and tag not in ("a", "html", "body"):
            self._names(attributes)
        if tag in GOOD and not self.wraps:
            self.good += IN_GOOD
            self.main = True
        #: The nearest element, from here up, whose form or names speak against its text.
        self.doubt = self if self.wraps else up.doubt if up else None
        self.held, self.against, self.holds = 0, 0.0, False

    def _names(self, attributes: str) -> None:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                self.verdict = -STRONG
            elif name == "role":
                self.verdict = -STRONG if value in BAD_ROLES else self.verdict
                if value == "main":
                    self.good += IN_GOOD
                    self.main = True
                elif value == "form":
                    self.wraps = self.wraps or MIXED_WRAPS
            elif name in ("class", "id", "itemprop"):
                names = [[w.lower() for w in NAME_WORD.findall(x)] for x in value.split()]
                names = [x for x in names if x and MODIFIERS.isdisjoint(x)]
                words = {w for x in names for w in x}
                bad = {x[0] for x in names} & BAD_WORDS if self.tag in GOOD else words & BAD_WORDS
                if bad:
                    mixed = bool(words & (GOOD_WORDS | LAYOUT)) and self.wraps in (None, MIXED_WRAPS)
                    self.wraps = TALK_WRAPS if bad & TALK or self.wraps is TALK_WRAPS else MIXED_WRAPS if mixed else WRAPS
                elif words & GOOD_WORDS or "articlebody" in value.lower():
                    self.good += NAMED_GOOD


def blocks_of(page: str) -> list[tuple[str, int, Node]]:
    """(text, characters in links, element) of each block with text, in page order."""
    out: list[tuple[str, int, Node]] = []
    here = root = Node("", None, "")
    parts: list[str] = []
    linked, at, end = 0, 0, len(page)
    opened: dict[str, int] = {}  # how many elements of each tag are open, so that a search for none isn't begun

    def close(owner: Node) -> None:
        nonlocal linked
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append((text, linked, owner))
            parts.clear()
            linked = 0

    def leave(node: Node) -> None:
        """Closes every element from the innermost to this one."""
        nonlocal here
        while here is not node.up:
            opened[here.tag] -= 1
            here = here.up

    while at < end:
        m = TOKEN.match(page, at)
        if not m:  # a quote that never ends: the tag is dropped up to the next >
            at = (page.find(">", at) + 1) or end
            continue
        at = m.end()
        slash, tag, attributes, text = m.groups()
        if text is not None:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if here.linked:
                linked += len(text.strip())
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            node = here
            stop = SAME_AGAIN.get(tag, ())
            if not opened.get(tag):
                node = root
            while node.up and node.tag != tag and node.tag not in stop:
                node = node.up.block if tag in BLOCK else node.up
            if node.up and node.tag == tag:
                if tag in BLOCK:
                    close(here.block)
                leave(node)
            elif tag in BLOCK:
                close(here.block)
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in BLOCK:
            close(here.block)
            if tag in SAME_AGAIN and tag != "p":
                node, stop = here.block, SAME_AGAIN[tag]
                again = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
                if not any(map(opened.get, again)):
                    node = root
                while node.up and node.tag not in again and node.tag not in stop:
                    node = node.up.block
                if node.up and node.tag in again:
                    leave(node)
            elif tag in CLOSES_P:
                if here.block.tag == "p":
                    leave(here.block)
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
        elif tag in RAW and not attributes.rstrip().endswith("/"):
            shut = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = shut.end() if shut else end  # its text is markup or a title, never part of a block
        elif tag not in VOID and not attributes.endswith("/"):
            here = Node(tag, here, attributes)
            opened[tag] = opened.get(tag, 0) + 1
    close(here.block)
    return out


def evidence(text: str, linked: int, node: Node, outside: bool = False) -> float:
    """The classifier: positive for content. ``outside`` says that the page's text is known to stand in another element."""
    if node.verdict:
        return node.verdict
    n = len(text)
    value = BIAS + PER_LOG_CHAR * math.log1p(n) + LINKED * min(1.0, linked / n) + min(2 * IN_GOOD, node.good)
    value -= node.doubt.against if node.doubt else 0
    value -= OUTSIDE if outside else 0
    value += SENTENCE if text[-1] in ".!?…\"”»。" else 0
    return value + (HEADING if node.tag in ("h1", "h2", "h3", "h4", "h5", "h6") else 0)


def weigh_doubts(blocks: list[tuple[str, int, Node]]) -> list[bool]:
    """Sets ``against`` of elements with bad names, their doubtful ancestors' included; says of each block whether it stands
    outside of a form or mixed name that holds the page.

    The page's text is what stands in articles or mains, else in elements with good names, else all that isn't ruled
    out. An element that holds most of it wraps the page, whatever it is called.
    """
    doubts: dict[int, Node] = {}
    for _, _, node in blocks:
        d = node.doubt
        while d and id(d) not in doubts:
            doubts[id(d)] = d
            d = d.up.doubt
    if not doubts:
        return [False] * len(blocks)
    texts = [(len(text) - linked, node) for text, linked, node in blocks if not node.verdict and len(text) > linked]
    texts = [x for x in texts if x[1].main] or [x for x in texts if x[1].good] or texts
    whole = sum(n for n, _ in texts)
    for n, node in texts:
        if node.doubt:
            node.doubt.held += n
    order = sorted(doubts.values(), key=lambda d: d.depth)
    for d in reversed(order):
        if d.up.doubt:
            d.up.doubt.held += d.held
    for d in order:
        full, none = d.wraps
        share = d.held / whole if whole else 0.0
        outer = d.up.doubt.against if d.up.doubt else 0.0
        d.against = outer + NAMED_BAD * min(1.0, max(0.0, (none - share) / (none - full)))
        d.holds = d.wraps is MIXED_WRAPS and share >= none and not d.against or bool(d.up.doubt and d.up.doubt.holds)
    if not any(d.holds for d in order):
        return [False] * len(blocks)
    return [not (node.doubt and node.doubt.holds) and not node.main for _, _, node in blocks]


def proximity(a: Node, b: Node) -> float:
    """Shared blocks around them (themselves included) over the deeper one's, 1 for texts of the same block."""
    deep, x, y = max(a.depth, b.depth), a, b
    while x.depth > y.depth:
        x = x.up.block
    while y.depth > x.depth:
        y = y.up.block
    while x is not y:
        x, y = x.up.block, y.up.block
    return (x.depth + 1) / (deep + 1)


def minimum_cut(unary: list[float], arcs: list[tuple[int, int, float]]) -> list[bool]:
    """True where a node stays on the source's side of a minimum cut, found by maximum flow; capacities in thousandths.

    unary > 0 is an arc from the source, unary < 0 one to the sink; arcs are symmetric.
    """
    n = len(unary)
    source, sink, net = n, n + 1, Network(n + 2)
    for i, u in enumerate(unary):
        if u > 0:
            net.add(source, i, round(1000 * u))
        else:
            net.add(i, sink, round(-1000 * u))
    for a, b, c in arcs:
        net.add(a, b, round(1000 * c), round(1000 * c))
    return [x >= 0 for x in net.saturate(source, sink)[:n]]


def labels_of(blocks: list[tuple[str, int, Node]]) -> list[bool]:
    outside = weigh_doubts(blocks)
    unary = [evidence(*b, out) for b, out in zip(blocks, outside, strict=True)]
    arcs, last = [], {}
    for i, (_, _, node) in enumerate(blocks):
        if i:
            arcs.append((i - 1, i, SMOOTH * proximity(blocks[i - 1][2], node)))
        if node.up is not None:
            around = id(node.up.block)
            before = last.get(around)
            if before is not None and before < i - 1:
                arcs.append((before, i, SIBLING))
            last[around] = i
    return minimum_cut(unary, arcs)


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    return "\n".join(text for (text, _, _), keep in zip(blocks, labels_of(blocks), strict=True) if keep)


def extracted(html_column: Column) -> Column:
    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return extract(html_column)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    done = bounded_batches(pages).select("page_id", "url", extracted(F.col("html")).alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
