"""Main text of web pages by composite text density.

Each node of the tree has the characters of its text, its tags, and the same of the links in it.
Its density is characters per tag, adjusted by the logarithmic ratio that link characters and link
tags make up; a node's density sum is that of its children. The subtree of the largest sum holds
the article, provided that its density reaches the threshold, the least density on the path from
it up to the body.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of an article's text.
NEVER = frozenset(
    "script style noscript template head title nav footer aside button select textarea option iframe object svg canvas "
    "audio video map dialog menu input".split())
#: Elements that begin a block of text of their own.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What an opening tag ends, up to the boundary that keeps it open.
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
             "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
             "option": ({"option"}, {"select"})}
#: Words of a class, id or role that mark what is not the article.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar footer header masthead toc skip login announcement disclaimer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "comment comments discussion disqus replies reply respond share sharing social related recommended "
    "pagination pager toolbar widget copyright legal complementary contentinfo search dialog".split())
#: What a page's head can hold; anything else ends it.
IN_HEAD = frozenset("head title base basefont bgsound link meta noframes noscript script style template".split())
#: Elements by which a form asks for something.
CONTROLS = frozenset("input select textarea button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Mark-up that holds the article whatever its class says.
_KEEP = frozenset("html body main".split())
#: Elements that can hold an article on their own; others are parts of what is around them.
_HOLDER = frozenset("div section td article main".split())


class Node:
    __slots__ = ("tag", "noise", "children", "parent", "chars", "tags", "link_chars", "link_tags", "total", "density", "asks")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False):
        self.tag, self.parent, self.noise, self.children = tag, parent, noise, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.total = self.density = 0.0
        self.asks = False


def _is_noise(tag: str, attrs: list, parent: Node) -> bool:
    if tag in NEVER:
        return True
    if tag == "header":  # a page's header is noise, an article's keeps its headings
        return not _inside(parent, {"article", "main"})
    if tag in _KEEP:
        return False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id", "role") and value:
            words = NOISE & set(re.split(r"[^a-z0-9]+", value.lower()))
            if words and not (words == {"header"} and _inside(parent, {"article", "main"})):
                return True
        if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            return True
    return False


def _inside(node: Node | None, tags: set) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


class _Builder(HTMLParser):
    """A tree of Nodes; end tags that HTML lets a page leave out are supplied."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)

    def _close(self, tags: set, until: set) -> None:
        node = self.at
        while node is not self.root and node.tag not in until:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def _end_head(self) -> None:
        if self.at.tag == "head":
            self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._end_head()
        if tag in ("html", "body") and (tag == "html" or _inside(self.at, {"body"})):
            return
        if tag in BLOCK:
            self._close({"p"}, {"table", "button", "article", "section", "div", "td", "th", "li", "blockquote", "aside", "main"})
        if tag in CLOSED_BY:
            self._close(*CLOSED_BY[tag])
        if tag == "body":
            self.at = self.root
        node = Node(tag, self.at, _is_noise(tag, attrs, self.at))
        node.asks = tag in CONTROLS and dict(attrs).get("type") != "hidden"
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag in ("svg", "path"):
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            if tag not in BLOCK and node.tag in BLOCK:  # an inline end tag does not end the block around it
                return
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        if data.strip():
            self._end_head()
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    _spread_noise(builder.root)
    return builder.root


def _spread_noise(root: Node) -> None:
    """What is in noise is noise; but a class says nothing about an element that holds the article or its title."""
    holds = set()
    for node in _walk(root):
        if node.tag in ("article", "main", "h1") and not node.noise or id(node) in holds:
            if node.tag in NEVER or node.tag == "header" and node.noise:
                continue
            node.noise = False
            holds.add(id(node.parent))
    _mark_forms(root, holds)
    todo = [root]
    while todo:
        node = todo.pop()
        for c in node.children:
            if isinstance(c, Node):
                c.noise = c.noise or node.noise
                todo.append(c)


def _mark_forms(root: Node, holds: set) -> None:
    """A form with controls is noise, unless it holds the article, its title or half of the page's text."""
    chars, asks, forms = {}, {}, []
    for node in _walk(root):
        inner = [c for c in node.children if isinstance(c, Node)]
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        chars[id(node)] = 0 if node.noise else own + sum(chars[id(c)] for c in inner)
        asks[id(node)] = node.asks or any(asks[id(c)] for c in inner)
        if node.tag == "form" and asks[id(node)] and id(node) not in holds:
            forms.append(node)
    for node in forms:
        node.noise = node.noise or 2 * chars[id(node)] < chars[id(root)]


def _walk(root: Node):
    """Nodes with children before parents; no recursion, so that depth does not matter."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    return reversed(order)


def measure(root: Node) -> None:
    """Counts, densities and density sums of all nodes."""
    for node in _walk(root):
        for c in node.children:
            if isinstance(c, str):
                node.chars += 0 if node.noise else len(c.strip())
            else:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.chars if c.tag == "a" else c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
    body = next((c for c in root.children if isinstance(c, Node) and c.tag == "body"), root)
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for node in _walk(root):
        node.density = _density(node, ratio)
        node.total = sum(c.density for c in node.children if isinstance(c, Node))


def _density(node: Node, ratio: float) -> float:
    """Characters per tag, times the log of (not-link share x tag share) to a base that grows with links."""
    c, t = node.chars, max(node.tags, 1)
    if not c:
        return 0.0
    lc, lt = max(node.link_chars, 1), max(node.link_tags, 1)
    base = math.log(c / max(c - node.link_chars, 1) * lc + ratio * c + math.e)
    return c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(base)


def _headings(top: Node) -> int:
    return sum(n.tag in HEADINGS and not n.noise for n in _walk(top))


def main_node(root: Node) -> Node:
    """The node of the largest density sum among those that reach the body path's threshold.

    A node's sum counts its children's densities; text of its own counts as one more child. Of
    equal sums the innermost node wins.
    """
    measure(root)
    best, most = root, -1.0
    for node in _walk(root):
        if node.noise:
            continue
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        score = node.total + own
        if node.tag in BLOCK and score > most and node.chars:
            best, most = node, score
    path, node = [], best
    while node is not None:
        path.append(node)
        node = node.parent
    threshold = min((n.density for n in path if n.chars), default=0.0)
    # On the path every node reaches the threshold; an article that has headings besides the winner is whole with them.
    article = best
    while article is not None and article.tag not in ("article", "main"):
        article = article.parent
    if article is not None and _headings(article) > _headings(best):
        best = article
    # Siblings of the winner that reach the threshold belong to it: then their parent is the article.
    while best.parent is not None and best.tag != "body":
        others = [c for c in best.parent.children if isinstance(c, Node) and c is not best and not c.noise]
        if best.tag in _HOLDER and not any(c.chars and c.density >= threshold for c in others):
            break
        best = best.parent
    return best


def text_of(top: Node) -> str:
    """Blocks of a subtree in page order: white space inside a block is one space, a block ends at \\n."""
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        line = " ".join("".join(run).split())
        if line:
            blocks.append(line)
        run.clear()

    todo: list = [top]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        elif not x.noise:
            if x.tag in BLOCK:
                end()
                todo.append(None)
            children = x.children
            if x.tag == "header":
                children = [c for c in children if isinstance(c, Node) and (c.tag in HEADINGS or c.tag == "hgroup")]
            todo += reversed(children)
    end()
    return "\n".join(blocks)


def extract(html: str | None) -> str:
    """Main text of a page; empty for null, empty or textless html."""
    return text_of(main_node(parse(html))) if html else ""


def main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points); columns of those names are replaced.

    Each page is worked on alone, so repeated rows, ties of any kind and empty tables need nothing
    special; a null html is an empty page.
    """
    old = [c for c in pages.columns if c not in ("text", "n_chars")]

    def texts(html: pd.Series) -> pd.Series:
        return html.map(extract)

    udf = F.pandas_udf(texts, "string").asNondeterministic()
    return pages.select(*[F.col(f"`{c}`") for c in old], udf(F.col(html_col)).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long"))
