"""A lenient reader of HTML into block elements, and their features."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.S)
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: What an opening tag closes, if it is the innermost open block.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head", "title"}}
PHRASE = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ATTRIBUTE_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "li", "ul", "ol", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "title", "head", "body", "button", "dl")
GOOD = {"article", "content", "main", "post", "entry", "story", "body", "text", "page", "blog", "prose"}
BAD = {"ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "nav", "navbar", "menu", "sidebar", "footer", "header", "masthead", "comment", "comments", "disqus", "reply", "respond", "cookie", "cookies", "consent", "notice", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "share", "sharing", "social", "related", "recommended", "widget", "breadcrumb", "breadcrumbs", "pagination", "pager", "tags", "login", "search", "legal", "copyright", "toolbar", "form"}


class Node:
    __slots__ = ("tag", "parent", "children", "content", "good", "bad", "depth", "links", "link_chars", "inline", "chars", "commas", "stops", "blocks", "paras", "all_chars", "all_links", "all_link_chars", "all_blocks", "all_stops", "all_paras", "index")

    def __init__(self, tag: str, parent: Node | None, attributes: str) -> None:
        self.tag, self.parent, self.children, self.content = tag, parent, [], []
        self.depth = parent.depth + 1 if parent else 0
        self.good = self.bad = 0
        self.links = self.link_chars = self.inline = 0
        if attributes:
            for m in ATTRIBUTE.finditer(attributes):
                words = {w.lower() for w in ATTRIBUTE_WORD.findall(m[1] or m[2] or m[3] or "")}
                self.good += len(words & GOOD)
                self.bad += len(words & BAD)


def parse(html: str) -> list[Node]:
    """The block elements of a page in page order, a root without tag first. A node's content holds its text and its children."""
    root = Node("", None, "")
    nodes, node, at, link = [root], root, 0, False
    low = None
    while True:
        m = TOKEN.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            if "&" in text:
                text = unescape(text)
            node.content.append(text)
            if link:
                node.link_chars += len(text)
        if not m:
            return nodes
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                link = link and tag != "a"
                continue
            if tag in RAW or tag in VOID:
                if tag == "br":
                    node.content.append(" ")
                continue
            up = node
            while up.parent and up.tag != tag:
                up = up.parent
            if up.parent:
                node, link = up.parent, False
            continue
        if tag in INLINE:
            node.inline += 1
            if tag == "a":
                link = True
                node.links += 1
        elif tag in RAW:
            if not m[3].endswith("/") or tag in ("script", "style"):
                low = html.lower() if low is None else low
                end = low.find(f"</{tag}", at) if len(low) == len(html) else -1
                if end < 0:
                    end = next((x.start() for x in re.compile(f"</{tag}", re.I).finditer(html, at)), len(html))
                at = end
        elif tag in VOID:
            node.content.append(" ")
        else:
            if node.tag in PHRASE or node.tag in CLOSES.get(tag, ()):
                node = node.parent
                while tag in ("tr",) and node.tag in ("td", "th", "tr"):
                    node = node.parent
            link = False
            child = Node(tag, node, m[3])
            node.content.append(child)
            node.children.append(child)
            nodes.append(child)
            node = child


def measure(nodes: list[Node]) -> None:
    """Fills in the sums over own text and over subtrees."""
    for i, n in enumerate(nodes):
        own = "".join(x for x in n.content if x.__class__ is str)
        n.index = i
        n.chars = len(own) - own.count(" ") if own.strip() else 0
        n.commas, n.stops = own.count(","), own.count(".") + own.count("!") + own.count("?")
        n.all_chars, n.all_links, n.all_link_chars, n.all_blocks, n.all_stops, n.all_paras = n.chars, n.links, n.link_chars, 1, n.stops, int(n.tag == "p")
    for n in reversed(nodes):
        if p := n.parent:
            p.all_chars += n.all_chars
            p.all_links += n.all_links
            p.all_link_chars += n.all_link_chars
            p.all_blocks += n.all_blocks
            p.all_stops += n.all_stops
            p.all_paras += n.all_paras


FEATURES = len(TAGS) * 2 + 26
_TAG = {t: i for i, t in enumerate(TAGS)}


def features(nodes: list[Node]) -> np.ndarray:
    """One row a node: tag, attribute words, text, links, subtree density, depth, siblings, ancestors."""
    measure(nodes)
    out = np.zeros((len(nodes), FEATURES), np.float32)
    total = max(1, nodes[0].all_chars)
    above: list[tuple[int, int, int]] = []
    tags: list[Counter | None] = []  # of each node's children
    for i, n in enumerate(nodes):
        row = out[i]
        if n.tag in _TAG:
            row[_TAG[n.tag]] = 1
        p = n.parent
        good, bad, article = above[p.index] if p else (0, 0, 0)
        above.append((good + n.good, bad + n.bad + (n.tag in ("nav", "footer", "aside", "form", "header")), article + (n.tag in ("article", "main"))))
        if p and p.tag in _TAG:
            row[len(TAGS) + _TAG[p.tag]] = 1
        siblings = p.children if p else [n]
        tags.append(Counter(c.tag for c in n.children) if n.children else None)
        same = tags[p.index][n.tag] if p else 1
        first = siblings[0] is n
        row[2 * len(TAGS) :] = (
            n.good, n.bad, good, bad, article,
            n.chars, n.commas / (n.chars + 1), n.stops / (n.chars + 1), n.link_chars / (n.chars + 1), n.links, n.inline,
            n.all_chars, n.all_chars / total, n.all_link_chars / (n.all_chars + 1), n.all_links, n.all_blocks, n.all_chars / n.all_blocks, n.all_stops, n.all_paras,
            n.depth, len(siblings), same, first, siblings[-1] is n, p.all_chars / total if p else 1, n.all_chars / (p.all_chars + 1) if p else 1,
        )
    return out


def text_of(nodes: list[Node], inside: list[bool]) -> str:
    """The text of the chosen nodes: a line for each block, white space as one blank."""
    lines, run = [], []

    def flush() -> None:
        line = " ".join("".join(run).split())
        if line:
            lines.append(line)
        run.clear()

    stack = [(nodes[0], iter(nodes[0].content))]
    while stack:
        node, rest = stack[-1]
        for x in rest:
            if x.__class__ is str:
                if inside[node.index]:
                    run.append(x)
            else:
                flush()
                stack.append((x, iter(x.content)))
                break
        else:
            flush()
            stack.pop()
    return "\n".join(lines)
