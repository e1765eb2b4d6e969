"""Main text of web pages: boosted trees over DOM nodes and a hierarchical decoding.

A page becomes a tree of block elements. Boosted trees give each node the log-odds that its own text belongs to the
article, from its tag, its attributes' words, its text, links and subtree, its depth, siblings and ancestors. The
decoding then picks the best states of all nodes together: along any path from the root, nodes are first outside the
article, then in it, then in something left out of it, and never go back. So nothing inside an advert within an
article is kept, and no article starts inside another's footer.

The trees are fitted to generated pages of many layouts (TRAINING_PAGES of them, and UNNAMED_PAGES that tell nothing by their
tags or attributes, from a fixed seed), whose article is known. They are fitted once in the driver and sent with the tasks.

Defined results: null html counts as empty; a page without an article gives an empty text; a null page_id or url stays null;
repeated rows give repeated results; a page of any length or depth is read whole, alone in its slice of a batch; an empty
table gives an empty result; columns beyond the three named have no effect, whatever their names.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.boosting import Boosted
from tidelog.llm.common import slices
from tidelog.llm.dom import Node, features, parse, text_of

TRAINING_PAGES = 400
UNNAMED_PAGES = 300
SEED = 11
BEFORE, IN, OUT = range(3)


class Layouts:
    """Generates pages with a known article. Text of the article is marked by the character MARK."""

    MARK = "⁠"

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        parts = ["an", "er", "ti", "on", "th", "ou", "le", "in", "st", "é", "ing", "ed", "be", "ch", "ea", "tion", "que", "ó"]
        self.words = ["".join(self.r.choice(parts) for _ in range(self.r.randint(1, 4))) for _ in range(400)]

    def prose(self, low: int, high: int) -> str:
        n = max(1, round(low * (high / low) ** self.r.random()))
        odd = self.r.choice(["", "", "", "&amp;", "***", "!!", " |"])
        out = [self.r.choice(self.words) + (self.r.choice([",", ".", ". ", odd]) if self.r.random() < 0.2 else "") for _ in range(n)]
        return " ".join(out).capitalize() + self.r.choice([".", "", "."])

    def word(self) -> str:
        return self.r.choice(self.words).capitalize()

    def attribute(self, *names: str) -> str:
        r = self.r
        if r.random() < 0.15:
            return ""
        name = r.choice(names) + r.choice(["", "", "-1", "-wrap", " clearfix", "_block"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.word()}</a></li>' for i in range(n))

    def menu(self) -> str:
        body = f"<ul>{self.links(self.r.randint(2, 12))}</ul>"
        return self.r.choice([f"<nav>{body}</nav>", f"<nav{self.attribute('nav', 'menu')}>{body}</nav>", f"<div{self.attribute('menu', 'navbar', 'breadcrumb')}>{body}</div>", f"<header>{body}</header>"])

    def advert(self) -> str:
        text = self.prose(2, 30)
        body = self.r.choice([text, f"<p>{text}</p>", f'<a href="x">{text}</a>', f"<h3>{self.word()}</h3><p>{text}</p>"])
        return f"<{(t := self.r.choice(['div', 'aside', 'section', 'div']))} class=\"{self.r.choice(['ad', 'ads', 'advert', 'sponsor', 'promo', 'banner'])}\">{body}</{t}>"

    def notice(self) -> str:
        text = self.prose(4, 60)
        return f"<div{self.attribute('cookie', 'notice', 'consent', 'alert')}><p>{text}</p><button>{self.word()}</button></div>" if self.r.random() < 0.5 else f"<div class=\"{self.r.choice(['cookie-notice', 'consent', 'gdpr', 'notice', 'alert'])}\">{text}</div>"

    def comments(self) -> str:
        item = lambda: f"<div class=\"comment\"><h4>{self.word()}</h4><p>{self.prose(3, 80)}</p></div>"
        return f"<{(t := self.r.choice(['section', 'div', 'aside']))} class=\"{self.r.choice(['comments', 'comment-list', 'respond', 'disqus'])}\"><h3>{self.word()}</h3>{''.join(item() for _ in range(self.r.randint(1, 6)))}</{t}>"

    def form(self) -> str:
        return f"<form{self.attribute('search', 'login', 'newsletter')}><p>{self.prose(1, 12)}</p><input name=q><select><option>{self.word()}</select><button>{self.word()}</button></form>"

    def sidebar(self) -> str:
        body = f"<h3>{self.word()}</h3>" + self.r.choice([f"<ul>{self.links(5)}</ul>", f"<p>{self.prose(5, 60)}</p>", f'<p><a href="#">{self.prose(3, 9)}</a></p>' * 3])
        return self.r.choice([f"<aside>{body}</aside>", f"<aside{self.attribute('sidebar', 'related')}>{body}</aside>", f"<div class=\"{self.r.choice(['sidebar', 'widget', 'related', 'recommended'])}\">{body}</div>"])

    def footer(self) -> str:
        text = f"&copy; {self.word()} &middot; {self.prose(2, 50)}"
        body = self.r.choice([text, f"<p>{text}</p>", f"<ul>{self.links(4)}</ul><p>{text}</p>"])
        return self.r.choice([f"<footer>{body}</footer>", f"<footer>{body}</footer>", f"<div{self.attribute('footer', 'copyright', 'legal')}>{body}</div>"])

    def block(self) -> str:
        r, m = self.r, self.MARK
        text = m + self.prose(1, 250)
        close = r.choice(["</p>", "</p>", ""])
        return r.choice(
            [f"<p>{text}</p>"] * 8
            + [f"<p>{text}{close}", f"<p><b>{text}<br>", f'<p>{text} <a href="/x">{self.word()}</a> {self.prose(1, 30)}</p>', f"<h2>{m}{self.prose(1, 10)}</h2>", f"<h3>{m}{self.word()}</h3>"]
            + [f"<ul>{''.join(f'<li>{m}{self.prose(1, 25)}</li>' for _ in range(r.randint(1, 6)))}</ul>", f"<blockquote><p>{text}</p></blockquote>", f"<pre>{m}{self.prose(3, 40)}</pre>"]
            + [f"<table><tr><td>{m}{self.word()}<td>{m}{self.prose(1, 8)}</table>", f"<figure><img src=x><figcaption>{m}{self.prose(2, 15)}</figcaption></figure>", f"<div>{text}</div>"]
        )

    def article(self) -> str:
        r = self.r
        body = []
        if r.random() < 0.8:
            body.append(f"<h1>{self.MARK}{self.prose(1, 15)}</h1>")
        for _ in range(max(1, round(14 * r.random() ** 2))):
            body.append(self.block())
            if r.random() < 0.08:
                body.append(r.choice([self.advert, self.sidebar, self.form, self.notice])())
        if r.random() < 0.15:
            body.append(r.choice([self.comments, self.footer, lambda: f"<div class=\"share\"><ul>{self.links(4)}</ul></div>"])())
        text = "".join(body)
        wrap = r.choice(["article"] * 4 + ["main", "content", "both", "plain"])
        if wrap == "article":
            return f"<article{self.attribute('post', 'story', '')}>{text}</article>"
        if wrap == "main":
            return f"<main>{text}</main>"
        if wrap == "both":
            return f"<main><article><div class=\"{r.choice(['entry-content', 'post-body', 'text'])}\">{text}</div></article></main>"
        return f"<div class=\"{r.choice(['content', 'main-content', 'article-body', 'post', 'entry'])}\">{text}</div>" if wrap == "content" else f"<div>{text}</div>"

    def page(self) -> str:
        r = self.r
        some = lambda p, f: f() if r.random() < p else ""
        before = [some(0.8, self.menu), some(0.3, self.notice), some(0.5, self.advert), some(0.2, self.sidebar), some(0.1, self.form)]
        after = [some(0.25, self.sidebar), some(0.3, self.comments), some(0.2, self.form), some(0.2, self.advert), some(0.8, self.footer), some(0.15, self.notice)]
        if r.random() < 0.3:
            r.shuffle(before)
        main = self.article() if r.random() < 0.97 else ""
        return f"<!DOCTYPE html><html><head><title>{self.prose(2, 12)}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"


class Unnamed(Layouts):
    """The same pages built from `div`, tables, or names that mean nothing, as tools make them: only text and links tell what is what."""

    NAMED = re.compile(r"<(/?)(article|main|nav|header|footer|aside|section)\b")
    ATTRIBUTE = re.compile(r' (class|id)="[^"]*"')

    def hashed(self, _: re.Match) -> str:
        return f' class="{self.r.choice(["css-", "_", "sc-", ""])}{self.r.getrandbits(28):x}"'

    def page(self) -> str:
        r, text = self.r, super().page()
        if r.random() < 0.7:
            text = self.ATTRIBUTE.sub(self.hashed, text)
        kind = r.random()
        if kind < 0.5:
            return self.NAMED.sub(r"<\1div", text)
        if kind < 0.75:
            text = self.NAMED.sub(r"<\1div", text)
            head, _, body = text.partition("<body>")
            cells = "".join(f"<td{self.attribute('left', 'col', 'x')}>{x}</td>" for x in (self.menu(), body.replace("</body></html>", ""), self.sidebar()))
            return f"{head}<body><table><tr>{self.NAMED.sub(r'<\1div', cells)}</tr></table></body></html>"
        return text


def labelled(pages: int, seed: int, layouts: type[Layouts] = Layouts) -> Iterator[tuple[list[Node], np.ndarray, np.ndarray]]:
    """Nodes, features and labels of generated pages; marks are taken out of the text first."""
    made = layouts(seed)
    for _ in range(pages):
        nodes = parse(made.page())
        own = np.array([any(x.__class__ is str and made.MARK in x for x in n.content) for n in nodes])
        for n in nodes:
            n.content = [x.replace(made.MARK, "") if x.__class__ is str else x for x in n.content]
        # A node without text of its own counts as in the article if what is below it is, by and large.
        x = features(nodes)
        mass = np.array([n.chars * (1 if k else -1) for n, k in zip(nodes, own, strict=True)], float)
        for n in reversed(nodes):
            if n.parent:
                mass[n.parent.index] += mass[n.index]
        yield nodes, x, np.where([n.chars > 0 for n in nodes], own, mass > 0)


@cache
def model(pages: int = TRAINING_PAGES, seed: int = SEED) -> Boosted:
    found = [*labelled(pages, seed), *labelled(UNNAMED_PAGES, seed + 1, Unnamed)]
    x, y = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found]).astype(float)
    weight = np.concatenate([[1.0 if n.chars else 0.3 for n in f[0]] for f in found])
    return Boosted().fit(x, y, weight)


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """Whether each node is in the article: the best states of all nodes of a page together."""
    gain = odds.tolist()
    # best[i][s]: of the subtree of node i in state s, relative to all of it being outside.
    best = [[0.0, 0.0, 0.0] for _ in nodes]
    for n in reversed(nodes):
        own = best[n.index]
        own[IN] += gain[n.index] * (1.0 if n.chars else 0.3)
        if n.parent:
            up = best[n.parent.index]
            up[BEFORE] += max(own[BEFORE], own[IN])
            up[IN] += max(own[IN], own[OUT])
            up[OUT] += own[OUT]
    state = [BEFORE] * len(nodes)
    for n in nodes[1:]:
        above, own = state[n.parent.index], best[n.index]
        if above == BEFORE:
            state[n.index] = IN if own[IN] > own[BEFORE] else BEFORE
        elif above == IN:
            state[n.index] = IN if own[IN] >= own[OUT] else OUT
        else:
            state[n.index] = OUT
    return [s == IN for s in state]


def extract(pages: list[str], trees: Boosted) -> list[str]:
    """The main text of each page."""
    parsed = [parse(p) for p in pages]
    if not parsed:
        return []
    odds = trees.log_odds(np.concatenate([features(nodes) for nodes in parsed]))
    out, at = [], 0
    for nodes in parsed:
        out.append(text_of(nodes, decode(nodes, odds[at : at + len(nodes)])))
        at += len(nodes)
    return out


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    trees = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__html"):
            texts = extract([x or "" for x in batch.column(2).to_pylist()], trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("__html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
