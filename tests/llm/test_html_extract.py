"""HTML extraction: held-out accuracy on generated pages, exactness on plain ones, hierarchy, rows."""

import itertools
import random

import numpy as np
import pytest

from tidelog.llm.boosting import Boosted
from tidelog.llm.dom import features, parse
from tidelog.llm.html_extract import Unnamed, decode, extract, extract_pages, labelled, model


@pytest.fixture(scope="module")
def trees():
    return model()


def test_held_out_accuracy(trees):
    right = total = whole = 0
    for nodes, x, y in labelled(200, 77):
        found = decode(nodes, trees.log_odds(x))
        hits = [found[i] == bool(y[i]) for i, n in enumerate(nodes) if n.chars]
        right, total, whole = right + sum(hits), total + len(hits), whole + all(hits)
    assert right / total > 0.99 and whole / 200 > 0.93


def test_decoding_is_hierarchical():
    nodes = parse("<div><div>a<div>b<div>c</div></div></div></div>")
    features(nodes)
    rng = np.random.default_rng(0)
    for _ in range(200):
        inside = decode(nodes, rng.normal(size=len(nodes)) * 3)
        changes = [a != b for a, b in zip(inside, inside[1:], strict=False)]
        assert sum(changes) <= 2


@pytest.mark.parametrize("seed", range(40))
def test_decoding_finds_the_best_of_all_labelings(seed):
    """Against all assignments of states to a small tree in which a node's state is its parent's or, before it, a step further."""
    r = random.Random(seed)
    page = ""
    for _ in range(r.randint(1, 4)):
        inner = "".join(r.choice(["<p>t</p>", "<div></div>", "<div>t<p>t</p></div>"]) for _ in range(r.randint(0, 2)))
        page += f"<div>{r.choice(['', 't'])}{inner}</div>"
    nodes = parse(page)[:9]
    features(nodes)
    odds = np.random.default_rng(seed).normal(size=len(nodes)) * 2
    worth = [o * (1.0 if n.chars else 0.3) for n, o in zip(nodes, odds, strict=True)]

    def value(inside):
        return sum(w for w, k in zip(worth, inside, strict=True) if k)

    best = -1e9
    for states in itertools.product(range(3), repeat=len(nodes) - 1):
        states = (0, *states)
        steps = ((states[n.parent.index], states[n.index]) for n in nodes[1:])
        if all(b in {0: (0, 1), 1: (1, 2), 2: (2,)}[a] for a, b in steps):
            best = max(best, value([s == 1 for s in states]))
    assert value(decode(nodes, odds)) == pytest.approx(best)


def test_boosting_learns_a_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.3)).astype(float)
    odds = Boosted(20, 3).fit(x[:1000], y[:1000]).log_odds(x[1000:])
    assert np.mean((odds > 0) == y[1000:]) > 0.97


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body><nav><ul><li><a href="/a">Menu</a></li><li><a href="/b">More</a></li></ul></nav><!-- <p>x</p> -->
<div class="ad">Buy this now.</div><article><h1>Head &amp;  line</h1><p><b>First para,
 with   space.<br><p>Second &eacute;<i>tal</i>ic &lt;b&gt; text goes on for a while, and ends.</p><div class="ad">An advert inside.</div>
<p>Third paragraph with enough words to count as one.</p></article><footer>&copy; someone</footer></body></html>"""


def test_plain_page(trees):
    assert extract([PAGE], trees) == ["Head & line\nFirst para, with space.\nSecond étalic <b> text goes on for a while, and ends.\nThird paragraph with enough words to count as one."]


MENU = '<div class="k2j4"><a href="/">Home</a><a href="/n">News</a><a href="/s">Sport</a><a href="/l">Login</a><a href="/r">Register</a></div>'
BODY = [
    "The harbour council voted on Tuesday to replace the old swing bridge, ending a dispute that had gone on for eleven years.",
    "Engineers told the meeting that corrosion had reached the main bearings, and that a repair would cost almost as much as a new crossing.",
    "Work is expected to begin in spring. Until then, the bridge stays open to pedestrians, but lorries have to take the northern road.",
]
TEXT = "\n".join(BODY)
OTHER_LAYOUTS = {
    "div only, names without meaning": f"<html><body><div class='a1'>{MENU}</div><div class='x9'><div class='y'>{''.join(f'<p>{b}</p>' for b in BODY)}</div></div><div class='f3'><a href='/i'>Imprint</a> <a href='/p'>Privacy</a></div></body></html>",
    "table": f"<table><tr><td><a href='/1'>One</a><br><a href='/2'>Two</a><br><a href='/3'>Three</a></td><td>{''.join(f'<p>{b}</p>' for b in BODY)}</td></tr></table>",
    "named blog": f"<body><header><a href='/'>The Gazette</a></header><div id='content' class='post'>{''.join(f'<p>{b}</p>' for b in BODY)}</div><div id='comments'><h3>3 comments</h3><p>Good riddance to it.</p></div><footer>All rights reserved.</footer></body>",
    "article with share links and form": f"<main><article><p>{BODY[0]}</p><p>{BODY[1]}</p><p>{BODY[2]}</p><div class='share'><ul><li><a href='#'>Mail</a></li><li><a href='#'>Print</a></li></ul></div></article><form action='/sub'><p>Get our letter</p><button>Subscribe</button></form></main>",
    "cookie notice first": f"<body><div class='cookie-consent'><p>We use cookies to improve this site.</p><button>Accept</button></div><nav>{MENU}</nav><main>{''.join(f'<p>{b}</p>' for b in BODY)}</main></body>",
}


@pytest.mark.parametrize("name", OTHER_LAYOUTS)
def test_layouts_that_the_generator_does_not_make(trees, name):
    assert extract([OTHER_LAYOUTS[name]], trees) == [TEXT]


def test_held_out_accuracy_without_names(trees):
    right = total = 0
    for nodes, x, y in labelled(200, 78, Unnamed):
        found = decode(nodes, trees.log_odds(x))
        weight = [n.chars for n in nodes]
        right, total = right + sum(w for i, w in enumerate(weight) if found[i] == bool(y[i])), total + sum(weight)
    assert right / total > 0.93


@pytest.mark.parametrize("n", [3, 48, 49, 50, 184])
def test_same_siblings_are_counted_exactly(n):
    nodes = parse("<article><h1>Head</h1>" + "<p>text</p>" * n + "</article>")
    same = dict(zip((x.tag for x in nodes), features(nodes)[:, -5], strict=True))
    assert same["article"] == same["h1"] == 1 and same["p"] == n


def test_broken_html_does_not_crash(trees):
    hard = ["", "<", "<p", "</p></div>", "<script>", "<!--", "a" * 50_000, "<div>" * 3000 + "x", "<p>" * 5000, "<a href='x>y", "<TD>x<tr><td>y", "&#0;&bogus;&#x110000;", "<İ>x</İ><script>y</script>"]
    assert len(extract(hard, trees)) == len(hard)


def test_rows(spark):
    rows = [(1, "u", PAGE, 1), (None, None, None, 1), (2, "v", "", 1), (1, "u", PAGE, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(map(tuple, extract_pages(pages).collect()), key=str)
    text = extract([PAGE], model())[0]
    assert got == sorted([(1, "u", text, len(text)), (None, None, "", 0), (2, "v", "", 0), (1, "u", text, len(text))], key=str)
    assert extract_pages(pages.limit(0)).count() == 0
