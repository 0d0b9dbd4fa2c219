import itertools
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from sluiceway.llm import html_text as H

#: The costs before a sample.
W = H.fit(np.zeros((0, 7)), [], [], np.zeros(0, int), np.zeros((2, 2)))
LONG = "<p>The council agreed on Tuesday to widen the bridge, which carries twice the traffic that it was built for.</p>"
LINE = LONG[3:-4]

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, and so on.</p></div>
<article><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>&nbsp;word&#33;<br>next
 line<p>Second. <div class="ad">Buy now.</div><p>a &lt;b&gt; &copy &am</p><ul><li>one<li>two</ul></article>
<section id="comments"><p>I like this article very much, thank you.</p></section><form>Name <input name="x"><textarea>t</textarea><button>Go</button></form>
<aside><p>Other texts that you may like to read, one by one.</p></aside><footer>&copy; 2020 Site.</footer></body></html>"""


def test_article_only():
    assert H.main_text(PAGE, W) == "Head & line\nFirst bold word! next line\nSecond.\na <b> © &am\none\ntwo"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>never closed <p>x", "<nav>only a menu</nav>", "</p></div>", "<a href='x"])
def test_pages_without_content(page):
    assert H.main_text(page, W) in ("", "<")


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<div class="form-group"><article>{LONG}</article></div>', LINE),
        (f'<article>{LONG}<p class="share-price">It closed at 41.2, up a little.</p></article>', LINE + "\nIt closed at 41.2, up a little."),
        (f'<article>{LONG}<div class="search-results"><p>Three results were found in all.</p></div></article>', LINE + "\nThree results were found in all."),
        (f'<article>{LONG}<section id="related-work"><p>Others did look at bridges before.</p></section></article>', LINE + "\nOthers did look at bridges before."),
        (f"<article>{LONG}<p>Where <math><mi>x</mi><mo>=</mo><mn>3</mn></math> holds.</p><object>A drawing of it.</object></article>", LINE + "\nWhere x=3 holds.\nA drawing of it."),
        (f'<article>{LONG}<div class="comments"><p>I do not agree, it is wrong!</p></div></article>', LINE),
        (f'<article>{LONG}<section id="comments"><article class="comment"><p>I do not agree, it is wrong!</p></article></section></article>', LINE),
        (f'<article>{LONG}<div class="newsletter-signup">Subscribe now, please.</div></article>', LINE),
    ],
)
def test_names_weigh_and_do_not_decide_alone(page, want):
    assert H.main_text(page, W) == want


def test_neighbours_decide_where_a_block_alone_would_not():
    page = f"<body><div>{LONG}<p>Yes</p>{LONG}</div></body>"
    found = H.blocks(page)
    odds, edges = H.network(found, W)
    assert [o > 0 for o in odds] == [True, False, True] and len(edges) == 4
    assert H.main_text(page, W) == f"{LINE}\nYes\n{LINE}"


PIECES = [LONG, "<p>Yes</p>", "<nav><a href=x>Home</a></nav>", "<article>", "</article>", '<div class="ad">Buy it.</div>', '<div class="related">', "</div>", "<footer>Ours.", "<li>one", "Loose words, and some more of them. "]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), min_size=1, max_size=8))
def test_text_is_that_of_the_cheapest_labelling(pieces):
    """Against all labellings: each block on the wrong side costs its odds, each edge that is cut its weight."""
    found = [b for b in H.blocks("".join(pieces)) if not b.never]
    odds, edges = H.network(found, W)
    cost = lambda keep: sum(max(0.0, -o) if k else max(0.0, o) for o, k in zip(odds, keep, strict=True)) + sum(c for a, b, c in edges if keep[a] != keep[b])
    every = {k: cost(k) for k in itertools.product([False, True], repeat=len(found))}
    least = {"\n".join(b.text for b, x in zip(found, k, strict=True) if x) for k, c in every.items() if c <= min(every.values()) + 1e-9}
    assert H.main_text("".join(pieces), W) in least


def test_deep_nesting_takes_linear_time():
    began = time.perf_counter()
    assert H.blocks("<div>" * 100_000 + "x")[0].text == "x"
    assert len(H.blocks("<li>" + "<div>" * 30_000 + "<ul>" + "<div>" * 30_000 + "<li>u</li>" * 30_000)) == 30_000
    assert len(H.blocks('<div class="a">t' * 20_000)) == 20_000
    assert time.perf_counter() - began < 20


def test_fit_learns_hints_and_edges():
    pages = [f'<nav><a href=x>Menu {i}</a></nav><div class="zq">Buy this {i} now</div><article>{LONG}<p>Word {i}, and so on.</p></article>' for i in range(20)]
    found = [b for p in pages for b in H.blocks(p)]
    costs = H.fit(np.array([b.own for b in found]), [b.tags for b in found], [b.hints for b in found], np.array([b.label if "i:zq" not in b.hints else 0 for b in found]), np.array([[0, 20], [20, 0]]))
    assert costs.signs["i:zq"] < -0.2 and H.prior("i:zq") == 0 and costs.edges[0] < 0.2 < 1 < costs.edges[1]


def test_cut_off_pages_and_long_ones():
    assert H.main_text("<article><p>Whole text here. <p>cut o", W) == "Whole text here.\ncut o"
    many = "<article>" + "".join(f"<p>Paragraph {i} has words, and a stop.</p>" for i in range(3000)) + "</article>"
    assert len(H.main_text(many, W).split("\n")) == 3000
    assert H.main_text("<article>" + "<div>" * 500 + "deep text here." + "</div>" * 500 + "</article>", W) == "deep text here."


def test_page_without_article_element():
    page = '<body><div class="menu"><a href="/">Home</a> <a href="/b">B</a></div><div><h2>Title</h2><p>A long paragraph, with many words in it. And one more.</p><p>Short one.</p><p>Another long paragraph, which goes on for a while.</p></div><div class="footer">Imprint</div></body>'
    assert H.main_text(page, W) == "Title\nA long paragraph, with many words in it. And one more.\nShort one.\nAnother long paragraph, which goes on for a while."


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_the_cut_is_minimal(data):
    n = data.draw(st.integers(1, 6))
    weight = st.integers(0, 5).map(float)
    s, t = (data.draw(st.lists(weight, min_size=n, max_size=n)) for _ in range(2))
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), weight).filter(lambda e: e[0] != e[1]), max_size=10))
    cost = lambda keep: sum(t[i] if k else s[i] for i, k in enumerate(keep)) + sum(c for a, b, c in edges if keep[a] != keep[b])
    assert cost(H.cut(s, t, edges)) == pytest.approx(min(cost(k) for k in itertools.product([False, True], repeat=n)))


def test_operator(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
    rows = [(1, "x", "u", PAGE), (1, "x", "u", PAGE), (2, None, None, None), (None, "x", "v", "")]
    got = H.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((repr(r.page_id), repr(r.url), len(r.text) > 0) for r in got) == [("1", "'u'", True), ("1", "'u'", True), ("2", "None", False), ("None", "'v'", False)]
    assert H.extract(spark.createDataFrame([], schema)).collect() == []
