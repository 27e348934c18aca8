import itertools
import random

import pytest

from cohortix.llm import html_extract as g

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{x:1}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1><nav><a href=x>Home</a></nav></header>
<div class="cookie-notice">We use cookies on this site for many long winded reasons</div>%s
<aside>Related stuff to read</aside><footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain &lt;b&gt; text", "plain <b> text"), ("a < b", "a < b"),
    ("<p>&amp;amp; x&nbsp;y\n\t z", "&amp; x y z"),
    (PAGE % "<article><h1>Title</h1><p>Be.</p><p><b>bold<br><p>next <i>in</i>line</article>", "Title Be. bold next inline"),
    (PAGE % """<main><div class="post-content"><p>First <a href="y">linked</a> words.<div class="ad">Buy now</div>
     <ul><li>one<li>two</ul><form><label>Mail</label></form><section id="comments"><p>Great post, I love it very much
     indeed</p></section></div></main>""", "First linked words. one two"),
    (PAGE % "<article><header><h2>Head</h2><div>by someone</div></header><p title=\"a>b\">Body</p></article>", "Head Body"),
    (PAGE % "", ""),
    ('<div id="menu"><a href=1>A</a> <a href=2>B</a></div><div><p>A long paragraph that stands without an article.</p><p>Short.</p>'
     '<p>One more long paragraph that a reader would want.</p></div><div><a href=1>Privacy</a> <a href=2>Terms</a></div>',
     "A long paragraph that stands without an article. Short. One more long paragraph that a reader would want."),
])
def test_pages(page, text):
    assert g.extract_text(page) == text


def test_long_page_is_read_whole():
    body = "".join(f"<p>para {k} of the text</p>" for k in range(5000))
    assert g.extract_text(PAGE % f"<article>{body}</article>").split().count("para") == 5000


def test_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 8)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(label):
            return sum(max(-s, 0) if keep else max(s, 0) for s, keep in zip(scores, label)) + sum(
                w for a, b, w in edges if label[a] != label[b])
        got = cost(g.minimum_cut(scores, edges))
        assert got == pytest.approx(min(cost(x) for x in itertools.product([False, True], repeat=n)))


def test_query(spark):
    rows = [(1, "u", PAGE % "<article><p>x y</p></article>", "z"), (None, None, None, "z"), (1, "u", "", None)]
    out = g.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert sorted([(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in out], key=str) == sorted(
        [(1, "u", "x y", 3), (None, None, "", 0), (1, "u", "", 0)], key=str)
    assert g.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


@pytest.mark.parametrize("page,text", [
    (PAGE % '<div class="layout with-sidebar"><article><p>One two.</p></article></div>', "One two."),
    (PAGE % '<div id="search-page"><article><h1>T</h1><p>One two.</p></article><p>x</p></div>', "T One two."),
    (PAGE % '<div class="comments-enabled"><main><p>One two.</p></main></div>', "One two."),
    (PAGE % '<div class="sidebar-layout"><article><p>One two.</p></article></div>', "One two."),
    (PAGE % '<form id="aspnet"><article><p>One two.</p></article></form>', "One two."),
    (PAGE % '<main><div class="layout notices"><article><p>One two.</p></article></div></main>', "One two."),
    # teasers and comments stay away
    (PAGE % '<article><p>One two.</p></article><div class="sidebar"><article><p>Teaser text</p></article></div>', "One two."),
    (PAGE % '<article><p>One two.</p><div class="replies"><article><p>I agree with this</p></article></div></article>', "One two."),
    (PAGE % '<div class="layout search"><article><p>One two.</p></article></div><div id="comments"><article class="comment">'
     '<p>I agree</p></article></div>', "One two."),
    # elements that hold text, and raw ones without an end
    (PAGE % "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p><object>chart of it</object>"
     "<noscript><p>plain form</p></noscript></article>", "Let x=1 be. chart of it plain form"),
    (PAGE % "<article><p>One <svg/>two.</p><p>Three <button/>four.</p><script src='x'/><p>Five.</p></article><svg></svg>",
     "One two. Three four. Five."),
    ("<article><p>One two.</p><object data=x><p>Three four.</p></article>", "One two. Three four."),
    ("<article><p>One <button>two.</p><p>Three.</p><button>Buy</button></article>", "One two. Three."),
    ("<article><p>One <svg><svg><text>no</text></svg><title>no</title></svg>two.</p><select><option>no</select></article>", "One two."),
])
def test_nothing_else_is_dropped(page, text):
    assert g.extract_text(page) == text
