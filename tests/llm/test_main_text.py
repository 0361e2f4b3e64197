import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from spanloom.llm import main_text
from spanloom.llm.html_blocks import blocks
from spanloom.llm.queries import op13_html_text

WORDS = "the river runs along a quiet valley where people have lived for many years and still grow barley on terraces above water".split()


def prose(rnd, n):
    out = []
    for _ in range(n):
        s = [rnd.choice(WORDS) for _ in range(rnd.randrange(8, 22))]
        out.append(" ".join([s[0].capitalize(), *s[1:]]) + ".")
    return " ".join(out)


def around(article, body='class="page"'):
    return (
        "<!DOCTYPE html><html class='has-sidebar'><head><title>T &amp; t</title><style>p{}</style><script>if (a<b) document.write('</p>')</script></head><body " + body + ">"
        "<header id='top'><h1>The Daily Site</h1><nav><ul><li><a href='/'>Home<li><a href='/n'>News</a></ul></nav></header><div class='cookie-notice'>We use cookies to make this site work for you. Accept.</div>"
        + article
        + "<aside class='sidebar'><h3>Most read</h3><ul><li><a href='/1'>Something else happened</a></ul></aside><form><label>Search</label><input><button>Go</button></form>"
        "<div id='comments'><h2>2 comments</h2><div class='comment'><p>I do not agree with any of this, it is all wrong.</p></div></div><footer><p>&copy; 2020 The Daily Site. All rights reserved.</p></footer></body></html>"
    )


def page(kind, rnd):
    """(html, main text) of an article that is marked in one of several ways."""
    body = [prose(rnd, rnd.randrange(2, 6)) for _ in range(rnd.randrange(3, 7))]
    ps = "".join(f"<p>{t}" + ("<div class='ad'>Buy now, a great offer is waiting here.</div>" if i == 1 else "") for i, t in enumerate(body))
    text = "\n".join(["Rivers & valleys", *body])
    if kind == "article":
        return around(f"<article><header><h1>Rivers &amp; valleys</h1></header>{ps}</article>"), text
    if kind == "main":
        return around(f"<main><h1>Rivers &amp; valleys</h1>{ps}<div class='share-links'>Share this story with everybody you know.</div></main>"), text
    if kind == "class":
        return around(f"<div class='post-content'><h1>Rivers &amp; valleys</h1>{ps}</div>"), text
    if kind == "words":
        return around(f"<div class='x17'><h1>Rivers &amp; valleys</h1>{ps}</div>"), text
    return around(f"<h1>Rivers &amp; valleys</h1>{ps}", "id=b"), text


def test_articles_are_found_however_they_are_marked():
    rnd = random.Random(4)
    cases = [page(k, rnd) for k in ("article", "main", "class", "words", "bare") * 20]
    x = [(main_text.describe(p), [main_text.weak_label(b) for b in p]) for p in (blocks(h) for h, _ in cases)]
    rows = np.concatenate([a for a, _ in x])
    y = np.array([-1 if v is None else v for _, b in x for v in b])
    for weights in (main_text.PRIOR, main_text.fit(rows[y >= 0], y[y >= 0])):
        got = main_text.main_text([h for h, _ in cases], weights)
        assert [g for g, (_, t) in zip(got, cases, strict=True) if g != t] == []


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", []), ("  \n ", []), ("a &lt;b&gt; &eacute;&#233;&#x41;&nbsp;&am &amp", ["a <b> ééA &am &"]), ("<p>one<p>two <b>three<br>four</p>five", ["one", "two three four", "five"]),
        ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("1 < 2 <3 <> </ > x", ["1 < 2 <3 <> x"]), ("a<!-- <p>b --> c<!-->d<!-- e", ["a cd"]), ("a<script>if(1<2){'</p>'}</SCRIPT >b<style>c", ["ab"]),
        ('<div title="a > b">x</div y>z', ["x", "z"]), ("<p>a</div></section></p>b", ["a", "b"]), ("x<svg><title>t</title><text>u</text></svg>y", ["x", "y"]), ("<td>a<td>b<tr><td>c", ["a", "b", "c"]),
        ("a < b <p c", ["a < b"]), ("<textarea>a<p>b</textarea>c", ["c"]), ("　a\x0b\x0cb c", ["a b c"]), ("<P CLASS=x>A</P>", ["A"]),
    ],
)
def test_blocks(html, want):
    assert [b.text for b in blocks(html)] == want


def test_minimum_cut_is_the_least_labelling():
    rnd = random.Random(7)
    for _ in range(300):
        n = rnd.randrange(1, 9)
        cost = [rnd.randrange(-9, 10) for _ in range(n)]
        edges = {(i, j): rnd.randrange(1, 8) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.5}
        price = lambda side: sum(c if c > 0 and not s else -c if c < 0 and s else 0 for c, s in zip(cost, side, strict=True)) + sum(w for (i, j), w in edges.items() if side[i] != side[j])  # noqa: B023, E731
        best = min((price(s), sum(s)) for s in itertools.product((False, True), repeat=n))
        got = main_text.minimum_cut(cost, edges)
        assert (price(got), sum(got)) == best


def test_odd_pages_take_linear_time():
    for odd in ("<div>" * 200_000 + "x", '<a <a "' * 100_000, "<script>" * 100_000, "<p>x</q>" * 100_000, "</" * 200_000 + ">", "<!--" * 200_000, "<a '" * 100_001 + ">", "<" * 300_000, "&" * 300_000):
        blocks(odd)
    one = "<p>A sentence of some words, with a mark.</p>"
    text = main_text.main_text([f"<article>{one * 30_000}</article>" + "<div class=ad>x</div>" * 30_000], main_text.PRIOR)[0]
    assert text.count("\n") == 29_999


def test_extract_edges(spark):
    rows = [(1, "u", around("<article><p>Only this is the text.</article>"), "t", 0), (1, "u", around("<article><p>Only this is the text.</article>"), "t", 0), (2, None, None, "", 1), (None, "v", "", None, None), (4, "w", "<nav>a</nav>", "", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _html string, `y` int")
    w = main_text.train(pages)
    out = main_text.extract(pages, [F.col("page_id"), F.col("_html"), F.col("y")], w)
    assert out.columns == ["page_id", "_html", "y", "text", "n_chars"]
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in out.collect()))
    assert got == [(0, "", 0), (1, "Only this is the text.", 22), (1, "Only this is the text.", 22), (2, "", 0), (4, "", 0)]
    empty = pages.limit(0)
    assert main_text.extract(empty, [F.col("page_id")], main_text.train(empty)).count() == 0


def test_query_holds_the_articles_of_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in op13_html_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inside = p.html[p.html.index("<article>") + 9 : p.html.index("</article>")]
        assert got[p.page_id].text == "\n".join(b.text for b in blocks(inside)) and got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url
