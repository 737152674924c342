import itertools

import numpy as np
import pytest

from spanweave.llm import html_tree as H


def test_marginals_are_exact():
    """Sum-product against the sum over all labellings of a small tree."""
    page = H.Page("<body><div class='menu'><p>a</p>x</div><article><p>one</p></article></body>")
    forest = H.Forest.of([page])
    r = np.random.default_rng(1)
    p = H.Potentials(r.normal(size=H.N_FEATURES), r.normal(size=(2, 2, 2)))
    n, total, one = len(page.parent), 0.0, np.zeros(len(page.parent))
    for y in itertools.product((0, 1), repeat=n):
        s = sum(p.unary[forest.features[i]].sum() * y[i] for i in range(n))
        s += sum(p.pair[int(forest.leaf[i]), y[forest.parent[i]], y[i]] for i in range(n) if forest.parent[i] >= 0)
        total += np.exp(s)
        one += np.exp(s) * np.array(y)
    assert np.allclose(H.marginals(forest, p), one / total)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><p>Some site</p><a href=/>Home</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site work better for you.</p><button>Fine</button></div>
<div class="ad">Buy this wonderful thing today, and get another one for free.</div><!-- <p>hidden</p> -->
<article><h1>A title &amp; more</h1><p><b>The first   line.<br><p>Second&nbsp;paragraph with a <a href="/x">link</a> in it,\n and more words.</p><p>No.</p>
<form><label>Your mail</label><input><button>Send</button></form></article>
<aside><h3>Other news</h3><ul><li><a href="/y">Something else</a></li></ul></aside>
<section class="comments"><h3>Comments</h3><div><p>I do not agree with this article at all, it is wrong.</p></div></section><footer>&copy; someone</footer></body></html>"""
TEXT = "A title & more\n\nThe first line.\n\nSecond paragraph with a link in it, and more words.\n\nNo."


def test_main_text():
    assert H.main_texts([PAGE, None, "", "<p", "plain < text", "<a b='"], H.trained())[0] == TEXT


def test_labelled_pages_held_out():
    pages = H.labelled_pages(60, seed=77)
    parsed = [H.Page(p, labelled=True) for p in pages]
    forest = H.Forest.of(parsed)
    truth = np.maximum(np.array([v for p in parsed for v in p.y]), 0).astype(bool)
    assert ((H.marginals(forest, H.trained()) >= 0.5) == truth)[forest.leaf].mean() > 0.98


def test_extract(spark):
    long = "<article>" + "<p>some words that go on for a while here</p>" * 3000 + "</article>"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", long), (1, "u", PAGE), (None, "u", "<div><div>" * 500), (6, "u", "<" * 3000 + "a='" * 500)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "1 as _k")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text == TEXT and by[1].n_chars == len(TEXT) and by[2].text == "" and by[3].n_chars == 0
    assert by[4].text.count("\n\n") == 2999
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("html, blocks", [("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("<p>x<p>y<div>z</div>w", ["x", "y", "z", "w"]), ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]), ("a<br>b <i>c</i>", ["a b c"])])
def test_blocks(html, blocks):
    assert [t for t in H.Page(html).text if t] == blocks


def test_telling_word_behind_long_class():
    long = " ".join(f"px-{i}" for i in range(80))
    page = H.Page(f'<body><div class="{long}" id="comments"><p>x</p></div></body>')
    assert H._kind("comments") in page.kind


@pytest.mark.parametrize("tag", ["select", "svg", "object", "canvas", "video", "audio", "noscript", "template"])
def test_unclosed_elements_keep_the_page(tag):
    assert "the article" in H.Page(f"<body><{tag}><article><p>the article</p></article></body>").text


def test_formulas_and_xmp_keep_their_text():
    page = H.Page("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><xmp>some code</xmp><p>on</p><script>gone</script></article>")
    assert [t for t in page.text if t] == ["so x=2 holds", "some code", "on"]
