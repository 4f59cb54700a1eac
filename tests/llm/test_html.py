import time

import pytest

from sparkloom.llm.dom import blocks
from sparkloom.llm.html_crf import MAIN, field, labelled_pages, main_text, marginals

PAGE = """<!DOCTYPE html><html><head><meta charset=utf-8><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy &amp; save now, it is cheap.</div>
<article><h1>The  title&nbsp;here</h1><p><b>First &lt;line&gt; of
 text.<br><p>Second a<i>b</i>c.</p><p></p><p>x | y | z</p><aside class="related"><p>See also this.</p></aside><p>Last &copy line</article>
<section class="comments"><article><p>I like this article very much.</p></article></section>
<form><label>Mail</label><input><button>Go</button></form><footer>&copy; example.org &middot; All rights.</footer></body></html>"""


def test_leaf_blocks():
    assert [b.text for b in blocks("a<p>b<p>c<ul><li>d<li>e</ul>f<table><tr><td>g<td>h</table><script>if (a<b) {}</script>i<br>j")] == ["a", "b", "c", "d", "e", "f", "g", "h", "i j"]
    assert [b.text for b in blocks("<p>a<!-- x > --> b</p></div></p><b>c")] == ["a b", "c"]
    assert blocks("") == [] and [b.text for b in blocks("a < b > c <")] == ["a < b > c <"]
    assert [b.text for b in blocks("<title>x</title><textarea><p>raw</textarea><script>never closed <p>")] == ["<p>raw"]
    assert [b.text for b in blocks('<p title="a > b">c</p><p class=\'x\'>d')] == ["c", "d"]


def test_a_page():
    assert field().text(PAGE) == "The title here\nFirst <line> of text.\nSecond abc.\nx | y | z\nLast © line"


def test_marginals_against_all_labellings():
    import itertools

    import numpy as np

    r = np.random.default_rng(0)
    score, step, first = r.normal(size=(5, 2)), r.normal(size=(2, 2)), r.normal(size=2)
    p, both, total = np.zeros((5, 2)), np.zeros((2, 2)), 0.0
    best = (-1e9, None)
    for y in itertools.product((0, 1), repeat=5):
        s = first[y[0]] + sum(score[k, y[k]] for k in range(5)) + sum(step[y[k], y[k + 1]] for k in range(4))
        best = max(best, (s, y))
        w = np.exp(s)
        total += w
        for k in range(5):
            p[k, y[k]] += w
        for k in range(4):
            both[y[k], y[k + 1]] += w
    got = marginals(score, step, first)
    assert np.allclose(got[0], p / total) and np.allclose(got[1], both / total)
    from sparkloom.llm.dom import Block
    from sparkloom.llm.html_crf import Field

    own = Field({f"f{k}": score[k, 1] - score[k, 0] for k in range(5)}, step, first)
    assert tuple(own.labels([Block("", (f"f{k}",)) for k in range(5)])) == best[1] and own.labels([]) == []


def test_pages_not_learned_from():
    right = total = 0
    for page in labelled_pages(120, 99):
        truth, found = [MAIN in b.text for b in blocks(page)], blocks(page.replace(MAIN, ""))
        right += sum(bool(a) == b for a, b in zip(field().labels(found), truth, strict=True))
        total += len(truth)
    assert right / total > 0.95


def test_dataframe(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p>" * 20_000 + "x"), (1, "u", PAGE), (None, "u", "plain text")]
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(2)
    got = main_text(df).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (2, 3)} == {""} and len({r.text for r in got if r.page_id == 1}) == 1
    assert main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("part", ["/root/testdata/sf0.01/pages.parquet"])
def test_given_pages(spark, part):
    """The given pages keep their article in one element of that name."""
    import html
    import re

    for r in main_text(spark.read.parquet(part)).join(spark.read.parquet(part).select("page_id", "html"), "page_id").collect():
        inner = re.split(r"</?(?:p|h1)>", r.html.split("<article>")[1].split("</article>")[0])
        want = [" ".join(html.unescape(re.sub("<[^>]+>", "", x.replace("<br>", " "))).split()) for x in inner]
        assert r.text == "\n".join(x for x in want if x)


@pytest.mark.parametrize(
    "page",
    ["<div>x" * 170_000, "<a " * 350_000, "<span>x</b>" * 90_000, "<b><div>" + "<span></b>" * 100_000, '<a x="b" ' * 100_000 + 'd=">"', "<blockquote>x" * 80_000, "<head><body>" * 80_000, "<li>x" * 100_000, "<title>" * 150_000, "<textarea><p>" * 80_000]
    + ["".join(f'<div class="n{k} nav m{k}">x' for k in range(40_000))],
)
def test_time_grows_with_the_page_only(page):
    model = field()
    began = time.process_time()
    model.text(page)
    assert time.process_time() - began < 5


def test_references_are_decoded_in_their_own_text_node():
    assert [b.text for b in blocks("<p>&am<b>p;lt</b>; &lt;<i>&amp;</i>lt;<p>&am<!-- -->p; &#65;&nbsp;&copy")] == ["&amp;lt; <&lt;", "&amp; A ©"]


def test_elements_shown_in_place_of_others():
    text = "<p>a <math><mi>x</mi><annotation>no</annotation></math> b<p><noscript>c</noscript><video>d</video><svg><title>no</title><text>e</text></svg>"
    assert [b.text for b in blocks(text)] == ["a x b", "cde"]
    assert [b.text for b in blocks("<title>never closed <p>a<textarea>b <p>c<noscript>d<script>e <p>")] == ["a", "b", "cd"]


def test_quotes_in_tags():
    assert [b.text for b in blocks("<p title=it's>a</p><p title=\"x>y\" alt='>'>b</p><p title=\"open>c</p>")] == ["a", "b", "c"]


def test_known_features_only():
    page = '<div class="one two"><p class="two three">x<div class="one">y'
    assert [set(b.features) - set(a.features) for b, a in zip(blocks(page), blocks(page, {"name:two", "in:p"}), strict=True)] == [{"in:div", "name:one", "name:three"}, {"in:div", "name:one"}]
