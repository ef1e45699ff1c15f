"""Page blocks, the block labeller and the extraction against plain computations and held-out pages."""

import random
import re
import time
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from farelake.llm import block_lstm, html_text, page_grammar
from farelake.llm.html_blocks import blocks_of
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.01/pages.parquet"


def texts(html):
    return [b.text for b in blocks_of(html)]


def test_blocks():
    assert texts("<p>a <b>b</b>c<p>d<br>e&nbsp; f</p>g") == ["a bc", "d e f", "g"]
    assert texts("<!doctype html><script>var t='</p>';</script><style>p{}</style><title>t</title>x<!-- <p>no</p> -->y") == ["xy"]
    assert texts("a &lt;b&gt; &amp &am &#233;&eacute; 1 < 2 <3") == ["a <b> & &am éé 1 < 2 <3"]
    assert texts("<div title='a>b' class=x>in</div><!-- open <p>rest") == ["in"]
    assert texts("one<a href='x") == ["one"]
    assert texts("</p></div>a</b><ul><li>x<li>y</ul><SCRIPT>q") == ["a", "x", "y"]
    assert texts("") == texts("<p></p> <!----> ") == []
    found = blocks_of("<div class='siteNav main-menu' id=top><a href=x>Home</a> or <a>Go</a></div><p>t</p>")
    assert found[0].path == ("div", ".site", ".nav", ".main", ".menu", ".top") and found[0].own == "div"
    assert found[0].linked == 6 and found[1].path == ("p",)
    assert blocks_of("<article><p class=ad>x<div>y</div><p>z</article>")[1].path == ("article", "div")


@pytest.mark.parametrize("html", ["<b>" * 200_000 + "x", "<p>x" * 100_000, "<a \"" * 100_000, "<div class='" * 100_000, "<!--" * 200_000,
                                  "<" * 300_000, "</" * 200_000, "&" * 300_000, "<script>" * 100_000, "<div>" * 100_000 + "</p>" * 100_000])
def test_blocks_are_linear(html):
    start = time.perf_counter()
    blocks_of(html)
    assert time.perf_counter() - start < 20


def plain_lstm(w, way, x):
    k, h, c, out = block_lstm.HIDDEN, 0.0, 0.0, []
    h, c = np.zeros(k), np.zeros(k)
    for row in x:
        z = row @ w["x" + way] + w["c" + way] + h @ w["h" + way]
        i, f, o = (1 / (1 + np.exp(-z[j * k:(j + 1) * k])) for j in range(3))
        c = f * c + i * np.tanh(z[3 * k:])
        h = o * np.tanh(c)
        out.append(h)
    return np.array(out)


def plain_scores(net, blocks):
    x = net.vectors(block_lstm.Inputs(blocks, 0, len(blocks))).astype(float)
    both = np.concatenate([plain_lstm(net.weights, "f", x), plain_lstm(net.weights, "b", x[::-1])[::-1], x], axis=1)
    return 1 / (1 + np.exp(-(both @ net.weights["out"] + net.weights["bias"][0])))


def test_labels_equal_a_plain_reading(monkeypatch):
    net = block_lstm.Labeller(3)
    pages = [b for b, _ in page_grammar.drawn_pages(["Some words here."], 12, 5)] + [[]]
    want = [plain_scores(net, p) if p else np.zeros(0) for p in pages]
    for got, w in zip(net.pages(pages), want):
        np.testing.assert_allclose(got, w, atol=1e-5)
    monkeypatch.setattr(block_lstm, "STRETCH", 7)  # states carried over
    for got, w in zip(net.pages(pages), want):
        np.testing.assert_allclose(got, w, atol=1e-5)


def test_gradients():
    net = block_lstm.Labeller(1)
    net.weights = {name: v.astype(float) for name, v in net.weights.items()}
    data = [(block_lstm.Inputs(b, 0, len(b)), y) for b, y in page_grammar.drawn_pages(["A few words."], 3, 2)]
    for i, _ in data:
        i.stats = i.stats.astype(float)
    pages, labels = zip(*data)
    _, grads = block_lstm.gradients(net, list(pages), list(labels))
    r = np.random.default_rng(0)
    for name, g in grads.items():
        at = np.unravel_index(r.choice(np.argsort(-np.abs(g).ravel())[:50], 5), g.shape)
        for place in zip(*at):
            kept, step = net.weights[name][place], 1e-5
            loss = []
            for sign in (1, -1):
                net.weights[name][place] = kept + sign * step
                loss.append(block_lstm.gradients(net, list(pages), list(labels))[0])
            net.weights[name][place] = kept
            assert abs((loss[0] - loss[1]) / (2 * step) - g[place]) < 1e-6 + 1e-3 * abs(g[place]), name


@pytest.fixture(scope="module")
def net(spark):
    return html_text.fit(spark.read.parquet(SF))


def test_held_out_layouts(net):
    pages = page_grammar.drawn_pages(page_grammar.pseudo_prose(random.Random(99), 300), 250, 4321)
    scores = np.concatenate(net.pages([b for b, _ in pages]))
    labels = np.concatenate([y for _, y in pages])
    assert ((scores >= 0.5) == (labels > 0)).mean() > 0.99


PAGE = """<html><head><title>Storm</title></head><body><div id="hd"><a href="/">The Daily</a></div>
<div class="cookie-consent"><p>We use cookies.</p><button>OK</button></div><ul class="menu"><li><a href=1>Home</a><li><a href=2>News</a></ul>
<div class="story"><h1>Big storm hits&#32;coast</h1><p>A storm hit the coast on Monday &amp; destroyed <b>many</b> houses.</p>
<div class="ad-container"><p>Buy cheap shoes now!</p></div><p>The mayor said that help was on its way.</p></div>
<div class="sidebar"><h3>Most read</h3><ul><li><a href=x>Other story</a></ul></div>
<section id="comments"><h2>2 comments</h2><div class="comment"><p>I was there and it was terrible.</p></div>
<form><textarea>x</textarea><button>Send</button></form></section><footer><p>Copyright 2020</p></footer></body></html>"""


def test_hand_made_pages(net):
    want = "Big storm hits coast A storm hit the coast on Monday & destroyed many houses. The mayor said that help was on its way."
    assert html_text.content(net, [PAGE]) == [want]
    assert html_text.content(net, ["", "<p></p>", "<nav><a href=x>Home</a></nav>"])[:2] == ["", ""]


def plain_article(html):
    inner = re.search(r"<article>(.*)</article>", html, re.S).group(1)
    return " ".join("".join(unescape(p) if k % 2 == 0 else " " for k, p in enumerate(re.split(r"(<[^>]+>)", inner))).split())


def test_whole_table(spark, net):
    pages = spark.read.parquet(SF)
    out = {r.page_id: r for r in html_text.extract(pages, net, carry=("page_id", "url")).select("row.*", "text", "n_chars").collect()}
    rows = pages.collect()
    assert len(out) == len(rows)
    same = sum(out[r.page_id].text == plain_article(r.html) for r in rows)
    assert same >= 0.98 * len(rows)
    assert all(r.n_chars == len(r.text) for r in out.values())


def test_odd_pages(spark, net):
    long = "<main><p>" + "</p><p>".join(prose(k, 20) for k in range(9000)) + "</p></main>"
    rows = [(1, None, None, 0, "r"), (2, "u", "", 0, "r"), (3, "u", long, 0, "r"), (None, "u", PAGE, 0, "r"), (4, "u", PAGE, 0, None), (4, "u", PAGE, 0, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, row string")
    out = html_text.extract(pages, net).collect()
    assert sorted((r.row.page_id or 0, r.row.n_chars) for r in out) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (4, 0)]
    by_id = {r.row.page_id: r for r in out}
    assert by_id[1].text == by_id[2].text == "" and by_id[1].n_chars == 0
    assert by_id[None].text == by_id[4].text != ""
    assert len(by_id[3].text) > 0.99 * len(re.sub("<[^>]+>", " ", long)) - 100
    empty = pages.where(F.lit(False))
    assert html_text.extract(empty, html_text.fit(empty, drawn=40)).collect() == []
