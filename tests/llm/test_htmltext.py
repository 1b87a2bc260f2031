import random
import time

import numpy as np
import pytest

from seqloom.llm import htmltext
from tests.llm.hand_pages import HAND_WRITTEN


@pytest.fixture(scope="module")
def net():
    return htmltext.trained()


def test_blocks_of_bad_markup():
    page = "<html><head><title>x</title></head><body><!-- <p>no --><div class='Ad'>a  \n b<p>one<p>two <b>bold<br>more</b></div>&lt;tag&gt; &amp;amp; &eacute;<script>if (a<b) '</p>'</script> end<p title='>'>q</p><p>cut <i"
    assert [(b[1], htmltext.path(b[0])[-1] if b[0] else "") for b in htmltext.blocks(page)] == [
        ("a b", "div.ad"), ("one", "p"), ("two bold", "p"), ("more", "p"), ("<tag> &amp; é", "body"), ("end", "body"), ("q", "p"), ("cut", "p"),
    ]
    assert htmltext.blocks("") == [] and htmltext.blocks("plain  text") == [(None, "plain text", 0)] and htmltext.blocks("<") == [(None, "<", 0)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div it's><p>One two.</p><p>x</p>", ["One two.", "x"]),
        ("<p title=it's>a</p><p>b</p>", ["a", "b"]),
        ('<div class="a><p>One</p><p class="b">Two</p>', ["One", "Two"]),
        ("<p title='a > b' x>a</p>", ["a"]),
        ("<p>a<svg/>b<svg><title>t</title><path d=x /></svg>c</p>", ["abc"]),
        ("<svg><p>a", ["a"]),
        ("<p>a<svg><g><title>no</title></g></svg>b<math><mi>no</math>c", ["abc"]),
        ("<div>a<select><option>no</div>b", ["a", "b"]),
        ("<div>a<object>no<p>no</div>b<object><div>no</div></object>c", ["a", "bc"]),
        ("<div>a<noscript>no<p>no</noscript>b", ["a", "b"]),
        ("<div><select><option>no</div><p>a", ["a"]),
        ("<object>no<p>no</object>a<noscript>no</noscript><template><p>no</template>", ["a"]),
        ("<p>a<textarea>b<p>c", ["a", "b", "c"]),
        ("<p>a<textarea>no</textarea><iframe>no</iframe>b<script>no", ["a", "b"]),
        ("<head><title>no</title><p>a", ["a"]),
        ("<!-- no --><p>a<!-- no", ["a"]),
        ("<SCRIPT>no</script >a<style>no</style>", ["a"]),
    ],
)
def test_stray_quotes_and_what_is_not_seen(page, want):
    assert [b[1] for b in htmltext.blocks(page)] == want


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<b><div>" * 50_000 + "x", '<a x="' * 200_000, "<p x='" + "= " * 200_000, "<textarea>" * 100_000, "<select>" * 100_000, "<" * 300_000, "<!--" * 100_000, "</p>" * 100_000])
def test_hostile_pages_take_linear_time(page):
    start = time.perf_counter()
    htmltext.vectors(htmltext.blocks(page))
    assert time.perf_counter() - start < 5


def test_pages_of_other_layouts(net):
    for name, (page, want) in HAND_WRITTEN.items():
        assert htmltext.main_texts(net, [page])[0][0] == want, name


def test_labels_need_no_caches(net, monkeypatch):
    rng = random.Random(3)
    x, mask = htmltext.padded([htmltext.vectors(htmltext.blocks(htmltext.made_page(rng)[0])) for _ in range(6)])
    for steps in (htmltext.STEPS, 7):
        monkeypatch.setattr(htmltext, "STEPS", steps)
        assert np.allclose(net.probabilities(x, mask), net.forward(x, mask)[0], atol=1e-5)


def test_gradients_are_those_of_the_loss():
    rng, net = np.random.default_rng(1), htmltext.Labeller(3)
    net.par = [p.astype(np.float64) for p in net.par]
    x = rng.normal(size=(3, 5, net.par[0].shape[0]))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], float)
    y = rng.integers(0, 2, mask.shape).astype(float)

    def loss():
        p = net.forward(x, mask)[0]
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    grads = net.gradients(x, mask, y)
    for p, g in zip(net.par, grads, strict=True):
        at = tuple(rng.integers(0, s) for s in p.shape)
        held, p[at] = p[at], p[at] + 1e-5
        up = loss()
        p[at] = held - 1e-5
        down, p[at] = loss(), held
        assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_held_out_pages(net):
    rng = random.Random(77)
    right = total = 0
    for _ in range(200):
        page, labels = htmltext.made_page(rng)
        own = htmltext.blocks(page)
        assert len(own) == len(labels)
        if labels:
            right += (net.label([htmltext.vectors(own)])[0] == labels).sum()
            total += len(labels)
    assert right / total > 0.99


def test_operator_and_edge_cases(spark, net):
    article = "<article><h1>Title of it</h1><p>First  one&amp;two.</p><p>Second one with several words in it.</p></article>"
    page = f'<html><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy now.</div>{article}<section class="comments"><div class="comment"><p>I disagree with this.</p></div></section><footer>&copy; x</footer></body></html>'
    long_page = page.replace("</h1>", "</h1>" + "<p>Some words that go on here.</p>" * 5000)
    rows = [(1, "u", page, "c"), (2, None, None, "c"), (3, "u", "", "c"), (None, "u", page, "c"), (1, "u", page, "c"), (4, "u", long_page, "c"), (5, "u", "<p>cut <", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmltext.extract(df, net=net).collect()
    want = "Title of it\nFirst one&two.\nSecond one with several words in it."
    texts = {}
    for r in got:
        texts.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert texts[1] == [want, want] and texts[None] == [want] and texts[2] == texts[3] == [""] and len(got) == len(rows)
    assert texts[4][0].count("\n") == 5002
    assert htmltext.extract(df.limit(0), net=net).count() == 0


def test_labels_do_not_depend_on_other_pages(net):
    rng = random.Random(5)
    pages = [htmltext.made_page(rng)[0] for _ in range(40)]
    assert htmltext.main_texts(net, pages) == [htmltext.main_texts(net, [p])[0] for p in pages]


def test_vectors_read_all_words_and_all_of_a_path():
    lead = "word " * 40
    of = lambda page: htmltext.vectors(htmltext.blocks(page))[0]
    assert (of(f"<p>{lead}subscribe end.</p>")[: -htmltext.EXTRA] != of(f"<p>{lead}therefore end.</p>")[: -htmltext.EXTRA]).any()
    deep = "<div>" * 300 + "<p>some text"
    assert (of(f"<section class=comments>{deep}") != of(f"<section class=story>{deep}")).any()
