"""The block labeller against a plain version; long, deep and odd pages."""

import math
import time

import numpy as np
import pytest

from glyphmill.llm import html_extract
from glyphmill.llm.html_extract import CELLS, NUMBERS, PATH_DIM, WORD_DIM


def plain_logits(m, x):
    """A bidirectional LSTM one number at a time."""
    p, n, size = m.p, len(x), x.shape[1]
    sig = lambda v: 1 / (1 + math.exp(-v))
    both = []
    for d in "fb":
        w, z = p["w" + d], p["z" + d]
        h, c, out = [0.0] * CELLS, [0.0] * CELLS, {}
        for t in range(n) if d == "f" else reversed(range(n)):
            own = [*x[t].tolist(), *h]
            g = [sum(own[i] * w[i, j] for i in range(size + CELLS)) + z[j] for j in range(4 * CELLS)]
            c = [sig(g[CELLS + k]) * c[k] + sig(g[k]) * math.tanh(g[2 * CELLS + k]) for k in range(CELLS)]
            h = [sig(g[3 * CELLS + k]) * math.tanh(c[k]) for k in range(CELLS)]
            out[t] = h
        both.append(out)
    return [sum(v * q for v, q in zip([*both[0][t], *both[1][t], *x[t].tolist()], p["v"].tolist(), strict=True)) + p["c"][0] for t in range(n)]


def page_of(rng, n):
    return ([sorted(rng.integers(0, html_extract.PATHS, 3).tolist()) for _ in range(n)], [rng.integers(0, html_extract.WORDS, rng.integers(1, 5)).tolist() for _ in range(n)], rng.normal(size=(n, NUMBERS)))


def test_forward_pass_equals_a_plain_version():
    rng = np.random.default_rng(3)
    m = html_extract.Labeller()
    for n in (1, 2, 9):
        page = page_of(rng, n)
        x, _ = m.vectors(*page)
        want = plain_logits(m, x)
        assert x.shape[1] == PATH_DIM + WORD_DIM + NUMBERS
        assert np.allclose(m.run(x, np.array([n]))[0], want)
        for part in (1, 2, 4, 20):
            assert np.allclose(m.long(page, part), want)


def test_long_pages_are_labelled_as_short_ones():
    rng = np.random.default_rng(4)
    m = html_extract.Labeller()
    pages = [page_of(rng, n) for n in (3, 0, 40, 7)]
    for a, b in zip(m.label(pages), m.label(pages, most=5), strict=True):
        assert np.array_equal(a, b)


@pytest.mark.parametrize("html", ["<div>x" * 20_000, "<b>x" * 20_000, "<b>" * 10_000 + "<div>x</div>" * 10_000, "<div>" * 10_000 + "</p>x" * 10_000, "<select>x" * 20_000, "<p><i>x" * 20_000])
def test_deep_pages_take_time_in_proportion(html):
    start = time.process_time()
    own = html_extract.blocks(html)
    read = html_extract.Reader().read(own)
    labels = [html_extract.plain_label(b) for b in own]
    assert len(own) == len(read[0]) == len(labels) and sum(b.text.count("x") for b in own) == html.count("x")
    assert time.process_time() - start < 6


@pytest.mark.parametrize("tag", ["math", "svg", "noscript", "object", "audio", "video", "canvas", "template", "iframe"])
def test_stand_ins_keep_their_text(tag):
    own = html_extract.blocks(f"<article><p>before <{tag}>within</{tag}> after</p></article>")
    assert [b.text for b in own] == ["before within after"]
    assert own[0].path.main


def test_labels_of_paths():
    html = "<header><p>a</p></header><article><header><h1>b</h1></header><p>c</p><div class='share-bar'><p>d</p></div></article><div><p>e</p></div>"
    assert [html_extract.plain_label(b) for b in html_extract.blocks(html)] == [0, 1, 1, 0, None]
