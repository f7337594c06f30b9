"""Elements without text of their own whose end tags are left out drop nothing behind them."""

import pytest

from glyphmill.llm import html_extract


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<html><head><title>t</title><meta charset=x><body><p>one<p>two</body></html>", ["one", "two"]),
        ("<head><style>p{}</style><script>var a = '<p>';</script><p>one", ["one"]),
        ("<head><title>t</title>\n one<p>two", ["one", "two"]),
        ("<head><title>t</title></head><p>one", ["one"]),
        ("<head><!-- <p>no</p> --><link href=x><div>one</div>", ["one"]),
        ("<datalist><option value=a><option value=b></datalist><article><p>one</p></article>", ["one"]),
        ("<datalist><option>a <b>b</b><option>c</datalist>one", ["one"]),
        ("<datalist><option>a</option><option>b</option></datalist>one", ["one"]),
        ("<p>one<canvas><p>two", ["one", "two"]),
        ("<p>one<script>var a = '<p>two';", ["one"]),
    ],
)
def test_unclosed(html, want):
    assert [b.text for b in html_extract.blocks(html)] == want
