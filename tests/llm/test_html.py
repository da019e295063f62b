"""Main text of pages with many kinds of surroundings."""

import html
import os
import re

import pytest
from terrella.llm.html_text import extract, extract_pages

PAGES = "/root/testdata/sf0.01/pages.parquet"


def test_surroundings_go():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>"</script></head><body>
    <header><h2>Site</h2></header><nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <main><h1>Head &amp; line</h1><p>First   <b>bold</b>
    text.</p><p>Unclosed one<p>Short.</p><div class="ad">Buy!</div><form><input><label>Mail</label></form><ul><li>one</li><li>two</li></ul></main>
    <aside>Related</aside><section id="comments"><p>Nice article, thanks for the very long comment here.</p></section><footer>&copy; x</footer></body></html>"""
    assert extract(page) == "Head & line\nFirst bold text.\nUnclosed one\nShort.\none\ntwo"


def test_without_a_marked_article():
    body = "".join(f"<p>Paragraph {k} has a good number of words in it, enough to count as text.</p>" for k in range(6))
    page = f'<div id="nav"><a href=1>A</a> <a href=2>B</a></div><div class="content">{body}<p>End.</p></div><div class="comments"><p>{"words " * 40}</p></div><div>x <a href=3>more</a></div>'
    assert extract(page) == "\n".join([f"Paragraph {k} has a good number of words in it, enough to count as text." for k in range(6)] + ["End."])


def test_odd_pages(spark):
    assert [extract(x) for x in (None, "", "<", "<p", "<!-- only", "<script>x", "   ", "<div></div>")] == ["", "", "<", "", "", "", "", ""]
    assert extract("a < b &lt; c &#233; &nbsp;d") == "a < b < c é d"
    assert extract("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert len(extract("<article><p>" + "long " * 200_000)) == 999_999
    df = spark.createDataFrame([(1, "u", "<p>x</p>", "old"), (1, "u", "<p>x</p>", "old"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert [r["__text"] for r in extract_pages(df).collect()] == ["x", "x", ""]
    assert extract_pages(df.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no test data")
def test_driver_pages(spark):
    """Every block of the one article of each page, against a plain split of its markup."""
    for page in spark.read.parquet(PAGES).collect():
        inner = re.search(r"<article>(.*?)</article>", page["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        assert extract(page["html"]) == "\n".join(b for b in blocks if b)
