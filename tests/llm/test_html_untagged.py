"""Pages whose markup says nothing of their parts, or says it in words that only look telling."""

import os
import re

import pytest
from terrella.llm.html_text import extract, telling

PAGES = "/root/testdata/sf0.01/pages.parquet"
LONG = [f"Paragraph {k} of the text has a good number of words in it, enough to count as text by itself." for k in range(5)]
BODY = "".join(f"<p>{x}</p>" for x in LONG)


def test_a_section_about_law_stays():
    page = f'<article><h1>Law</h1>{BODY}<section class="legal-history"><p>{LONG[0]}</p><p>In 1804.</p></section><div class="legal">Fine print.</div></article>'
    assert extract(page) == "\n".join(["Law", *LONG, LONG[0], "In 1804."])
    assert [telling(x) for x in ("legal-history", "cookie-notice", "post-comments", "ad-3 x", "entry", "sidebar", "")] == [1, 2, 2, 2, 0, 2, 0]


def test_a_headline_in_a_header_stays():
    page = f"<header>Site <p>Menu</p></header><article><header><h1>The headline</h1><p>By X</p></header>{BODY}<footer>Tags</footer></article>"
    assert extract(page) == "\n".join(["The headline", "By X", *LONG])


def test_all_articles_stay():
    page = f"<nav><a href=x>Home</a></nav><p>Welcome to this page.</p><article><h2>One</h2>{BODY}</article><p>Between them.</p><article><h2>Two</h2><p>Short.</p></article><footer>x</footer>"
    assert extract(page) == "\n".join(["One", *LONG, "Two", "Short."])


def test_windows_decide_without_any_mark():
    page = f'<div><div><a href=1>Home</a></div><div><a href=2>News</a></div></div><div>Buy this.</div><div><h1>Head</h1>{BODY}<p>End.</p></div><div>&copy; example</div>'
    assert extract(page) == "\n".join(["Head", *LONG, "End."])


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no test data")
def test_driver_pages_without_marks(spark):
    """The same text for most pages when every telling element becomes a div without class, id or role."""
    same = total = 0
    for row in spark.read.parquet(PAGES).select("html").collect():
        bare = re.sub(r"<(/?)(?:article|main|nav|header|footer|aside|section)\b[^>]*>", r"<\1div>", row["html"])
        bare = re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", bare)
        total += 1
        same += extract(bare) == extract(row["html"])
    print(same, total)
    assert same > 0.8 * total
