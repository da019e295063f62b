"""Short lines at the edges of the main text of pages that mark no article."""

from terrella.llm.html_text import extract

LONG = [f"Paragraph {k} has a good number of words in it, enough to count as text by itself." for k in range(6)]
BODY = "".join(f"<p>{x}</p>" for x in LONG)


def test_short_opening_lines_stay():
    assert extract(f"<body><h1>Short</h1><p>By X</p><p>Yes.</p>{BODY}</body>") == "\n".join(["Short", "By X", "Yes.", *LONG])
    page = f'<div>Site</div><div class="content"><h1>Short</h1><p>By X</p><p>A</p><p>Yes.</p>{BODY}</div>'
    assert extract(page) == "\n".join(["Short", "By X", "A", "Yes.", *LONG])


def test_short_lines_after_an_advert_stay():
    for away in ('<div class="ad">Buy this now!</div>', '<div class="notice">Mind it</div>', "<aside>See also</aside>"):
        assert extract(f'<div class="content">{BODY}{away}<p>End.</p></div>') == "\n".join([*LONG, "End."])
        assert extract(f'<div class="content"><p>Start.</p>{away}{BODY}{away}<section><p>End.</p></section></div>') == "\n".join(["Start.", *LONG, "End."])


def test_other_containers_stay_out():
    page = f'<div><p>a</p><p>b</p></div><div class="ad">x</div><div class="content">{BODY}</div><div class="ad">y</div><div><p>Small print.</p></div>'
    assert extract(page) == "\n".join(LONG)
