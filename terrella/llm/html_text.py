"""Main text of web pages by line-block distribution.

The markup of a page is stripped into lines, one for each block of text.  A line keeps its text length, how much of it
is link text, and what the markup says of its place.  Weights come from these: the length without link text; nothing in an
element that never holds the article (navigation, footer, sidebar, form, page header) or under a class or id all of whose
words name such a part (``cookie-notice``, ``post-comments``); four fifths under one that only has such a word among others
(``legal-history``); in a part marked as article (``article``, ``main``, ``role=main``) the whole length and ``MARKED``
more, and on a page with such a part OUTSIDE of its weight elsewhere.

Weights are summed over sliding windows of ``WIDTH`` lines.  A stretch begins at the surge, the first line of weight in a
window whose sum reaches ``SURGE``, and ends at the dive, where the window sums fall to zero, or where a marked part begins
or ends.  The heaviest stretch is the main text; if it is marked, so are all marked stretches, as a page may have several
articles.  A stretch is that of its container, the innermost one with the share ``INSIDE`` of the stretch's weight: lines
of the stretch outside it go, and short lines before and behind the stretch in it stay.  A part under a half-telling class
stays if its own window sums reach ``SURGE``.

Character references are decoded, white space inside a block becomes one space, ends are trimmed, and blocks are joined
by a line feed in page order.  Defined results: a null, empty or textless page gives an empty text; unclosed, misnested
and cut-off markup is read as far as it goes; pages that repeat an id each get a result; the whole html is read; a column
with the name of the result is replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from terrella.llm.common import tune, with_added

WIDTH = 3
#: Weight in a window that makes a surge.
SURGE = 80
#: What a line in a marked part weighs beyond its length, and the share of its weight that another line of such a page has.
MARKED, OUTSIDE = 100, 0.02
#: The share of weight under a class or id that tells by half.
HALF = 0.8
#: A stretch's container is the innermost one with this share of the stretch's weight.
INSIDE = 0.8

_SKIP = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "select", "textarea", "button", "head", "title"}
_RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
_AWAY = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_LOOSE = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([A-Za-z_:@][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_BAD = re.compile(r"(?:ads?|advert\w*|adsense|adbox|adslot|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|footer|foot|header|masthead|sidebar|side|widget|related|recommend\w*|share\w*|sharing|social|comments?|commentlist|disqus|repl(?:y|ies)|respond|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|paywall|toolbar|pagination|pager|skip|copyright|legal|disclaimer|form|search)\d*", re.I)
_NEUTRAL = set("article main content post posts entry story body text page site top bottom left right bar box block list wrap wrapper container area section inner outer item items row col column links link thread".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "alertdialog", "note"}
_SPACE = re.compile(r"\s+")


class _Line:
    __slots__ = ("text", "links", "away", "half", "article", "box", "weight")

    def __init__(self, text: str, links: int, away: bool, half: int, article: int, box: int):
        self.text, self.links, self.away, self.half, self.article, self.box, self.weight = text, links, away, half, article, box, 0.0


@lru_cache(4096)
def telling(label: str) -> int:
    """2 for a class or id one of whose names is made of telling words alone, 1 for one that has such a word, else 0."""
    most = 0
    for name in label.lower().split():
        parts = [x for x in re.split(r"[-_:.]+", name) if x and not x.isdigit() and x not in _NEUTRAL]
        bad = [bool(_BAD.fullmatch(x)) for x in parts]
        most = max(most, 2 if bad and all(bad) else 1 if any(bad) else 0)
    return most


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def lines_of(page: str) -> tuple[list[_Line], list[int]]:
    """The blocks of text of a page, in order, and the container around each container."""
    out: list[_Line] = []
    around = [0]
    stack: list[tuple[str, bool, bool, int, int, int]] = [("", False, False, 0, 0, 0)]  # name, skip, away, half, article, container
    parts: list[str] = []
    link = [0, 0]  # depth of links, characters in links
    boxes = articles = halves = 0

    def flush() -> None:
        nonlocal parts
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(_Line(text, link[1], *stack[-1][2:]))
        parts = []
        link[1] = 0

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            if stack[-1][0] in _BLOCK:
                flush()
            if stack[-1][0] == "a":
                link[0] -= 1
            stack.pop()

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        piece = page[at : lt if lt >= 0 else n]
        if piece and not stack[-1][1]:
            parts.append(piece)
            if link[0]:
                link[1] += len(piece.strip())
        if lt < 0:
            break
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if m is None:  # a bare sign
            if not stack[-1][1]:
                parts.append("&lt;")
            at = lt + 1
            continue
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    pop_to(depth)
                    break
                if stack[depth][0] in ("article", "main", "body") and name not in _BLOCK:
                    break
            continue
        if name in _BLOCK:
            flush()
            if name in _CLOSES_P and any(x[0] == "p" for x in stack[-12:]):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == "p":
                        pop_to(depth)
                        break
                    if stack[depth][0] in _BLOCK:
                        break
            if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                for depth in range(len(stack) - 1, max(0, len(stack) - 8), -1):
                    if stack[depth][0] == name:
                        pop_to(depth)
                        break
                    if stack[depth][0] in ("ul", "ol", "dl", "table", "tr" if name in ("td", "th") else "table", "menu", "select"):
                        break
        elif name in ("br", "wbr"):
            if name == "br" and not stack[-1][1]:
                parts.append(" ")
            continue
        if name in _VOID:
            continue
        _, skip, away, half, article, box = stack[-1]
        attrs = _attributes(m[3]) if m[3].strip() else {}
        role = attrs.get("role", "").lower()
        label = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        if name == "article" or name == "main" or role in ("main", "article"):
            if not away and not article:
                articles += 1
                article = articles
        elif name in _AWAY or role in _ROLES or name == "header" and not article:
            away = True
        elif label and name not in ("body", "html", "p", "h1"):
            tells = telling(label)
            if tells == 2 and not (article and name == "header"):
                away = True
            elif tells and not half:
                halves += 1
                half = halves
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
            away = True
        if name in _BLOCK and name not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "dt", "dd", "ul", "ol", "dl", "blockquote", "figure", "figcaption", "pre", "table", "tbody"):
            boxes += 1
            around.append(box)
            box = boxes
        stack.append((name, skip or name in _SKIP, away, half, article, box))
        if name == "a":
            link[0] += 1
        if m[3].rstrip().endswith("/") and name not in _BLOCK and name not in _RAW:
            pop_to(len(stack) - 1)
        elif name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if not stack[-1][1]:
                parts.append(page[at : end.start() if end else n])
            at = end.end() if end else n
            pop_to(len(stack) - 1)
    pop_to(1)
    flush()
    return out, around


def _weigh(lines: list[_Line]) -> None:
    marked = any(x.article and not x.away for x in lines)
    for x in lines:
        if x.away:
            continue
        x.weight = float(len(x.text)) if x.article else max(0.0, len(x.text) - x.links)
        if x.half:
            x.weight *= HALF
        elif x.article:
            x.weight += MARKED
        if marked and not x.article:
            x.weight *= OUTSIDE
    # A half-telling part stays by its own windows.
    parts: dict[int, list[_Line]] = {}
    for x in lines:
        if x.half and not x.away:
            parts.setdefault(x.half, []).append(x)
    for part in parts.values():
        if max(_windows(part)) < SURGE * (OUTSIDE if marked and not part[0].article else 1):
            for x in part:
                x.away, x.weight = True, 0.0


def _windows(lines: list[_Line]) -> list[float]:
    return [sum(x.weight for x in lines[i : i + WIDTH]) for i in range(len(lines))]


def _stretches(lines: list[_Line], least: float) -> list[tuple[float, int, int]]:
    """(weight, first, behind the last) of the runs between a surge and its dive."""
    n, sums = len(lines), _windows(lines)
    out, i = [], 0
    while i < n:
        if sums[i] < least or not lines[i].weight:
            i += 1
            continue
        j = i
        while j < n and sums[j] > 0 and lines[j].article == lines[i].article:
            j += 1
        stop = j
        while stop > i and not lines[stop - 1].weight:
            stop -= 1
        out.append((sum(x.weight for x in lines[i:stop]), i, stop))
        i = max(j, i + 1)
    return out


def _within(lines: list[_Line], around: list[int]) -> set[int]:
    """The container of some lines and all containers in it.  A container's number is above that of the one around it."""
    held = [0.0] * len(around)
    for x in lines:
        held[x.box] += x.weight
    least = INSIDE * sum(held)
    for box in range(len(around) - 1, 0, -1):
        held[around[box]] += held[box]
    top = max(box for box in range(len(around)) if held[box] >= least)
    inner = {top}
    for box in range(top + 1, len(around)):
        if around[box] in inner:
            inner.add(box)
    return inner


def extract(page: str | None) -> str:
    """The main text of a page."""
    lines, around = lines_of(page or "")
    _weigh(lines)
    found = _stretches(lines, SURGE) or _stretches(lines, 0)
    if not found:
        return ""
    top = max(found, key=lambda s: (s[0], -s[1]))
    chosen = [s for s in found if lines[s[1]].article] if lines[top[1]].article else [top]
    every = _stretches(lines, 0)
    kept: set[int] = set()
    for _, first, stop in chosen:
        inner, article = _within(lines[first:stop], around), lines[first].article
        for _, a, b in every:
            if lines[a].article == article:
                kept.update(k for k in range(a, b) if lines[k].box in inner and not lines[k].away)
    return "\n".join(lines[k].text for k in sorted(kept))


def extract_pages(pages: DataFrame, html_col: str = "html", as_col: str = "__text") -> DataFrame:
    """The columns of ``pages`` without the html, and the main text of each page."""
    tune(pages.sparkSession, 1000)
    kept = pages.select(*(pages[c] for c in pages.columns if c not in (html_col, as_col)))
    src = pages.select(*(pages[c] for c in kept.columns), pages[html_col].alias(as_col))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = [extract(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=batch.schema.names)

    return src.mapInArrow(run, with_added(kept, **{as_col: "string"}))
