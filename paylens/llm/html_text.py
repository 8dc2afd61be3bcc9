"""Main text of web pages by two-pass block rules (operator 11).

*Blocks.*  One forward scan cuts a page at its block-level tags.  A block has its
text, the share of its characters inside links, the share of stop words among its
words, and what markup says about it: whether it stands in an element that is
never article text (:data:`BOILERPLATE_TAGS`, or a class, id or role of
:data:`BOILERPLATE_NAMES`) and whether it stands in an ``article`` or ``main``.

*First pass*, each block alone: boilerplate markup, a link density above
``MAX_LINKS`` or a copyright sign make it bad; ``MIN_GOOD`` characters with a stop
word density of ``STOP_HIGH`` make it good; long blocks with few stop words are bad
outside an article; everything else is ambiguous.  On a page with an article,
blocks outside it are bad.

*Second pass*: an ambiguous block takes the label of its nearest decided neighbour,
counted in blocks and passing over those that markup bars; at equal distance a bad
one wins outside an article and a good one inside.  A heading looks at what follows
it.  The edges of a page are bad neighbours, the edges of an article are good ones,
so an article whose blocks are all short or hold no known stop word is kept whole.

Results.  ``text`` joins the good blocks in page order by one newline; character
references are decoded, white space (Unicode's) inside a block becomes one space.
NULL and empty pages and pages without article text give an empty text.  Rows are
independent of each other: repeated rows, rows with NULL ``page_id`` or ``url`` and
rows in any order give each their own result, an empty table gives none, and extra
columns are not read.  Pages of any length are scanned once, in time linear in the
page; an unclosed comment, script or tag ends the page, as in a browser.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LINKS = 0.33
MIN_GOOD = 70          # characters of a block that can be good by itself
MIN_GOOD_SPARSE = 200  # the same with a stop word density between STOP_LOW and STOP_HIGH
STOP_LOW, STOP_HIGH = 0.20, 0.30

# Frequent function words of English, French, Spanish and German.
STOP_WORDS = frozenset("""
the of and to in a is that for it was on with as be at by this from are or an not have but which they you were his her
de la le et les des en un une du que est pour qui dans a par plus pas au sur ne se ce il sont avec
el los las y del que por con no para una su al lo como es o este se ha son
der die und das ist von den mit zu sich des auf für nicht ein eine dem im als auch es an werden aus er sie
""".split())

# Elements that are never article text, and names of such parts in class, id and role.
BOILERPLATE_TAGS = frozenset("nav footer aside form dialog menu button select label fieldset datalist".split())
BOILERPLATE_NAMES = frozenset("""
nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc
footer foot copyright legal colophon contentinfo
sidebar aside widget widgets complementary rail
ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense
cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog toast paywall
comment comments commentlist respond reply replies disqus discussion reviews
related recommended recommendations trending share sharing social newsletter subscribe subscription signup login search
form hidden
""".split())
HEADER_NAMES = frozenset("header masthead topbar toolbar skip skiplink".split())  # a site's; an article's header is text
LOOK_OF_PAGE = frozenset("has with no without is not show hide single page".split())  # 'has-sidebar' is no sidebar

_BLOCK = frozenset("""
address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option optgroup p pre search section select summary table
tbody td tfoot th thead tr ul
""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset("script style title textarea noscript iframe noembed noframes template xmp svg math object canvas".split())
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _SKIPPED}
_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
_NAMES = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*+:\s*+none|aria-hidden\s*+=\s*+["']?true""", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass(slots=True)
class Block:
    text: str
    links: float     # share of characters inside links
    stops: float     # share of stop words among words
    barred: bool     # stands in boilerplate markup
    article: int     # number of the article it stands in, 0: none
    heading: bool
    label: str = ""


def _named(attrs: str, names: frozenset[str]) -> bool:
    """Whether a class, id or role of a tag names one of ``names``, alone or as first or last part."""
    for _, a, b, c in _NAMES.findall(attrs):
        for name in (a or b or c).lower().split():
            parts = [p for p in re.split(r"[^a-z0-9]+", name) if p]
            if parts and parts[0] not in LOOK_OF_PAGE and (parts[0] in names or parts[-1] in names):
                return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page that hold text, in page order."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, int]] = []  # tag, bars its content, article outside of it
    opened: Counter[str] = Counter()
    barred, article, articles, link, heading, breaks = 0, 0, 0, False, False, 0

    def flush() -> None:
        nonlocal breaks
        if parts:
            words = "".join([_html.unescape(t) for t, _ in parts]).split()
            if words:
                text = " ".join(words)
                linked = sum(len(" ".join(_html.unescape(t).split())) for t, in_link in parts if in_link)
                stops = sum(map(STOP_WORDS.__contains__, text.lower().split())) / len(words)
                out.append(Block(text, min(1.0, linked / len(text)), stops, barred > 0, article, heading))
            parts.clear()
        breaks = 0

    def close(tag: str) -> None:
        nonlocal barred, article
        while True:
            name, bars, outer = stack.pop()
            opened[name] -= 1
            barred -= bars
            article = outer
            if name == tag:
                return

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            piece = page[at:lt]
            parts.append((piece, link))
            if not piece.isspace():
                breaks = 0
        if lt == n:
            break
        nxt = page[lt + 1:lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if nxt in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if not (nxt.isascii() and nxt.isalpha()) and not (nxt == "/" and page[lt + 2:lt + 3].isascii() and page[lt + 2:lt + 3].isalpha()):
            parts.append(("&lt;", link))  # a plain '<'
            at = lt + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            break  # a tag without end
        at, tag, attrs = m.end(), m[1].lower(), m[2]
        if nxt == "/":
            if tag in _BLOCK:
                flush()
                link = False
                heading = heading and tag not in HEADINGS
            elif tag == "a":
                link = False
            if opened[tag]:
                close(tag)
            continue
        if tag in _SKIPPED:
            if not attrs.rstrip().endswith("/") or tag not in ("svg", "math"):
                end = _ENDS[tag].search(page, at)
                at = n if end is None else end.start()
            continue
        if tag == "br":
            parts.append((" ", link))
            breaks += 1
            if breaks == 2:  # an empty line ends a block
                flush()
            continue
        if tag in _BLOCK:
            flush()
            if opened["p"] and tag != "button":
                close("p")
            heading = tag in HEADINGS
        if tag == "a":
            link = True
        if tag in _VOID:
            continue
        if tag in ("html", "body", "head"):
            stack.append((tag, False, article))
        else:
            own = tag in ("article", "main")
            if own and article == 0 and not (barred or _named(attrs, BOILERPLATE_NAMES)):
                articles += 1
                stack.append((tag, False, article))
                article = articles
            else:
                bars = tag in BOILERPLATE_TAGS or bool(attrs) and (
                    _named(attrs, BOILERPLATE_NAMES) or _HIDDEN.search(attrs) is not None)
                if not bars and not article:
                    bars = tag == "header" or bool(attrs) and _named(attrs, HEADER_NAMES)
                stack.append((tag, bars, article))
                barred += bars
        opened[tag] += 1
    flush()
    return out


def first_pass(found: list[Block]) -> None:
    """Label the blocks that can be decided alone 'good' or 'bad'; the others stay ''."""
    in_article = any(b.article and not b.barred for b in found)
    for b in found:
        n = len(b.text)
        if b.barred or b.links > MAX_LINKS or (in_article and not b.article) or (b.text.startswith("©") and n < MIN_GOOD_SPARSE):
            b.label = "bad"
        elif n >= MIN_GOOD and b.stops >= STOP_HIGH or n >= MIN_GOOD_SPARSE and b.stops >= STOP_LOW:
            b.label = "good"
        elif n >= MIN_GOOD and b.stops < STOP_LOW and not b.article:
            b.label = "bad"


def second_pass(found: list[Block]) -> None:
    """Give ambiguous blocks the label of their nearest decided neighbour.

    Blocks that markup bars say nothing about the text around them and are passed over.
    """
    found = [b for b in found if not b.barred]
    n = len(found)
    before, after = [(0, "")] * n, [(0, "")] * n

    def walk(order: range, seen: list[tuple[int, str]], step: int) -> None:
        label, far = "bad", 1  # beyond the page
        for i in order:
            b = found[i]
            j = i - step
            edge = not 0 <= j < n or found[j].article != b.article
            if b.article and edge:
                label, far = "good", 1
            seen[i] = (far, label)
            label, far = (b.label, 1) if b.label else (label, far + 1)

    walk(range(n), before, 1)
    walk(range(n - 1, -1, -1), after, -1)
    for i, b in enumerate(found):
        if not b.label:
            (d1, x), (d2, y) = before[i], after[i]
            if b.heading:
                b.label = y
            elif d1 == d2:
                b.label = x if x == y else ("good" if b.article else "bad")
            else:
                b.label = x if d1 < d2 else y


def main_text(page: str | None) -> str:
    """The good blocks of a page, one per line."""
    found = blocks(page or "")
    first_pass(found)
    second_pass(found)
    return "\n".join(b.text for b in found if b.label == "good")


def main_texts(page: Column) -> Column:
    """Main text of an HTML column."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return run(page)


def extract_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the column ``out`` of main texts added."""
    return pages.withColumn(out, main_texts(F.col(html_col)))


def op11_html_text(pages: DataFrame) -> DataFrame:
    """Main text and its length in code points, per page."""
    x = extract_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text")
    return x.withColumn("n_chars", F.length("text").cast("long"))
