"""Page text, periodic runs and spelling variants against their plain definitions."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paylens.llm import html_text as H
from paylens.llm import periodic_runs as P
from paylens.llm import spelling as S
from tests.conftest import SF001
from tests.llm import brute, cases

PROSE = "This is one of the paragraphs of the text and it has many of the words that are in the list of the language. "
NOISE = "The best of the offers for you and all of your friends is in the shop that is on the corner of the street. "


# ---------------------------------------------------------------- page text

def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    want = {r.page_id: (r.url, brute.article(r.html)) for r in pages.collect()}
    got = H.op11_html_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert {r.page_id: (r.url, r.text) for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows) and len(rows) == len(want)


@pytest.mark.parametrize("part", [
    "<nav><p>{}</p></nav>", "<header><p>{}</p></header>", "<footer>{}</footer>", "<aside><p>{}</p></aside>",
    "<div class='sidebar left'><p>{}</p></div>", "<div id=cookie-notice>{}</div>", "<div class=\"ad\">{}</div>",
    "<form><label>{}</label><input></form>", "<script>var a = '<p>{}</p>';</script>", "<style>{}</style>",
    "<section id='comments'><p>{}</p><article class=comment><p>{}</p></article></section>", "<!-- <p>{}</p> -->",
    "<div role=navigation>{}</div>", "<div style='display: none'><p>{}</p></div>", "<ul class='menu'><li><a href=x>{}</a></li></ul>",
    "<textarea>{}</textarea>", "<div class=newsletter><p>{}</p></div>", "<noscript>{}</noscript>",
])
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div class=post>{}</div>", "<main><h1>Its title</h1>{}</main>"])
def test_parts_that_are_no_article(part, wrap):
    part = part.replace("{}", NOISE)
    text = [PROSE * 2 + "Café &amp; more.", PROSE * 3]
    body = "".join(f"<p>{t}</p>" for t in text)
    want = ["Its title"] * ("h1" in wrap) + [" ".join(t.replace("&amp;", "&").split()) for t in text]
    for page in (f"<body>{part}{wrap.replace('{}', body)}</body>", f"<body>{wrap.replace('{}', body)}{part}</body>"):
        assert H.main_text(page).split("\n") == want
    if not part.startswith("<header"):  # an article's own header is its text
        inside = wrap.replace("{}", f"<p>{text[0]}</p>{part}<p>{text[1]}</p>")
        assert H.main_text(f"<body>{inside}</body>").split("\n") == want


def test_ambiguous_blocks_take_their_neighbours_label():
    links = "".join(f"<li><a href=/{i}>{NOISE}</a></li>" for i in range(4))
    page = f"<body><ul>{links}</ul><p>See more.</p><p>Short start.</p><p>{PROSE * 3}</p><p>Short.</p><p>{PROSE * 3}</p><p>By me.</p><ul>{links}</ul>"
    assert H.main_text(page).split("\n") == ["Short start.", (PROSE * 3).strip(), "Short.", (PROSE * 3).strip()]
    labels = {b.text: b.label for b in _labelled(page)}
    assert labels["Short."] == "good" and labels["See more."] == "bad"


def _labelled(page):
    found = H.blocks(page)
    H.first_pass(found)
    H.second_pass(found)
    return found


def test_articles_without_known_stop_words_stay_whole():
    page = "<nav><a href=/>Home</a></nav><article><h1>東京</h1><p>Zwq.</p><p>" + "xq zk " * 80 + "</p>| a | b</article><p>" + PROSE * 4
    assert H.main_text(page) == "東京\nZwq.\n" + ("xq zk " * 80).strip() + "\n| a | b"


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("   ", ""), ("<article>", ""), ("<article>a&nbsp; b\n\tc &lt;p&gt; &#233;&am</article>", "a b c <p> é&am"),
    ("<article>a < b <3 </article>", "a < b <3"), ("<article><p>x<b>y</b>z<br>w<br><br>v", "xyz w\nv"), ("<article>a<p>b<", "a\nb<"),
    ("<article>a<p>b<a href='", "a\nb"), ("<article>a<!-- b", "a"), ("<article>a<script>b</article>", "a"), ("no markup", ""),
    ("<ARTICLE CLASS='has-sidebar'><P>Up</P></ARTICLE>", "Up"), ("</div></p><article>x</section></article></article>", "x"),
])
def test_odd_pages(html, text):
    assert H.main_text(html) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<article>", "</article>", "<a href='x'>", "</a>", "a", " the of ",
                                 "<", ">", "&amp;", "<!--", "-->", "<script>", "</script>", "\"", "'", "<b ", "=", "<br>", "<nav>", "</nav>", "<h2>"]),
                max_size=40))
def test_any_markup_gives_text_of_the_page(parts):
    page = "".join(parts)
    text = H.main_text(page)
    assert text == "\n".join(" ".join(x.split()) for x in text.split("\n")) and len(text) <= len(page)


@pytest.mark.parametrize("piece", ["<div class=ad>", "<p>", "<script>", "<!--", "<a href=\"", "</p>", "<", "&", "<b>x", "<a =", "<a class='", "<a hidden"])
def test_page_scan_is_linear(piece):
    def took(n):
        t = time.process_time()
        H.main_text(piece * n)
        return time.process_time() - t
    took(1000)
    assert took(80_000) < 30 * max(took(8_000), 0.02)


def test_pages_table(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    long = "<article>" + "".join(f"<p>{PROSE}{i}</p>" for i in range(5000)) + "</article>"
    rows = [(1, "u", "<article>x</article>", "clash", "clash"), (1, "u", "<article>x</article>", "clash", "clash"), (None, None, None, None, None),
            (2, None, long, "", "")]
    df = spark.createDataFrame(rows, schema)
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in H.op11_html_text(df).collect()), key=repr)
    want = [(1, "u", "x", 1)] * 2 + [(None, None, "", 0)]
    assert [r for r in got if r[0] != 2] == sorted(want, key=repr)
    whole = next(r for r in got if r[0] == 2)[2].split("\n")
    assert whole == [f"{PROSE}{i}" for i in range(5000)]
    assert H.op11_html_text(df.limit(0)).count() == 0


# ------------------------------------------------------------- periodic runs

def _text(r):
    k, n = r.choice([1, 2, 3, 5, 50]), r.randrange(0, 160)
    w = [f"w{r.randrange(k)}" for _ in range(n)]
    for _ in range(r.randrange(4)):
        if n > 3:
            a, p = r.randrange(n), 1 + r.randrange(max(1, n // 3))
            for i in range(a, a + r.randrange(n - a + 1)):
                w[i] = w[a + (i - a) % p]
    return [x.encode() for x in w]


def test_runs_of_random_lots():
    r = random.Random(1)
    for _ in range(60):
        texts = [_text(r) for _ in range(r.randrange(1, 30))]
        assert P.runs_of(texts) == [brute.runs(w) for w in texts]


def test_runs_of_highly_periodic_texts():
    a, b = "a", "ab"
    while len(b) < 900:
        a, b = b, b + a
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    for w in (b, thue, "a" * 700, ("a" * 70 + "b") * 12, "ab" * 400, "".join(random.Random(3).choice("ab") for _ in range(900))):
        w = [x.encode() for x in w]
        assert P.runs_of([w]) == [brute.runs(w)]


def test_runs_of_long_texts():
    w = [f"x{i % 6001}".encode() for i in range(20_000)]
    assert P.runs_of([w]) == [[(0, 20_000, 6001)]]
    t = time.process_time()
    assert P.runs_of([[b"a"] * 200_000]) == [[(0, 200_000, 1)]]
    assert time.process_time() - t < 60


def test_long_blocks_in_pieces(monkeypatch):
    """Blocks and windows larger than the transforms allow are cut, with the same runs."""
    monkeypatch.setattr(P, "BLOCK_MAX", 8)
    r = random.Random(5)
    texts = [_text(r) for _ in range(40)]
    assert P.runs_of(texts) == [brute.runs(w) for w in texts]


@pytest.mark.parametrize("high", [2, 70_000, 3_000_000])
def test_zero_mismatches_exact(high):
    """The transforms agree with direct comparison, for word numbers that need one to three primes."""
    rng = np.random.default_rng(high)
    blocks = rng.integers(0, high, (30, 9)).astype(np.uint64)
    windows = rng.integers(0, high, (30, 40)).astype(np.uint64)
    for i in range(30):
        windows[i, i % 32:i % 32 + 9] = blocks[i]
    want = np.array([[(windows[i, j:j + 9] == blocks[i]).all() for j in range(32)] for i in range(30)])
    assert (P.zero_mismatches(blocks, windows) == want).all() and want.sum() >= 30


def test_sums_that_one_prime_divides():
    """A sum of squared differences that is a multiple of a prime is no match."""
    p = P.PRIMES[0][0]
    x = int(p ** 0.5)
    squares, rest = [], p
    while rest:  # as a sum of squares, greedily
        x = int(rest ** 0.5)
        while x * x > rest:
            x -= 1
        squares.append(x)
        rest -= x * x
    blocks = np.zeros((1, len(squares)), np.uint64)
    assert not P.zero_mismatches(blocks, np.array([squares], np.uint64)).any()


def test_runs_query(spark):
    rows = cases.awkward() + [(1000 + i, " ".join(cases.words(40 + i, i, 3 + i % 30))) for i in range(200)]
    got = P.op12_periodic_runs(cases.docs(spark, rows))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    long = {8, 9}  # brute force over 12,000 words takes too long
    have = sorted((tuple(r) for r in got.collect() if r.doc_id not in long), key=repr)
    assert have == sorted((brute.run_row(i, t) for i, t, *_ in rows if i not in long), key=repr)
    assert sum(r[1] > 0 for r in have) > 20
    assert got.where("doc_id in (8, 9)").count() == 2
    assert P.op12_periodic_runs(cases.docs(spark, rows).limit(0)).count() == 0


def test_runs_operator(spark):
    got = P.periodic_runs(cases.docs(spark, [(1, "a b " * 10), (2, None), (None, "x " * 12)])).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(1, 0, 20, 2), (None, 0, 12, 1)], key=repr)


# ------------------------------------------------------------- spelling

FIELDS = ("word", "form", "root", "n", "n_near", "form_n")


def _groups(df):
    rows = df.collect()
    out = {r.word: tuple(r[c] for c in FIELDS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_spelling_query(spark):
    r = random.Random(4)
    base = ["straße", "größer", "letter", "letters", "lettre", "better", "bettor", "ÉTÉSÉ", "étésé", "Naïve", "aaaaa", "aaaaaa", "aaaaaaa"]
    texts = [(i, " ".join(r.choice(base) + r.choice(["", "", "s", "x"]) for _ in range(60))) for i in range(80)]
    texts += [(3, texts[3][1])] * 2 + [(None, "nulls letter " * 5), (900, None), (901, ""), (902, "l'été×÷ " * 4), (903, "z" * 3000 + " " + "z" * 3000)]
    rows = texts + cases.awkward()
    got = S.op13_spelling(cases.docs(spark, rows))
    assert got.columns == list(FIELDS)
    want = brute.spelling(brute.vocabulary(rows))
    assert _groups(got) == want and sum(x[1] is not None for x in want.values()) > 10
    assert S.op13_spelling(cases.docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("list_max", [S.LIST_MAX, 5])
def test_spelling_of_dense_vocabularies(spark, list_max, monkeypatch):
    """Many near words, lists in one piece and cut into pairs of parts, small fronts and batches."""
    r = random.Random(list_max)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(5, 9))) for _ in range(350)} | {"a" * k for k in range(5, 12)}
    count = {w: r.randrange(3, 60) for w in words}
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    assert _groups(S.spelling_groups(df, list_max)) == brute.spelling(count)


def test_near_pairs_small_fronts(monkeypatch):
    monkeypatch.setattr(S, "FRONT", 64)
    r = random.Random(9)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randrange(1, 8))) for _ in range(200)})
    got = set()
    for q, n in S.near_pairs(np.zeros(len(words), np.int64), words, np.zeros(len(words), np.int64), np.ones(len(words), bool)):
        pairs = list(zip(q.tolist(), n.tolist()))
        assert not got & set(pairs) and len(pairs) == len(set(pairs))
        got |= set(pairs)
    assert got == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if brute.one_edit(a, b)}


def test_long_ways_to_the_root(spark):
    """A chain of forms, each counting twice its word."""
    chain = [("a" * k + "z" * (30 - k), 3 * 2 ** k) for k in range(25)]
    got = _groups(S.spelling_groups(spark.createDataFrame(chain, "word string, n long")))
    assert got == brute.spelling(dict(chain)) and got["z" * 30][2] == chain[-1][0]


def test_lists_split_by_size(spark):
    """A list holding every word is cut; no part pair holds more than about twice the limit."""
    words = spark.createDataFrame([(f"shared{i:04d}", 5) for i in range(1000)], "word string, n long")
    sizes = S.lists(words, 50).groupBy("key", "part").count()
    assert sizes.agg({"count": "max"}).first()[0] < 200
