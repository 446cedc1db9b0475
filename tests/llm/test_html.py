import html as H
import re

import numpy as np
import pytest

from folioscope.llm import html as X


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>a &amp; b<p>c", "a & b c"),
        ("<nav>no</nav><article>y <b>bold</b>er<aside>z</aside></article><footer>no</footer>", "y bolder"),
        ('<div class="comments"><p>x</p></div><main>y<div id="comment-3">no</div></main>', "y"),
        ("a < b &lt;c&gt; <b>q</b>", "a < b <c> q"),
        ('<body><div id=content>hi <span>there</span></div><div class="side sidebar">no', "hi there"),
        ("<script>if(a<b){}</script>ok<style>p{}</style>", "ok"),
        ("<textarea>no</textarea>yes<!-- c <p>x</p> -->", "yes"),
        ("<article><p>un&am", "un&am"),
        ("<article>x</article><form><p>no</form>", "x"),
        ("<article>x</section>y</article>z", "xy z"),
        ('<article><p hidden>no</p><p style="display: none">no</p>x</article>', "x"),
        ("<article>a\n\n b&nbsp;c&#x41;</article>", "a b cA"),
        ('<div class="cookie-notice">no</div><p>kept</p>', "kept"),
        ('<article><header>no</header><h1>t</h1><a href="a>b">link</a></article>', "t link"),
        ("<article>cut <b", "cut"),
    ],
)
def test_structure(source, text):
    assert X.main_texts([source]) == [text]


def test_boilerplate_without_markup_goes():
    pages = [f"<div>Sign up for our great letter now</div><div>Story {i} {'abcdefgh'[i % 8]} tells {i * i} new things about {i + 7}</div>" for i in range(6)]
    assert X.main_texts(pages)[2] == "Story 2 c tells 4 new things about 9"
    assert X.main_texts(pages[:2])[1].startswith("Sign up")


def brute_main(pages, least_tokens=4, least_pages=3):
    """Strings of tokens counted in a dictionary, for pages of one host."""
    found = [X.judged_blocks(p) for p in pages]
    seen = {}

    def strings(text):
        w = text.split(" ")
        n = min(len(w), least_tokens)
        return [(k, tuple(w[k : k + n])) for k in range(len(w) - n + 1)]

    for p in {tuple((b["text"], b["open"]) for b in p) for p in found}:
        for _, x in {(0, x) for text, open_ in p if open_ for _, x in strings(text)}:
            seen[x] = seen.get(x, 0) + 1
    out = []
    for p in found:
        own = []
        for b in p:
            gone = {k + j for k, x in strings(b["text"]) if b["open"] and seen[x] >= least_pages for j in range(len(x))}
            own.append(" ".join(w for k, w in enumerate(b["text"].split(" ")) if k not in gone))
        out.append(" ".join(x for x in own if x))
    return out


def made_pages(n, seed):
    """Pages without an article, or with a card beside the text, and boilerplate inside the blocks."""
    rng = np.random.default_rng(seed)
    word = lambda k: " ".join(rng.choice(list("abcdefghij"), k))
    out = []
    for i in range(n):
        story = f"Story {i} says {word(12)} on day {i * 7}"
        inline = f"{story} read more of our stories here {word(3)}"
        card = "<article class=card>Related card text</article>" if i % 3 == 0 else ""
        out.append(f"<div>Sign up for our great letter now dear reader {word(2)}</div><div>{'Home' if i % 2 else 'Home page'}</div><div>{inline}</div>{card}<nav>menu</nav>")
    return out + out[:2]


def test_unique_runs_against_brute_force():
    pages = made_pages(12, 1)
    got = X.main_texts(pages)
    assert got == brute_main(pages)
    assert not any("great letter now" in t or "Home" in t or "read more of our" in t for t in got) and all("Story" in t for t in got)
    assert all("Related card text" in t for i, t in enumerate(got[:12]) if i % 3 == 0)


def test_the_suffix_array_decides(spark, monkeypatch):
    rows = [(i, "http://a.example/", h) for i, h in enumerate(made_pages(9, 2))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    with_it = {r.id: r.text for r in X.extract_text(df).collect()}
    without = {r.id: r.text for r in X.extract_text(df, least_pages=1000).collect()}
    assert all(len(with_it[i]) < len(without[i]) for i in with_it)


def test_how_a_host_is_cut_changes_nothing(spark):
    hosts = {f"http://h{k}.example/x": made_pages(20 + k, k) for k in range(3)}
    rows = [(n, u, h) for n, (u, h) in enumerate((u, h) for u, own in hosts.items() for h in own)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    want = dict(enumerate(t for own in hosts.values() for t in brute_main(own)))
    for size in (1 << 20, 700, 90):
        assert {r.id: r.text for r in X.extract_text(df, group_bytes=size).collect()} == want


def test_a_text_may_have_a_class_that_names_chrome():
    assert X.main_texts(['<article><p class="share price">The share price rose</p><p class="share">no</p><div class="share box">no</div></article>']) == ["The share price rose"]


def plain(source):
    m = re.search(r"<article>(.*?)(</article>|$)", source or "", re.S)
    return re.sub(r"\s+", " ", H.unescape(re.sub(r"<[^>]*>|<[^>]*$", " ", m[1]))).strip() if m else ""


def test_pages(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in X.op7_html_extract(spark, sf).collect()}
    assert got.keys() == pages.keys()
    assert all(got[i].text == plain(h) and got[i].n_chars == len(got[i].text) for i, h in pages.items())


def test_odd_rows(spark):
    rows = [(1, None, "<p>x</p>", 1), (1, None, "<p>x</p>", 1), (None, "notaurl", None, 2), (2, "http://a.example/", "", 3)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, part int")
    assert sorted((tuple(r) for r in X.extract_text(df).collect()), key=str) == sorted([(1, None, "x"), (1, None, "x"), (None, "notaurl", ""), (2, "http://a.example/", "")], key=str)
    assert X.extract_text(df.where("false")).count() == 0
    assert X.extract_text(df, group_bytes=4).count() == 4
