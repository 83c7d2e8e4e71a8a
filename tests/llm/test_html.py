import html as entities
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tests.llm.conftest import TABLES
from trendloom.llm.html import extract_pages, main_text, smoothed

LONG = "Plain words of an article that goes on for a while, and says a thing or two. " * 3


def plain(page: str) -> str:
    """Article of the sample tables' pages, by patterns."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    return " ".join(entities.unescape(re.sub(r"<[^<>]*>", " ", re.sub(r"</?b>", "", inner))).split())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sample_pages(spark, sf):
    pages = spark.read.parquet(f"{TABLES.replace('sf0.001', sf)}/pages.parquet")
    rows = {r.page_id: r for r in pages.collect()}
    found = extract_pages(pages).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.url, r.text, r.n_chars) == (rows[r.page_id].url, plain(rows[r.page_id].html), len(r.text)), r.page_id


PARTS = [
    '<nav><ul><li><a href="/">Home</a></li></ul></nav>', "<header><h2>Site name</h2></header>", "<footer>&copy; me</footer>",
    "<aside><p>Aside text here</p></aside>", '<div class="cookie-notice">We use cookies.</div>', '<div id="sidebarLeft">Side</div>',
    '<div class="ad">Buy now, it is cheap.</div>', "<form><label>Name</label><input><button>Go</button></form>",
    "<script>var x = '<p>no</p>';</script>", "<style>p{x:y}</style>", '<section class="comments"><p>First! Great read.</p></section>',
    '<div role="navigation">Up</div>', "<!-- hidden -->", '<ul><li><a href="a">One</a></li><li><a href="b">Two</a></li><li><a>Three</a></li></ul>']


@pytest.mark.parametrize("part", PARTS)
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', "{}"])
def test_parts_that_are_no_article(part, frame):
    article = f"<h1>Title</h1>\n<p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
    expected = " ".join(f"Title {LONG} Short. {LONG}".split())
    assert main_text(f"<html><body>{part}{frame.format(article)}{part}</body></html>") == expected
    inside = f"<h1>Title</h1>\n<p>{LONG}</p>{part}<p>Short.</p><p>{LONG}</p>"
    if "header" not in part:  # an article's own header is part of it
        assert main_text(f"<html><body>{frame.format(inside)}</body></html>") == expected


@pytest.mark.parametrize("page, parts", [
    ('<div class="content"><section>{}</section><section>{}</section></div>', (8, 2)),
    ('<div class="content"><section>{}</section><section>{}</section></div>', (2, 8)),
    ('<div class="intro">{}</div><div class="body">{}</div>', (1, 6)), ('<div>{}<div>{}</div>{}</div>', (1, 10, 1)),
    ('<div><div><section>{}</section></div></div><div>{}</div>', (9, 1)), ("{}<div>{}</div>", (1, 5))])
def test_articles_in_several_containers(page, parts):
    texts = [[f"Part {i}, paragraph {k}. {LONG}" for k in range(n)] for i, n in enumerate(parts)]
    expected = " ".join(" ".join(sum(texts, [])).split())
    page = page.format(*("".join(f"<p>{t}</p>" for t in part) for part in texts))
    assert main_text(page) == expected
    assert main_text(f'<html><body><nav><a>Home</a></nav>{page}<div class="ad">Buy now.</div></body></html>') == expected


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("just text", "just text"), ("<p>a</p><p>b</p>", "a b"), ("<p>wo<b>r</b>d", "word"),
    ("<p>a<br>b\n\t c&nbsp;d</p>", "a b c d"), ("<p>x &lt; y &amp; z &#233; &eacute;&copy</p>", "x < y & z é é©"),
    ("<script>only", ""), ("<article></article>", ""), ("<p>2 < 3 and 4 > 1</p>", "2 < 3 and 4 > 1"),
    ("<nav><a>Menu</a><article><p>Text after a menu without end</p></article>", "Text after a menu without end"),
    ("<article><p>one</div></section><p>two</article>tail", "one two")])
def test_odd_pages(page, text):
    assert main_text(page) == text


@given(st.text(alphabet="<>/abpidv =\"'&;#!-\n", max_size=80))
@settings(max_examples=200, deadline=None)
def test_broken_markup_does_not_fail(page):
    assert main_text(page) == " ".join(main_text(page).split())


def test_long_pages_and_tables(spark):
    pages = [(1, None, None), (None, "u", "<p>x</p>"), (3, "v", "<article>" + f"<p>{LONG}<b>" * 3000 + "</article>")]
    table = spark.createDataFrame([(*p, "clash", 0) for p in pages], "page_id bigint, url string, html string, text string, n_chars int")
    found = {r.page_id: r for r in extract_pages(table.union(table)).collect()}
    assert extract_pages(table.union(table)).count() == 6 and extract_pages(table.limit(0)).count() == 0
    assert found[1].text == "" and found[None].text == "x" and found[3].n_chars == (len(LONG.strip()) + 1) * 3000 - 1


def test_smoothing():
    assert np.allclose(smoothed(np.ones(7)), 1) and len(smoothed(np.arange(1.0))) == 1
    peak = smoothed(np.array([0, 0, 0, 9.0, 0, 0, 0]))
    assert np.argmax(peak) == 3 and peak[2] == peak[4] > peak[1]


STORY = "<p>The story goes on for a while, with many words in it, and then it ends here again.</p>"


@pytest.mark.parametrize("before, behind", [
    ("<p>Posted by Bob</p>", '<div class="x2"><a>Older post</a> <a>Newer post</a></div>'),
    ("", "<p>Call us</p><p>Terms</p><p>Imprint</p>"), ("<div><b>Menu</b></div><p>Skip to text</p>", "<table><tr><td>1</td><td>2</td></tr></table>"),
    ("<article><p>A teaser.</p></article>", "<article><p>Another teaser</p></article>")])
def test_short_lines_and_links_beside_a_story(before, behind):
    for frame in ("{}", "<div>{}</div>", "<div><h1>Head</h1>{}<p>So it was.</p></div>"):
        story = frame.format(STORY * 4)
        expected = " ".join(re.sub("<[^>]*>", " ", story).split())
        assert main_text(f"<html><body>{before}{story}{behind}</body></html>") == expected


def test_pages_without_article_elements(spark):
    """The ratios find the article of at least 98 of 100 given pages when nothing marks it."""
    pages = [r.html or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    bare = [re.sub(r"<(/?)(article|main)\b", r"<\1div", page) for page in pages]
    assert sum(main_text(a) == main_text(b) for a, b in zip(pages, bare)) >= 0.98 * len(pages)


def test_ratios_decide(monkeypatch):
    page = f"<body><p>Posted by Bob</p><div><p>{LONG}</p><p>{LONG}</p></div><p>Terms</p><p>Imprint</p><p>Call us</p></body>"
    with_ratios = main_text(page)
    monkeypatch.setattr("trendloom.llm.html.clusters", lambda ratios: ([(0, len(ratios))], 0.0))
    monkeypatch.setattr("trendloom.llm.html.WEAK", 0.0)
    assert with_ratios == " ".join(f"{LONG} {LONG}".split()) != main_text(page)


def test_a_second_cluster_of_some_size_stays():
    ads = "".join(f"<li><a>Link number {i}</a> x</li>" for i in range(9))
    page = f"<body><div><p>{LONG}</p><p>{LONG}</p></div><ul>{ads}</ul><div><p>{LONG}</p></div></body>"
    assert main_text(page) == " ".join(f"{LONG} {LONG} {LONG}".split())
