"""Readable extraction against pages of known body in several layouts, page metadata, and time."""

import collections
import json
import re
import time

import pytest

from vellum.functions import readable as R

SF = "/root/testdata/sf0.01"


def paragraphs(text):
    return "".join(f"<p>{x}</p>\n" for x in text.split("\n") if x.strip())


NAV = "<ul>" + "".join(f'<li><a href="/{w}">{w} section link</a></li>' for w in "home news sport travel video opinion shop about".split()) + "</ul>"
SIDE = "".join(f'<div class="teaser"><h3><a href="/t{i}">A teaser headline with a number of words {i}</a></h3><p>Short teaser.</p></div>' for i in range(8))
COMMENTS = "".join(f'<div class="comment"><p>Reader {i} says that this, well, is not quite what they had hoped for, and adds more.</p></div>' for i in range(6))
FOOT = "<p>Copyright, imprint, privacy, terms, contact, and so on and so forth for all of us.</p>"

LAYOUTS = {
    "article": lambda t: f"<header><nav>{NAV}</nav></header><article><h1>Headline</h1>{paragraphs(t)}</article><footer>{FOOT}</footer>",
    "nested": lambda t: f'<div id="page"><div class="menu">{NAV}</div><div class="wrap"><div class="entry-content">{paragraphs(t)}<div class="share-buttons"><a href="#">Share on one</a> <a href="#">Share on two</a></div></div><div class="sidebar">{SIDE}</div></div></div>',
    "table": lambda t: f'<table><tr><td>{NAV}</td><td width="70%">{paragraphs(t)}</td><td>{SIDE}</td></tr></table><div class="footer">{FOOT}</div>',
    "sections": lambda t: f"<main>{''.join(f'<section><h2>Part</h2>{paragraphs(x)}</section>' for x in halves(t))}</main><aside>{SIDE}</aside>",
    "breaks": lambda t: f"<div class='top'>{NAV}</div><div class='story'>{t.replace(chr(10), '<br><br>')}</div><div id='comments'>{COMMENTS}</div>",
    "unclosed": lambda t: f"<body><div>{NAV}</div><div class=text><h1>Headline</h1>{''.join('<p>' + x for x in t.split(chr(10)) if x.strip())}</div><div class=related><ul><li><a href=/x>Related story number one</a><li><a href=/y>Related story number two</a></ul></div>",
    "comments": lambda t: f'<div class="post"><div class="body">{paragraphs(t)}</div></div><div id="comments">{COMMENTS}</div><form><p>Leave a reply, if you must, in the box below this line of text.</p></form>',
}


def halves(text):
    lines = [x for x in text.split("\n") if x.strip()]
    return ["\n".join(lines[: len(lines) // 2 + 1]), "\n".join(lines[len(lines) // 2 + 1 :])]


def words(html):
    return collections.Counter(re.sub(r"<[^>]*>", " ", html).split())


def f1(got, want):
    both = sum((got & want).values())
    return 2 * both / max(1, sum(got.values()) + sum(want.values()))


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 600 and 20000 and text not rlike '[<>&|]'").select("text").limit(120).collect()
    return [r.text for r in rows]


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_word_agreement_with_known_bodies(texts, layout):
    scores = []
    for text in texts:
        page = f"<!DOCTYPE html><html><head><title>Headline</title><style>p{{}}</style></head><body>{LAYOUTS[layout](text)}<script>var x = '<p>script text that, frankly, is long enough to count</p>';</script></body></html>"
        scores.append(f1(words(R.readable(page) or ""), words(text)))
    assert len(scores) > 50 and sum(scores) / len(scores) >= 0.95 and sorted(scores)[len(scores) // 20] >= 0.9


def test_nothing_to_read():
    assert R.readable("") is None and R.readable("plain") is None and R.readable("<body><div>short</div></body>") is None
    assert R.readable(f"<nav>{NAV * 9}</nav><div>{NAV * 9}</div>") is None
    hidden = "<div style='display: none'><p>" + "hidden words, all of them, here " * 30 + "</p></div>"
    assert R.readable(hidden) is None and R.readable(hidden.replace("style='display: none'", "aria-hidden=true")) is None


def test_siblings_join_and_furniture_goes():
    text = "some running text, with commas, that goes on for a while. " * 5
    page = f"<body><div><div><p>{text}</p><p>{text}</p></div><div><p>{text}</p></div><div class=share><a href=x>share</a></div><p>{text}</p></div><div class=sidebar>{text}</div></body>"
    got = R.readable(page)
    assert got.count("some running text") == 20 and "share" not in got


PIECES = ["<div>", "<p>", "<b>", "<b><p>", "<ul><li>", "</div>", "<a ", "<!--", "<!-- a -->", "<title>", "<script>", "<div><p>hello, this is some text of a page</p>", "<td>", "<meta name=a content=b>", "<script type=application/ld+json>[</script>", "a, b; "]


@pytest.mark.parametrize("piece", PIECES)
def test_two_megabytes_take_linear_time(piece):
    def seconds(size):
        text = piece * (size // len(piece))
        began = time.perf_counter()
        R.readable(text)
        R.metadata(text)
        return time.perf_counter() - began

    small, large = seconds(500_000), seconds(2_000_000)
    assert large < 1 + 8 * small


def test_hostile_shapes_take_linear_time():
    run = "some text, more of it. " * 5
    for page in ("<b>" * 50_000 + f"<p>{run}" * 10_000, "<div>" + f"<p>{run}</p>" * 15_000 + "</div>", "<body>" + f"<div><p>{run}</p></div>" * 15_000, f"<div class=ad><p>{run}</p></div>" * 15_000):
        began = time.perf_counter()
        R.readable(page)
        assert time.perf_counter() - began < 15


def linked(**values):
    return f'<script type="application/ld+json">{json.dumps(values)}</script>'


def test_metadata():
    meta = '<meta property="og:title" content="A &amp; B"><meta name="description" content="plain"><meta property="og:description" content=" og "><meta name="twitter:image" content="/i.png"><meta property="article:published_time" content="2024-02-03T04:05:06Z">'
    assert R.metadata(meta) == R.Metadata("A & B", "og", "/i.png", "2024-02-03T04:05:06Z")
    ld = linked(**{"@context": "https://schema.org", "@graph": [{"@type": "WebSite", "name": "Site"}, {"@type": ["NewsArticle"], "headline": "H", "image": [{"url": "https://e.com/l.png"}], "datePublished": "2023-01-01"}]})
    assert R.metadata(meta + ld) == R.Metadata("H", "og", "https://e.com/l.png", "2023-01-01")
    assert R.metadata(linked(**{"@type": "Product", "name": "no article"})) == R.Metadata()
    assert R.metadata('<script type="application/ld+json">{broken</script>' + meta).title == "A & B"
    assert R.metadata('<script type="application/ld+json">' + "[" * 100_000 + "</script>" + meta).title == "A & B"
    assert R.metadata("") == R.Metadata() and R.metadata('<meta name="date" content="  ">').published is None
    assert R.metadata('<meta itemprop="datePublished" content="2022-02-02">').published == "2022-02-02"
    assert R.metadata(linked(**{"@type": "BlogPosting", "headline": 5, "image": {"@id": []}, "datePublished": None})) == R.Metadata()


def test_capture_takes_what_the_page_says(spark):
    from vellum.plans import capture

    body = "<p>" + "words of a page, that are many, " * 20 + "</p>"
    head = '<title>Own title</title><meta property="og:title" content="Said\x01 title"><meta name="description" content="said excerpt"><meta property="og:image" content="i.png"><meta property="article:published_time" content="2024-02-03T04:05:06Z">'
    pages = spark.createDataFrame([("https://e.com/a/b", f"<html><head>{head}</head><body><article>{body}</article></body></html>", "2020-01-01"), ("https://e.com/c", f"<title>T</title><article>{body}</article>", "2020-01-01"), ("https://e.com/d", f"<html><head>{head}</head><body>thin</body>", None)], "url string, html string, at string")
    got = {r.url[-1]: r for r in capture.capture(pages, "2024-06-01", published="at").collect()}
    assert (got["b"].title, got["b"].excerpt, got["b"].hero_url, got["b"].published_at) == ("Said title", "said excerpt", "https://e.com/a/i.png", "2024-02-03T04:05:06Z")
    assert (got["c"].title, got["c"].published_at) == ("T", "2020-01-01") and got["c"].excerpt.startswith("words of a page")
    assert (got["d"].title, got["d"].extraction_confident, got["d"].published_at) == ("Own title", False, "2024-06-01")
