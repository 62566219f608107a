"""Main text of pages: planted articles come back whole, everything around them doesn't."""

import html
import re

import pyarrow.parquet as pq

from ordercash.llm import html_extraction
from ordercash.llm.html_extraction import main_text
from ordercash.llm.queries import op13_html_extraction
from tests.conftest import SMALL

LONG = "A sentence of the article, with a comma or two, and enough words to be taken for prose."
AROUND = """<header><a href=/>Site</a><p>The best site, by far, for everything, really.</p></header>
<nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, and so do our partners, to do this, that and the other.</p></div>
<aside><p>Popular, and read by all, in the side bar of this very page today.</p></aside>"""
BELOW = """<section id="comments"><article class="comment"><p>First, as always, says a reader of this long text.</p></article>
<article class="comment"><p>Second, and nothing else, says another reader of it.</p></article></section>
<form action=/s><p>Subscribe, please, to our letter, which comes each week.</p><input name=q></form>
<div class="topAd"><p>Buy this, and that, and all of it, at once, today only.</p></div>
<footer><p>&copy; A site, all rights reserved, and all lefts too.</p></footer>"""


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body>{AROUND}{body}{BELOW}</body></html>"


def test_planted_articles_come_back_whole():
    many = [f"{i}. {LONG}" for i in range(9)]
    paragraphs = "".join(f"<p>{x}</p>" for x in many)
    want = "\n\n".join(["Head", *many])
    for body in (
        f"<article><h1>Head</h1>{paragraphs}</article>",
        f"<main><h1>Head</h1><div>{paragraphs}</div></main>",
        f"<div id=content class='has-sidebar'><h1>Head</h1><div>{paragraphs}</div></div>",
        f"<div><h2>Head</h2>{''.join(f'<div>{x}</div>' for x in many)}</div>",
        f"<table><tr><td><a href=/x>x</a></td><td><h2>Head</h2>{paragraphs}</td></tr></table>",
        f"<article><header><h1>Head</h1></header><section>{paragraphs[:300]}</section>".replace(paragraphs[:300], paragraphs) + "</article>",
    ):
        assert main_text(page(body)) == want, body[:60]


def test_sections_short_paragraphs_and_lists_of_an_article_are_kept():
    body = f"<article><section><p>{LONG}</p><p>{LONG}</p></section><section><p>Yes.</p><ul><li>one</li><li>two</li></ul></section></article>"
    assert main_text(page(body)) == "\n\n".join([LONG, LONG, "Yes.", "one", "two"])
    links = "".join(f"<li><a href=/{i}>Read this too, number {i}</a></li>" for i in range(5))
    assert main_text(page(f"<article><p>{LONG}</p><ul>{links}</ul></article>")) == LONG


def test_broken_markup_references_and_white_space():
    assert main_text(f"<article><h1>A&amp;B</h1><p><b>{LONG}<br><p>x &lt;\n\t y&nbsp;&copy;<p>cut &am") == f"A&B\n\n{LONG}\n\nx < y ©\n\ncut &am"
    assert main_text(f"<article><p>{LONG}</p><p>tail</p><div cla") == f"{LONG}\n\ntail"
    assert main_text("<article><p>Short.</p></article>") == "Short."
    assert main_text("just text, no markup") == "just text, no markup"
    assert main_text("<nav><a href=/>x</a></nav>") == ""
    assert main_text(f"<article><b><p>{LONG}</b> on</p><script>no</article>") == f"{LONG} on"
    assert [main_text(x) for x in (None, "", "<p>", "</p>", "<", "<!-- x", "<script>x")][:4] == [""] * 4
    deep = "<div>" * 20_000 + f"<p>{LONG}</p>"
    assert main_text(deep) == LONG
    assert main_text(f"<article>{'<p>' + LONG + '</p>'}" * 1 + f"<p>{'long, ' * 200_000}</p></article>").endswith("long,")


def test_extraction_keeps_rows_and_columns(spark):
    pages = spark.createDataFrame(
        [(1, "u", None, "a"), (1, "u", None, "a"), (None, None, "", "b"), (2, "v", f"<p>{LONG}", None)],
        "page_id long, url string, html string, size string",
    )
    rows = html_extraction.extracted(pages).collect()
    assert sorted((r.page_id or 0, r.text, r["size"] or "") for r in rows) == [(0, "", "b"), (1, "", "a"), (1, "", "a"), (2, LONG, "")]
    assert html_extraction.extracted(pages.limit(0)).collect() == []


def _plain(page):
    """What the sample's pages hold between the tags of their article, block by block."""
    found = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", flags=re.S)
    inner = re.sub(r"<[a-z/!][^<>]*\Z", "", found.group(1)) if found else ""
    inner = re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))
    texts = (" ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", "", x)).split()) for x in inner)
    return "\n\n".join(t for t in texts if t)


def test_query_gives_the_articles_of_all_pages(spark):
    rows = {r.page_id: r for r in op13_html_extraction(spark, SMALL).collect()}
    pages = pq.read_table(f"{SMALL}/pages.parquet").to_pylist()
    assert len(rows) == len(pages)
    for p in pages:
        text = _plain(p["html"])
        assert (rows[p["page_id"]].text, rows[p["page_id"]].n_chars, rows[p["page_id"]].url) == (text, len(text), p["url"])
