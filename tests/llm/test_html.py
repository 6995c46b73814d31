"""Main text against an independent reading of all pages, and pages on which the regions alone decide."""

import html
import re

from quillspark.llm.html_extract import HtmlParams, extract, main_text

SF = "/root/testdata/sf0.01"
LONG = "A paragraph of the main text that goes on for a good while, with clauses, commas and a full stop at the end. " * 3


def article_text(page):
    """The blocks of the article by regular expressions: adverts, scripts and comments out, tags off."""
    out = []
    for a in re.findall(r"(?s)<article[^>]*>(.*?)</article>", page):
        a = re.sub(r"(?s)<(div|section)[^>]*class=\"?(ad|comments?)\b[^>]*>.*?</\1>|<(script|style|form|nav|aside|footer)\b.*?</\3>|<!--.*?-->", "\n", a)
        for part in re.split(r"</?(?:p|h\d|li|ul|ol|div|section|article|header)\b[^>]*>", re.sub(r"<br\b[^>]*>", " ", a)):
            out.append(" ".join(html.unescape(re.sub(r"<[^>]*>", "", part)).split()))
    return "\n".join(x for x in out if x)


def test_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: (r.url, article_text(r.html), len(article_text(r.html))) for r in pages.collect()}
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in main_text(pages).collect()} == want


def test_regions_select_without_an_article():
    links = "<div>" + "".join(f"<p><a href=/{i}>Topic number {i}</a></p>" for i in range(8)) + "</div>"
    page = f"<body>{links}<div><h2>Title</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>{links}<div><p>All rights.</p></div></body>"
    want = f"Title\n{LONG.strip()}\nShort.\n{LONG.strip()}"
    assert extract(page) == want


def test_sigma_and_threshold_decide():
    page = "<body><div><p>" + LONG + "</p></div>" + "".join(f"<div><p>Short line {i}.</p></div>" for i in range(12)) + "</body>"
    lines = lambda **k: extract(page, HtmlParams(**k)).count("\n") + 1
    assert lines(sigma=0.3) == 1 < lines(threshold=2.0) < lines(sigma=1.5) < lines(sigma=2.5) <= 13 == lines(threshold=0.0)
    assert extract(page, HtmlParams(threshold=1000.0)) == ""


def test_no_region_no_text_even_in_an_article():
    page = f"<article><p>{LONG}</p></article>"
    assert extract(page) == LONG.strip() and extract(page, HtmlParams(threshold=1000.0)) == ""


def test_main_text_beside_teaser_articles():
    cards = "".join(f"<article class=card><h3><a href=/{i}>A card {i}</a></h3><p><a href=/{i}>More of it</a></p></article>" for i in range(5))
    page = f"<body><div class=page><p>{LONG}</p><p>Between.</p><p>{LONG}</p></div>{cards}</body>"
    assert extract(page) == f"{LONG.strip()}\nBetween.\n{LONG.strip()}"


def test_boilerplate_inside_an_article():
    page = (f"<article><header><h1>Head</h1></header><p>Be.</p><p>{LONG}</p><div class='ad'>Buy this now, it is good and cheap and here</div><p>So.</p>"
            f"<section id=comments><p>{LONG}</p></section><form>Your mail<input></form><aside>{LONG}</aside></article><footer>{LONG}</footer>")
    assert extract(page) == f"Head\nBe.\n{LONG.strip()}\nSo."


def test_references_white_space_and_broken_markup():
    assert extract("<article><p>A &amp B\n\t &eacute;&#8364;<p>x<b>y<br>z</article>") == "A & B é€\nxy z"
    assert extract("<p>" + "word " * 200_000) == ("word " * 200_000).strip()


def test_edge_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "y"), (2, None, "", "z"), (None, "v", "<p>text of a page", "w"), (3, "w", "no markup", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, HTML string")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in main_text(pages).collect())
    assert got == [(0, "v", "text of a page", 14), (1, "u", "", 0), (1, "u", "", 0), (2, "", "", 0), (3, "w", "no markup", 9)]
    assert main_text(pages.limit(0)).count() == 0
