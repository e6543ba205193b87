"""Which parts of a page are its text: named parts, articles beside a main part, sliding windows inside marked parts."""

import pytest

from hostlens.llm import html_text

PARA = "Some words of the article that are long enough to be text of a page, and a few more of them."
OTHER = "Words of a reader about the article that are as many as those of the article itself, or more."


@pytest.mark.parametrize(
    "page,want",
    [
        # More comments than article; a notice longer than a short article.
        (f"<h1>T</h1><p>{PARA}</p><div id='comments' class='comments'>" + f"<p>{OTHER}</p>" * 3 + "</div>", f"T\n{PARA}"),
        ("<div class='cookie-notice'><p>We use cookies on this page.</p><p>Accept them all or leave.</p></div><div><p>Short.</p></div>", "Short."),
        # Comments and teasers that are articles themselves.
        (f"<div class='post'><h1>T</h1><p>{PARA}</p></div><article class='comment'><p>{OTHER}</p></article>", f"T\n{PARA}"),
        (f"<article><h1>T</h1><p>{PARA}</p></article><article class='comment byuser'><p>{OTHER}</p></article>", f"T\n{PARA}"),
        (f"<main><h1>T</h1><p>{PARA}</p></main><article class='teaser'><p>{OTHER}</p></article>", f"T\n{PARA}"),
        (f"<div role='main'><p>{PARA}</p></div><article><p>{OTHER}</p></article>", PARA),
        (f"<main><article><p>{PARA}</p></article><article class='comment'><p>{OTHER}</p></article></main>", PARA),
        # What a post is about is no part of a page.
        (f"<article class='post tag-social category-share'><p>{PARA}</p></article>", PARA),
        (f"<div class='post category-comments'><p>{PARA}</p></div><div class='menu'><p>{OTHER}</p></div>", PARA),
        (f"<article class='weather-notice'><p>{PARA}</p></article>", PARA),
        # Nothing but parts known by name: those with most of the text stay.
        (f"<div class='widget-content'><h1>T</h1><p>{PARA}</p></div>", f"T\n{PARA}"),
        (f"<article class='comment'><p>{PARA} {OTHER}</p></article><div class='cookie-notice'>Cookies.</div>", f"{PARA} {OTHER}"),
    ],
)
def test_named_parts(page, want):
    assert html_text.main_text(page) == want
    assert html_text.main_text(f"<html><body><nav><a href=x>Home</a></nav>{page}<footer>f</footer></body></html>") == want


def test_windows_decide_inside_marked_parts():
    """The same text comes out whether its container is an article, the main part or no marked part at all."""
    body = f"<h1>Title</h1><p>By me</p><p>{PARA}</p><div class='ad'>Buy</div><p>{OTHER}</p><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul><p>End.</p>"
    texts = {html_text.main_text(f"<body><nav><a href=x>a</a></nav><{t}>{body}</{t}></body>") for t in ("article", "main", "section", "div")}
    assert texts == {f"Title\nBy me\n{PARA}\n{OTHER}\nOne\nTwo\nEnd."}


def test_very_long_page_and_empty_table(spark):
    page = "<article>" + "".join(f"<p>{PARA} {i}</p>" for i in range(20_000)) + "</article>"
    assert html_text.main_text(page).count("\n") == 19_999
    rows = spark.createDataFrame([(1, "u", page, "clash", 3)], "page_id long, url string, html string, text string, n_chars int")
    assert html_text.extract(rows).first().n_chars == sum(len(f"{PARA} {i}") for i in range(20_000)) + 19_999
    assert html_text.extract(rows.filter("page_id < 0")).count() == 0
