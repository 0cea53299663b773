"""What readers, advertisers and the site add inside an article goes; what its author wrote stays, also in pages of plain divs."""

import pytest

from mosaique.llm import html

BODY = "<p>" + "Words of the body go on and on. " * 40 + "</p>"
PLAIN = " ".join(("Words of the body go on and on. " * 40).split())

ADDED = [
    "ol id='comments'", "ul id='comments'", "section id='respond'", "section id='comments'", "div id='disqus_thread'", "div class='user-comments'", "div class='fb-comments'", "div class='comment-text'",
    "div class='related-articles'", "div class='ad_300x250'", "div class='cookie-message'", "div class='sponsored-content-label'", "div class='reader-comments'", "p class='advertisement'", "section class='comments'",
]
OWN = ["p class='comment'", "div class='price-share'", "div class='notice-board'", "section id='related-work'", "div class='content-header'", "h2 class='section-header'", "div class='social-science'", "section id='notice'"]
OUTSIDE = "<body><div class='site-header'>Site</div><nav><a href=/>Home</a></nav>{}<div class=footer>All rights</div></body>"


def text(page):
    return html.extract(page, html.vote(page))


@pytest.mark.parametrize("outer", ["article", "main", "div class=post", "div class=content"])
@pytest.mark.parametrize("tag", ADDED)
def test_added_parts_go(outer, tag):
    page = OUTSIDE.format(f"<{outer}>{BODY}<{tag}>Not of it.</{tag.split()[0]}>{BODY}</{outer.split()[0]}>")
    assert text(page) == f"{PLAIN} {PLAIN}"


@pytest.mark.parametrize("outer", ["article", "main", "div class=post", "div class=content"])
@pytest.mark.parametrize("tag", OWN)
def test_own_parts_stay(outer, tag):
    page = OUTSIDE.format(f"<{outer}>{BODY}<{tag}>Part of it.</{tag.split()[0]}>{BODY}</{outer.split()[0]}>")
    assert text(page) == f"{PLAIN} Part of it. {PLAIN}"


@pytest.mark.parametrize("outer", ["article", "div class=post"])
@pytest.mark.parametrize("header", ["header", "header class='entry-header'", "header class='header'", "div class='header'", "div class='post-header'"])
@pytest.mark.parametrize("inner", ["{}", "<div class='entry-content'>{}</div>"])
def test_headlines_stay(outer, header, inner):
    page = OUTSIDE.format(f"<{outer}><{header}><h1>Headline</h1></{header.split()[0]}>{inner.format(BODY)}</{outer.split()[0]}>")
    assert text(page) == f"Headline {PLAIN}"


@pytest.mark.parametrize("header", ["header", "div class='header'", "header class='site-header'", "div id='top-header'"])
@pytest.mark.parametrize("head", ["Site name", "<h1>Site name</h1><nav><a href=/a>Menu</a></nav>", "<h1><a href=/>Site name</a></h1>", "<h1>Site name</h1>"])
def test_headers_of_the_site_go(header, head):
    page = f"<body><div id=wrapper><{header}>{head}</{header.split()[0]}><div class=post><h1>Headline</h1>{BODY}</div></div></body>"
    assert text(page) == f"Headline {PLAIN}"


def test_a_header_alone_in_the_body_goes():
    assert text(f"<body><header><h1>Site name</h1></header><div class=post>{BODY}</div></body>") == PLAIN


def test_every_container_of_a_host_is_read_by_the_rules_of_articles(spark):
    page = OUTSIDE.format(f"<div class=post><header><h1>Headline</h1></header>{BODY}<div class='price-share'>A share of the price.</div><div class='user-comments'><p>{'First! ' * 20}</p></div></div>")
    loud = page.replace("First! " * 20, "First! " * 2_000)
    rows = [(k, "https://a.example.com/x", loud if k == 4 else page) for k in range(6)]
    found = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in found} == {f"Headline {PLAIN} A share of the price."} and len(found) == 6
