"""Pages that a flat article doesn't cover: wrapped bodies, leads, headings, sections, forms around everything."""

import pytest

from mosaique.llm import html

LEAD, BODY = "A lead of some length. " * 9, "<p>" + "Words of the body go on and on. " * 60 + "</p>"
MORE = "<section class=notes><p>" + "Notes after the body. " * 5 + "</p></section>"


def squeezed(text):
    return " ".join(text.replace("<p>", " ").replace("</p>", " ").split())


WHOLE = squeezed("Title " + LEAD + BODY + "Notes after the body. " * 5)


@pytest.mark.parametrize("outer", ["article", "main", "div"])
def test_headline_lead_and_siblings_of_a_wrapped_body(spark, outer):
    page = (
        "<html><body><nav><a href=/>Home</a></nav><div class=ad>Buy</div><div class=links><a href=/a>One story</a> <a href=/b>Another story</a></div>"
        f"<{outer} class=story><h1>Title</h1><div class=lead>{LEAD}</div><div class=body>{BODY}</div>{MORE}</{outer}></body></html>"
    )
    rows = [(k, f"https://a.example.com/{k}", page) for k in range(3)]
    found = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r.text, r.path) for r in found] == [(WHOLE, f">body>{outer}.story")] * 3


def test_climbing_stops_at_links():
    page = f"<body><div class=all><div class=body>{BODY}</div><div class=list>See <a href=/a>{LEAD}</a></div></div></body>"
    assert html.extract(page, None) == squeezed(BODY)


def test_headings_headers_and_sections_stay_in_an_article():
    page = (
        f"<body><div class=top-banner>Shop now</div><article><header class='entry-header'><h1>Title</h1></header><h2 id='social-history'>Social history</h2>{BODY}"
        "<p class='notice-board'>The board met.</p><section id='related-work'><p>Earlier work.</p></section><div class='entry-header'>By someone</div>"
        "<div class='share-bar'>Share</div><div class='comments'>First!</div><ul class='related-posts'><li>More</li></ul><div id='comments'>Second!</div><div hidden>No</div></article></body>"
    )
    want = f"Title Social history {squeezed(BODY)} The board met. Earlier work. By someone"
    assert html.extract(page, html.vote(page)) == want
    assert html.extract(page.replace("article>", "main>"), ">body>main") == want


def test_a_form_around_the_page_is_no_form_of_the_page():
    search = "<form><label>Find</label><input name=q>Search here</form>"
    for inside in (f"<div class=content>{BODY}</div>", f"<article>{BODY}</article>", f"<main>{BODY}</main>"):
        page = f"<body><form id=aspnetForm><nav><a href=/>Home</a></nav>{inside}<button>Go</button></form></body>"
        assert html.extract(page, html.vote(page)) == squeezed(BODY)
        page = f"<body>{search}{inside.replace(BODY, search + BODY)}</body>"
        assert html.extract(page, html.vote(page)) == squeezed(BODY)
    short = f"<body><form id=aspnetForm><article><p>Short.</p></article></form><div class=footer>{BODY}</div><div class=x>{LEAD}</div></body>"
    assert "Short." in html.extract(short, ">body>form>article")
