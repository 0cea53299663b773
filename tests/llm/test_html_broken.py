"""Attributes as browsers read them, class names, formulas, deep and broken pages, odd tables, very many hosts."""

import time

import pytest

from mosaique.llm import html

BODY = "<p>" + "Words of the body go on and on. " * 40 + "</p>"
PLAIN = " ".join(("Words of the body go on and on. " * 40).split())


def text(page):
    return html.extract(page, html.vote(page))


@pytest.mark.parametrize("tag", ["<a title='it's'>", '<a title="x"">', "<a title=it's>", '<a x="1>2">', "<a 'b>", '<a "b" c>', "<a href=/x?a=b&c='d>", "<a\ntitle = 'x'\n>", "<a title=\"a 'b\" class=x>"])
def test_quotes_in_tags(tag):
    assert text(f"<body><article><p>Before {tag}inside</a> after.</p>{BODY}</article></body>") == f"Before inside after. {PLAIN}"


@pytest.mark.parametrize("name", ["social-science", "share-holders", "ad-hoc", "newsletter-archive-text", "adriatic", "header-image-story", "commentary", "navigationless"])
def test_names_that_only_contain_a_word(name):
    assert text(f"<body><div class=content>{BODY}<div class='{name}'><p>Part of it.</p></div></div></body>") == f"{PLAIN} Part of it."


@pytest.mark.parametrize("name", ["site-header", "main-nav", "footer-top", "cookie-consent-banner", "left-sidebar", "post-comments", "ad-slot-300", "newsletter-signup-form", "globalNav", "comments-area", "related-posts", "share_buttons", "adBox", "x sidebar"])
def test_names_of_other_things(name):
    assert text(f"<body><div class=content>{BODY}<div class='{name}'><p>Not part of it.</p></div></div></body>") == PLAIN


def test_only_real_attributes_count():
    assert text(f"<body><article><div data-class=ad data-id='comments' title='class=nav'>{BODY}</div></article></body>") == PLAIN
    assert text(f"<body><article>{BODY}<div class=x class=ad>First.</div><div CLASS=AD>Second.</div></article></body>") == f"{PLAIN} First."


def test_formulas_and_drawings_keep_their_text():
    formula = "<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='x-tex'>x=2</annotation></math>"
    drawing = "<svg><title>no</title><desc>no</desc><text>Label</text></svg>"
    assert text(f"<body><article>{BODY}<p>So {formula} holds.</p><p>{drawing}</p></article></body>") == f"{PLAIN} So x=2 holds. Label"


def test_comments_and_raw_text():
    page = f"<body><article><!-->{BODY}<!-- a > b -- <p>no</p> --!><script>if (a < b) {{ '</p>' }}</SCRIPT ><textarea><p>no</p></textarea><!x><?php no ?></ >Kept<noscript>no</noscript></article></body>"
    assert text(page) == f"{PLAIN} Kept"
    assert text(f"<body><article>{BODY}1 < 2, <3 & 4 > 3 &lt;b&gt;</article></body>") == f"{PLAIN} 1 < 2, <3 & 4 > 3 <b>"


BROKEN = {
    "deep": "<div>" * 20_000 + "text" + "</div>" * 20_000, "spans": "<body>" + "<span>" * 20_000 + "<b>x</b>" * 5_000, "quotes": '<a "x ' * 50_000, "declarations": "<!" * 50_000,
    "values": '<a x="' * 50_001, "ends": "<div>" * 5_000 + "</p></b>" * 20_000, "paragraphs": "<p>" * 50_000, "cells": "<p>" + "<span>" * 10_000 + "<td>" * 10_000, "forms": "<form>" * 5_000 + "x" + "<article>" * 5_000,
}


@pytest.mark.parametrize("kind", BROKEN)
def test_broken_pages_take_no_longer_than_their_length(kind):
    begun = time.process_time()
    text(BROKEN[kind])
    assert time.process_time() - begun < 5


def test_paths_of_deep_pages_share_their_memory():
    page = html.parse(BROKEN["deep"])
    assert sum(len(e.step) for e in page.elements) < 6 * len(page.elements) and html.path_of(page, len(page.elements) - 1) == ">div" * 20_000


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, path string, host string, _host string, text string, n_chars long, lang string"
    rows = [(k, "https://a.b/x", f"<body><article>{BODY}</article></body>", "p", "h", "u", "t", 1, None) for k in (1, 1, 2)] + [(None, None, None, None, None, None, None, None, None), (3, "", "", "", "", "", "", 0, "")]
    found = html.main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.text) for r in found) == [(0, ""), (1, PLAIN), (1, PLAIN), (2, PLAIN), (3, "")]
    assert html.main_text(spark.createDataFrame([], schema)).collect() == []


def test_more_hosts_than_are_broadcast(spark, monkeypatch):
    rows = [(k, f"https://h{min(k, 9)}.org/{k}", f"<body><div class=c{chr(97 + k % 5)}>{BODY}</div><p>tail</p></body>") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {r.page_id: (r.text, r.path) for r in html.main_text(pages).collect()}
    monkeypatch.setattr(html, "BROADCAST_ROWS", 2)
    assert {r.page_id: (r.text, r.path) for r in html.main_text(pages).collect()} == whole
