from __future__ import annotations

import time

import pytest

from tidemark.llm import html_text as H

LONG = "the long text of this page goes on for quite some words"


def text(html):
    return H.main_text(H.lines(html), None)[0]


@pytest.mark.parametrize("name", ["content has-sidebar", "no-comments", "share-enabled", "content-sidebar", "sidebar", "post social"])
def test_elements_around_the_article_stay(name):
    assert text(f"<div class='{name}'><p>before</p><div class=ad>Buy</div><article><p>{LONG}</p></article></div><div class='site-footer'>Foot</div>") == LONG


def test_other_names_still_go():
    for name in ("site-footer", "sidebar-left", "cookie-notice", "main-nav", "ad", "comment-list", "share buttons"):
        assert text(f"<p>{LONG}</p><div class='{name}'>{LONG * 3}</div><p>end</p>") == LONG + " end", name
    assert text(f"<p>{LONG}</p><section id='comments'><article>{LONG * 2}</article></section>") == LONG
    assert text(f"<p>{LONG} <span class=ad>Buy</span>now</p>") == LONG + " now"


def test_the_region_with_most_text_is_the_text():
    cards = "<article class='card'>teaser one</article><article class='card'>teaser two</article>"
    assert text(f"<main><p>{LONG}</p></main>{cards}") == LONG
    assert text(f"<main><p>{LONG}</p>{cards}</main>") == LONG
    assert text(f"<div>{LONG}</div>{cards}") == LONG
    assert text(f"<main><p>Title</p><article>{LONG}</article></main>") == LONG
    assert text(f"<article>{LONG}</article><div class='sidebar'><article>teaser</article></div>") == LONG


@pytest.mark.parametrize("html", ["<p>text</p><a" + " " * 5000 + "title=\"x>more", "<p>text</p>" + "<a b='" * 3000 + ">", "<p>text</p><" + "a" * 20000 + '"', "<p>text</p>" + "<a " * 20000])
def test_malformed_tags_take_no_time(html):
    start = time.time()
    assert text(html).startswith("text") and time.time() - start < 2
