"""Main text: the scan against brute force, class names that mention other parts, held-out labelled pages, broken and very long pages."""

from __future__ import annotations

import random
import time

import pytest

from vatloom.llm import html_text
from vatloom.llm.html_pages import labelled_pages

ARTICLE = "<h1>The title of it</h1><p>Some first paragraph with a dozen words or so, as they are written.</p><p>Short.</p><ul><li>One point</li><li><a href='/x'>A linked point</a></li></ul><p>And another paragraph that follows on the first one and ends here.</p>"
TEXT = "The title of it\nSome first paragraph with a dozen words or so, as they are written.\nShort.\nOne point\nA linked point\nAnd another paragraph that follows on the first one and ends here."


def around(inner: str) -> str:
    return f'<html><head><title>T</title></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News here</a></li></ul></nav>{inner}<div class="sidebar"><p>Most read in town today.</p></div><div id="comments"><h3>2 comments</h3><div class="comment"><p>I liked this and wanted to say so here.</p></div></div><footer>Copyright by somebody 2020</footer></body></html>'


@pytest.mark.parametrize("seed", range(30))
def test_best_region_is_best(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-2.0, -1.0, -0.25, 0.5, 1.0, 3.0]) for _ in range(rng.randint(0, 40))]
    first, end = html_text.best_region(scores)
    sums = [sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
    assert sum(scores[first:end]) == max([0.0, *sums])


@pytest.mark.parametrize(
    "name",
    "content has-sidebar;post-body layout-sidebar;story tags-open;entry-content legal;content share-enabled;blog-post author-page;header-fixed content;newsletter-article;search-result-content;x1;content;post comments-visible".split(";"),
)
def test_no_single_word_decides(name):
    assert html_text.main_text(around(f'<div class="{name}">{ARTICLE}</div>')) == TEXT


@pytest.mark.parametrize("inner", [f"<article>{ARTICLE}</article>", f"<main><div>{ARTICLE}</div></main>", ARTICLE, f"<div><div>{ARTICLE}</div></div>"])
def test_marked_and_unmarked(inner):
    assert html_text.main_text(around(inner)) == TEXT


@pytest.mark.parametrize("name", ["ad", "advert-box", "share-bar", "related-posts", "newsletter-box", "cookie-notice"])
def test_parts_inside_an_article_are_left_out(name):
    cut = ARTICLE.index("<ul>")
    assert html_text.main_text(around(f'<article>{ARTICLE[:cut]}<div class="{name}"><p>Ten more things that you can buy.</p></div>{ARTICLE[cut:]}</article>')) == TEXT


def test_held_out_pages():
    """Pages of another seed: nearly all words of the content, and few others."""
    lost = extra = words = exact = 0
    pages = labelled_pages(200, seed=77)
    for page in pages:
        read = html_text.Page(page)
        want = [w for _, tag, text, _, inside in read.seq if not tag and inside for w in text.split()]
        got = html_text.main_text(page).split()
        left = list(got)
        for w in want:
            if w in left:
                left.remove(w)
            else:
                lost += 1
        extra += len(left)
        words += len(want)
        exact += not left and len(got) == len(want)
    assert lost < 0.05 * words and extra < 0.03 * words and exact > 0.7 * len(pages)


@pytest.mark.parametrize("piece", ["<b>x", "<a ", '<a href="x', "<ul><li>x", "<p>x<div>", "</b>", "<a href='", "<svg>", "<", "<!-", "<![CDATA[x", "<td>x", "<a b='\">x", "&amp;", "<div class='ad'>x", "<table><tr><td>x"])
def test_long_broken_pages(piece):
    """A megabyte of one broken piece is read in time that follows its length."""
    begin = time.process_time()
    html_text.main_text("<p>Hello, these are some words.</p>" + piece * (1_000_000 // len(piece)))
    assert time.process_time() - begin < 20


def test_long_page_is_whole():
    body = "".join(f"<p>Paragraph number {i} with some words in it.</p>" for i in range(20_000))
    assert html_text.main_text(around(f"<article>{body}</article>")).count("\n") == 19_999
