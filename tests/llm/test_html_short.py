"""Pages whose article has a misleading name or hardly any words still give it; pages without one give nothing."""

from __future__ import annotations

import pytest

from vatloom.llm.html_text import main_text

MENU = '<ul class="menu"><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul>'
FOOT = '<div class="footer"><p>Copyright 2020 Us. All rights reserved.</p></div>'
STORY = "<h1>A title of six plain words</h1>" + "".join(f"<p>{'Some words of a paragraph that goes on. ' * 4}</p>" for _ in range(4))


@pytest.mark.parametrize("name", ["message", "primary message", "feedback", "notice", "legal", "commercial", "recommended", "share", "reply", "comment", "related", "widget"])
def test_a_name_alone_does_not_hide_an_article(name):
    got = main_text(f'<html><body>{MENU}<div class="{name}">{STORY}</div>{FOOT}</body></html>')
    assert got.startswith("A title of six plain words\n") and got.count("\n") == 4 and "Home" not in got and "Copyright" not in got


@pytest.mark.parametrize("html", [
    f"<html><body><nav><a href=x>Home</a></nav><article><p>Only five words stand here.</p></article><footer>Copyright Us</footer></body></html>",
    f"<html><body>{MENU}<article><p>Only five words stand here.</p></article>{FOOT}</body></html>",
    f'<html><body>{MENU}<div class="post"><p>Only five words stand here.</p></div><form><label>Name</label><input></form></body></html>',
])
def test_short_pages(html):
    assert main_text(html) == "Only five words stand here."


@pytest.mark.parametrize("html", ["", " ", "<html></html>", f"<html><body><nav><a href=x>Home</a> <a href=y>News</a></nav><footer>Copyright 2020 Us</footer></body></html>", "<script>let a = 1;</script>"])
def test_pages_without_text(html):
    assert main_text(html) == ""


def test_comments_under_a_short_article_stay_out():
    comments = "".join('<div class="comment"><p>A rather long comment by someone who has much to say about it all.</p></div>' for _ in range(8))
    got = main_text(f'<html><body>{MENU}<article><h1>A title of six plain words</h1><p>{"Some words of a paragraph that goes on. " * 5}</p></article><div class="comments"><h3>Comments</h3>{comments}</div>{FOOT}</body></html>')
    assert "comment by" not in got and got.startswith("A title of six plain words")
