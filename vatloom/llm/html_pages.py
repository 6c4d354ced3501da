"""Labelled web pages for fitting the weights of main-text extraction.

Pages are drawn from layouts: a head, a menu, notices, a content region, boxes beside and below it, reader
comments and a footer, each with the element and the class or id words such parts have on the web, and with
wrappers whose class names mention parts they merely contain (``has-sidebar``, ``comments-open``). Words are made
of random syllables, so nothing is learned about a language. Content stands between ``<!--[-->`` and ``<!--]-->``.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo yu za bren clo dral est fri".split()

# Class, id and role words of the parts of pages; several words make one attribute.
PARTS = {
    "menu": "nav;navbar;navigation;menu;main-menu;site-nav;breadcrumb;breadcrumbs;pagination;pager;toc;tabs;toolbar;top-nav;sub-menu;mega-menu;skip-links;page-navigation;nav-list",
    "head": "header;site-header;masthead;page-header;top;topbar;top-bar;branding;logo;site-title;banner;head;header-bar",
    "foot": "footer;site-footer;page-footer;bottom;copyright;colophon;legal;imprint;footer-links;foot;contentinfo;footer-wrap",
    "side": "sidebar;aside;side;widget;widget-area;rail;right-rail;secondary;complementary;related;related-posts;recommended;trending;popular;most-read;more-stories;teaser;promo;share;share-bar;social;follow-us;tag-list;post-tags;author-box;author-bio;read-next;sidebar-box",
    "advert": "ad;ads;advert;adverts;advertisement;advertising;ad-slot;ad-box;banner-ad;sponsor;sponsored;promotion;adsense;dfp-ad;ad-container;google-ad;outbrain;taboola;commercial",
    "notice": "notice;cookie;cookies;cookie-notice;cookie-banner;consent;gdpr;alert;popup;modal;overlay;newsletter;newsletter-box;subscribe;subscription;signup;paywall;disclaimer;message;privacy-notice",
    "form": "search;search-form;login;signin;contact-form;form;form-row;poll;survey;searchbox",
    "comments": "comments;comment;comment-list;comment-section;comments-area;commentlist;comment-thread;replies;reply;respond;discussion;disqus;feedback;reactions;comment-body;user-comments",
    "content": "content;main;article;post;entry;story;text;body;prose;page-content;post-content;entry-content;article-body;articleBody;main-content;post-body;story-body;blog-post;single;hentry;copy;primary;rich-text;article-text;section",
    "wrapper": "wrapper;page;container;site;layout;row;col;grid;inner;outer;wrap;app;root;box;block;columns;clearfix;single-post;template;theme",
    "mention": "has-sidebar;with-sidebar;sidebar-right;layout-sidebar;no-sidebar;header-fixed;with-header;sticky-header;footer-visible;comments-open;has-comments;tags-open;share-enabled;has-share;ads-enabled;no-ads;with-ads;menu-open;nav-closed;search-enabled;search-page;search-result;newsletter-page;newsletter-issue;newsletter-article;legal-page;legal;author-page;author-post;promo-page;related-on;social-on;notice-page;alert-page;banner-top;cookie-policy;form-page;login-required;widget-page;teaser-page;subscribe-page;popup-off;feedback-page;discussion-page;toc-on;tabbed;sponsored-post;follow-up;reply-open;message-page;survey-result",
}
_NAMES = {k: v.split(";") for k, v in PARTS.items()}


class Writer:
    """Writes one page from a random source."""

    def __init__(self, rng: random.Random):
        self.rng = rng

    def word(self) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randint(1, 3)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentence(self, low: int = 4, high: int = 25) -> str:
        return self.words(low, high).capitalize() + self.rng.choice("...!?")

    def link(self) -> str:
        return f'<a href="/{self.word()}">{self.words(1, 3)}</a>'

    def links(self, low: int = 3, high: int = 9) -> str:
        items = [self.link() for _ in range(self.rng.randint(low, high))]
        return self.rng.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), " ".join(items), "".join(f"<div>{x}</div>" for x in items)])

    def attrs(self, part: str, mention: float = 0.0, most: int = 2) -> str:
        """A class, id or role attribute of a part; sometimes none."""
        r = self.rng
        names = r.sample(_NAMES[part], r.randint(1, most))
        if r.random() < mention:
            names.insert(r.randrange(len(names) + 1), r.choice(_NAMES["mention"]))
        if r.random() < 0.1:
            names = ["".join(w.capitalize() if i else w for i, w in enumerate(n.split("-"))) for n in names]
        if r.random() < 0.3:
            names.append(self.word())
        kind = r.choice(["class", "class", "class", "id"])
        return f' {kind}="{(" " if kind == "class" else "-").join(names)}"'

    def element(self, part: str, tags: str, body: str, plain: float = 0.5) -> str:
        """``body`` in an element of the part: its own tag, a div with its words, or both."""
        r = self.rng
        own, any_ = tags.split()[0], r.choice(tags.split())
        if own != "div" and r.random() < plain:
            return f"<{own}>{body}</{own}>" if r.random() < 0.5 else f"<{own}{self.attrs(part)}>{body}</{own}>"
        return f"<{any_}{self.attrs(part)}>{body}</{any_}>"

    def paragraph(self) -> str:
        r = self.rng
        text = " ".join(self.sentence() for _ in range(r.choice([1, 1, 2, 3, 5])))
        if r.random() < 0.15:
            text = self.sentence(1, 4)
        if r.random() < 0.3:
            text += f" {r.choice(['<b>', '<em>', '<span>'])}{self.words(1, 4)} {self.link()} {self.words(1, 6)}."
        return text + ("<br>" if r.random() < 0.1 else "")

    def content(self) -> str:
        """Blocks of an article, with boxes between them that are none of it."""
        r = self.rng
        close = "</p>" if r.random() < 0.8 else ""
        title = f"<h1>{self.words(2, 9)}</h1>"
        if r.random() < 0.25:
            title = f"<header>{title}</header>" if r.random() < 0.5 else f"<div{self.attrs('head', most=1)}>{title}</div>"
        blocks = [title] if r.random() < 0.85 else []
        for _ in range(r.randint(1, 8)):
            kind = r.random() if len(blocks) > 1 else 0.0
            if kind < 0.62:
                block = r.choice([f"<p>{self.paragraph()}{close}"] * 3 + [f"<div>{self.paragraph()}</div>", f"<div>{self.paragraph()}</div>", f"{self.paragraph()}<br><br>"])
            elif kind < 0.72:
                block = f"<h2>{self.words(1, 6)}</h2>"
            elif kind < 0.82:
                items = "".join(f"<li>{self.link() if r.random() < 0.25 else self.sentence(1, 12)}</li>" for _ in range(r.randint(2, 5)))
                block = r.choice([f"<ul>{items}</ul>", f"<ol>{items}</ol>"])
            elif kind < 0.87:
                block = "<table>" + "".join(f"<tr><td>{self.words(1, 2)}</td><td>{r.randint(1, 99)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>"
            elif kind < 0.92:
                block = f"<blockquote>{self.sentence()}</blockquote>"
            elif kind < 0.95:
                block = f"<pre>{self.words(3, 12)}</pre>"
            else:
                block = f'<figure><img src="x.png"><figcaption>{self.words(2, 9)}</figcaption></figure>'
            blocks.append(block)
            if r.random() < 0.12:
                blocks.append("<!--]-->" + self.box() + "<!--[-->")
        return "<!--[-->" + "".join(blocks) + "<!--]-->"

    def box(self) -> str:
        """A part that is no content."""
        r = self.rng
        kind = r.choice(["side", "side", "advert", "advert", "notice", "form", "menu"])
        prose = f"<p>{self.sentence(5, 22)}</p>"
        if kind == "menu":
            return self.element(kind, "nav div ul", self.links())
        if kind == "form":
            return self.element(kind, "form div", f"<label>{self.words(1, 3)}</label><input name=q><button>{self.word()}</button>")
        if kind == "side":
            body = r.choice([f"<h3>{self.words(1, 3)}</h3>{self.links()}", prose, f"<h3>{self.words(1, 3)}</h3>{prose}{self.link()}", self.links(2, 4), f"<ul><li>{self.sentence(4, 9)}</li><li>{self.sentence(4, 9)}</li></ul>"])
            return self.element(kind, "aside div div", body, 0.4)
        body = r.choice([prose, self.words(4, 20), f"{self.sentence()} <button>{self.word()}</button>", f"{self.words(2, 8)} {self.link()}"])
        return self.element(kind, "div div section", body)

    def thread(self) -> str:
        r = self.rng
        tag = r.choice(["div", "div", "li", "article"])
        one = lambda: f"<{tag}{self.attrs('comments', most=1) if r.random() < 0.8 else ''}><b>{self.word()}</b><p>{' '.join(self.sentence() for _ in range(r.randint(1, 4)))}</p></{tag}>"
        body = "".join(one() for _ in range(r.choice([1, 2, 3, 6, 14])))
        return f"<{r.choice(['div', 'section', 'ol', 'aside'])}{self.attrs('comments')}><h3>{self.words(1, 3)}</h3>{body}</div>"

    def page(self) -> str:
        r = self.rng
        inner = self.content()
        how = r.random()
        if how < 0.3:
            tag = r.choice(["article", "main"])
            inner = f"<{tag}>{inner}</{tag}>" if r.random() < 0.5 else f"<{tag}{self.attrs('content', 0.3)}>{inner}</{tag}>"
        elif how < 0.66:
            inner = f"<{r.choice(['div', 'div', 'section'])}{self.attrs('content', 0.5)}>{inner}</div>"
        elif how < 0.85:
            inner = f"<div>{inner}</div>"
        around = [inner]
        if r.random() < 0.5:
            around.insert(r.choice([0, 1]), self.element("side", "aside div", "".join(self.box() for _ in range(r.randint(1, 3)))))
        for _ in range(r.choice([0, 1, 2])):
            around.insert(r.choice([0, len(around)]), self.box())
        if r.random() < 0.4:
            around.append(self.thread())
        body, top = "".join(around), []
        if r.random() < 0.8:
            top.append(self.element("head", "header div", r.choice([f"<a href=/>{self.words(1, 3)}</a>", f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.words(2, 6)}</p>"]) + (self.links() if r.random() < 0.4 else "")))
        if r.random() < 0.85:
            top.append(self.element("menu", "nav div ul", self.links()))
        if r.random() < 0.3:
            top.append(self.box())
        foot = self.element("foot", "footer div", r.choice([f"&copy; 2020 {self.words(2, 5)}. {self.words(2, 8)}.", f"<p>{self.sentence(3, 18)}</p>", self.links(), f"<p>{self.words(2, 5)}</p>{self.links()}"])) if r.random() < 0.9 else ""
        # a wrapper holds the whole page, or all but its head and foot
        top, whole = "".join(top), r.random() < 0.75
        body = top + body + foot if whole else body
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            body = f"<div{self.attrs('wrapper', 0.5)}>{body}</div>"
        attrs = self.attrs("wrapper", 0.6) if r.random() < 0.4 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 5)}</title></head><body{attrs}>{body if whole else top + body + foot}</body></html>"


def labelled_pages(n: int = 240, seed: int = 11) -> list[str]:
    """``n`` labelled pages, the same for the same seed."""
    return [Writer(random.Random(f"{seed}/{i}")).page() for i in range(n)]
