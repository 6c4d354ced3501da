"""Main text of web pages: the best contiguous region by a maximum-scoring subsequence.

A page is read as a sequence of tags and runs of words. Each word scores the log odds of content given its
surroundings, at most ``MOST`` and at least ``LEAST``; each tag scores below zero, the less the more it
occurs in content. One linear scan finds the contiguous region of the largest sum. Inside it, runs whose
marked ancestors speak against them (adverts, forms, shares, asides between paragraphs) are left out, and
everything else is kept whole.

The log odds are a logistic regression on labelled pages (``html_pages.labelled_pages``, or any others whose
content stands between ``<!--[-->`` and ``<!--]-->``). Its features are the block's tag, length and share of
linked words, and the marks of the ancestors: tag names and the words of class, id and role, each together
with the share of the page's words that the element holds. So ``has-sidebar`` around a whole article is
another feature than ``sidebar`` beside it, and no single word decides. Ancestors further out count
less, by a factor of ``DECAY`` each.

Text: character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined by one line feed, empty ones vanish. ``br`` is white space.

Reading a page takes time in proportion to its length, also where tags are not closed, quotes are
missing or elements are nested without end: open elements are counted by name, what an ancestor
contributes is kept on each node, and nothing is searched for again once it is known to be missing.

Defined cases. Null or empty html, or a page without content: empty text. Unclosed or crossed tags,
cut-off pages, scripts that contain tags: read as browsers do, roughly; nothing raises. Repeated rows:
one result row each. Extra columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .html_pages import labelled_pages

# A tag whose attributes hold no < or >, which nearly all are; others are read attribute by attribute.
QUICK = re.compile(r"<([a-zA-Z][^\s/><]*)((?:\s+[^\s\"'<>/=]+(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=]+))?)*)\s*/?>")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]*)(\s*=\s*)?")
UNQUOTED = re.compile(r"[^\s>]*")
NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

# Element names by what they mean for reading a page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template svg iframe textarea select title math object canvas".split()}
LISTS = frozenset("ul ol dl table menu".split())
MARKED = frozenset("article main nav header footer aside form button label fieldset dialog menu address figure".split())
KINDS = {"p": "p", "li": "li", "dd": "li", "dt": "li", "td": "td", "th": "td", "div": "div", "pre": "pre", "blockquote": "p", "figcaption": "p", **{f"h{i}": "h" for i in range(1, 7)}}

TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li td th tr tbody pre blockquote figcaption dt dd header".split())

DECAY, INHERITED, LEAST, MOST, LIMIT, SURE = 0.2, 1.5, -0.35, 1.5, 6.0, 0.5
#: What a word of content weighs against another in fitting: losing content is the worse mistake.
CONTENT_WEIGHT = 5.0


@lru_cache(maxsize=20_000)
def marks_of(name: str, attrs: str) -> tuple[tuple[str, ...], bool]:
    """The marks of an element (its tag and the words of class, id, role), and whether it is hidden."""
    if name in ("html", "body"):
        # wrappers of everything
        return (), bool(attrs) and bool(HIDDEN.search(attrs))
    found = [f"<{name}>"] if name in MARKED else []
    if attrs:
        found += dict.fromkeys(w.lower() for m in NAMED.finditer(attrs) for w in PART.findall(m[1] or m[2] or m[3] or ""))
    return tuple(found), bool(attrs) and bool(HIDDEN.search(attrs))


class Page:
    """The nodes of a page and its sequence of tags and text runs."""

    def __init__(self, page: str):
        # a node: parent, name, marks, hidden, inside a link, block, list, whether an article or main is around it, words, linked words
        self.parent, self.name, self.marks, self.hidden, self.linked = [0], [""], [()], [False], [False]
        self.block, self.list, self.article = [0], [0], [False]
        # a place of the sequence: node, tag (with / if it closes; empty for text), text, words, inside the labelled content
        self.seq: list[tuple[int, str, str, int, bool]] = []
        self._read(page)
        n = len(self.parent)
        words, linked = [0] * n, [0] * n
        for node, _, _, w, _ in self.seq:
            words[node] += w
            if self.linked[node]:
                linked[node] += w
        for i in range(n - 1, 0, -1):
            words[self.parent[i]] += words[i]
            linked[self.parent[i]] += linked[i]
        self.words, self.links = words, linked
        self.titled = [x == "h1" for x in self.name]
        for i in range(n - 1, 0, -1):
            if self.titled[i] and self.name[i] != "header":
                self.titled[self.parent[i]] = True

    def _open(self, stack: list[int], opened: Counter, name: str, attrs: str) -> None:
        at, up = len(self.parent), stack[-1]
        marks, hidden = marks_of(name, attrs)
        if marks and marks[0] in ("<header>", "<footer>") and self.article[up]:
            marks = (f"{marks[0]} of article", *marks[1:])
        self.parent.append(up)
        self.name.append(name)
        self.marks.append(marks)
        self.hidden.append(hidden or self.hidden[up])
        self.linked.append(name == "a" or self.linked[up])
        self.block.append(at if name in BLOCKS else self.block[up])
        self.list.append(at if name in LISTS else self.list[up])
        self.article.append(name in ("article", "main") or self.article[up])
        stack.append(at)
        opened[name] += 1

    def _close(self, stack: list[int], opened: Counter, name: str) -> None:
        """Leave the innermost open element of that name and all inside it; nothing if there is none."""
        while opened[name]:
            last = self.name[stack.pop()]
            opened[last] -= 1
            if last == name:
                return

    def _implied(self, stack: list[int], opened: Counter, name: str) -> None:
        """Leave what a start tag ends without saying so: a paragraph before a block, an item before the next."""
        if name in BLOCKS and opened["p"]:
            self._close(stack, opened, "p")
        if name == "li" and opened["li"] and self._inner(stack, "li"):
            self._close(stack, opened, "li")
        elif name in ("td", "th", "tr", "option", "dt", "dd"):
            for other in ("td", "th") if name in ("td", "th") else ("td", "th", "tr") if name == "tr" else ("dt", "dd") if name[0] == "d" else (name,):
                if opened[other] and self._inner(stack, other):
                    self._close(stack, opened, other)

    def _inner(self, stack: list[int], name: str) -> bool:
        """Whether an element of that name is open inside the innermost list or table."""
        around = self.list[stack[-1]]
        for i in range(len(stack) - 1, max(len(stack) - 32, 0), -1):
            if stack[i] == around:
                return False
            if self.name[stack[i]] == name:
                return True
        return False

    def _read(self, page: str) -> None:
        stack, opened, missing, seq = [0], Counter(), set(), self.seq
        inside, at, start, size = False, 0, 0, len(page)

        def text(end: int) -> None:
            if end > start and not self.hidden[stack[-1]]:
                piece = page[start:end]
                if "&" in piece:
                    piece = entities.unescape(piece)
                seq.append((stack[-1], "", piece, len(piece.split()), inside))

        while True:
            at = page.find("<", at)
            if at < 0:
                text(size)
                return
            nxt = page[at + 1 : at + 2]
            if nxt.isascii() and nxt.isalpha():
                m = QUICK.match(page, at)
                if m:
                    name, attrs, end = m[1].lower(), m[2], m.end()
                else:
                    name, attrs, end = self._slow(page, at, missing)
                text(at)
                if end < 0:  # cut off inside a tag
                    return
                start = end
                closing = page[end - 2] == "/"
                if name in RAW and not closing and name not in missing:
                    stop = RAW[name].search(page, end)
                    if stop:
                        seq.append((stack[-1], "raw", "", 0, inside))
                        at = start = stop.end()
                        continue
                    if name in ("script", "style"):
                        return
                    missing.add(name)
                self._implied(stack, opened, name)
                if name == "br" or name == "wbr":
                    seq.append((stack[-1], name, " ", 0, inside))
                else:
                    if name not in VOID and (not closing or name in BLOCKS or name == "a"):
                        self._open(stack, opened, name, attrs)
                    seq.append((stack[-1], name, "", 0, inside))
                at = end
            elif nxt == "/" and page[at + 2 : at + 3].isalpha():
                text(at)
                end = page.find(">", at)
                if end < 0:
                    return
                name = NAME.match(page, at + 2)[0].lower()
                seq.append((stack[-1], "/" + name, "", 0, inside))
                self._close(stack, opened, name)
                at = start = end + 1
            elif nxt == "!" or nxt == "?" or nxt == "/":
                text(at)
                if page.startswith("<!--", at):
                    if page.startswith("<!--[-->", at) or page.startswith("<!--]-->", at):
                        inside = page[at + 4] == "["
                    end = page.find("-->", at + 2)
                    end = end + 3 if end >= 0 else size
                elif page.startswith("<![CDATA[", at):
                    end = page.find("]]>", at)
                    piece = page[at + 9 : end if end >= 0 else size]
                    if piece and not self.hidden[stack[-1]]:
                        seq.append((stack[-1], "", piece, len(piece.split()), inside))
                    end = end + 3 if end >= 0 else size
                else:
                    end = page.find(">", at) + 1 or size
                at = start = end
            else:
                at += 1

    @staticmethod
    def _slow(page: str, at: int, missing: set) -> tuple[str, str, int]:
        """Name, attributes and end of a tag, attribute by attribute; end -1 if it is cut off. A quote that is never closed is none."""
        m = NAME.match(page, at + 1)
        name, p = m[0].lower(), m.end()
        if ">" in missing:
            return name, "", -1
        first = p
        while True:
            m = ATTRIBUTE.match(page, p)
            p = m.end()
            if m[2]:
                quote = page[p : p + 1]
                if quote in ('"', "'") and quote not in missing:
                    end = page.find(quote, p + 1)
                    if end >= 0:
                        p = end + 1
                        continue
                    missing.add(quote)
                p = UNQUOTED.match(page, p).end()
            if p >= len(page):
                missing.add(">")
                return name, "", -1
            if page[p] == ">":
                return name, page[first:p], p + 1
            if m.end() == m.start():
                p += 1

    def share(self, node: int) -> str:
        """How much of the page's words a node holds, and whether it is much and has a title among it."""
        part = self.words[node] / max(1, self.words[0])
        if self.titled[node]:
            return "titled" if part >= 0.12 else "small titled"
        return "large" if part >= 0.4 else "some" if part >= 0.12 else "small"

    def all_links(self, node: int) -> bool:
        """Whether the list around a node, or its block outside of lists, is nothing but links."""
        i = self.list[node] or self.block[node]
        return 10 * self.links[i] >= 9 * self.words[i]

    def block_features(self, node: int) -> tuple[str, ...]:
        """Tag, length and linked share of the block around a node, and the linked share of its list."""
        b = self.block[node]
        n, k = self.words[b], self.links[b]
        listed = self.list[node]
        dense = "none" if not listed else "links" if self.links[listed] * 2 >= self.words[listed] else "text"
        return (
            f"block {KINDS.get(self.name[b], 'other')}",
            "1-3 words" if n <= 3 else "4-9 words" if n <= 9 else "10-24 words" if n <= 24 else "25 words",
            "no link" if not k else "few links" if 2 * k < n else "links",
            f"list {dense}",
        )


class Weights:
    """The logistic regression of content on surroundings, and the scores of tags."""

    def __init__(self, pages: list[str] | None = None, penalty: float = 0.0005, steps: int = 300):
        read = [Page(p) for p in (labelled_pages() if pages is None else pages)]
        rows, labels, sizes, tags = [], [], [], {True: Counter(), False: Counter()}
        for page in read:
            for node, tag, _, words, inside in page.seq:
                if tag:
                    tags[inside][tag.lstrip("/")] += 1
                elif words:
                    rows.append(self._row(page, node))
                    labels.append(inside)
                    sizes.append(math.sqrt(words) * (CONTENT_WEIGHT if inside else 1.0))
        names = Counter(f for r in rows for f in r)
        known = {f: i for i, f in enumerate(sorted(f for f, n in names.items() if n >= 8))}
        x = np.zeros((len(rows), len(known) + 1), np.float32)
        x[:, -1] = 1
        for i, r in enumerate(rows):
            for f, v in r.items():
                if f in known:
                    x[i, known[f]] += v
        y, size = np.array(labels, np.float32), np.array(sizes, np.float32)
        size /= max(size.sum(), 1.0)
        w, momentum = np.zeros(len(known) + 1, np.float32), np.zeros(len(known) + 1, np.float32)
        shrink = np.full(len(w), penalty, np.float32)
        shrink[-1] = 0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = ((p - y) * size) @ x + shrink * w
            momentum = 0.9 * momentum - grad
            w = w + momentum
        self.bias = float(w[-1])
        self.feature = {f: float(w[i]) for f, i in known.items()}
        sums = {c: sum(tags[c].values()) + 1 for c in tags}
        self.tag = {t: min(-0.02, -0.12 + 0.05 * math.log((tags[True][t] + 1) / sums[True] * sums[False] / (tags[False][t] + 1))) for t in {*tags[True], *tags[False]}}

    @staticmethod
    def _row(page: Page, node: int) -> dict[str, float]:
        """Features of a run: of its block, and of its marked ancestors, less the further out."""
        row = dict.fromkeys(page.block_features(node), 1.0)
        factor = 1.0
        while node:
            if page.marks[node]:
                for m in page.marks[node]:
                    key = f"{m} {page.share(node)}"
                    row[key] = row.get(key, 0.0) + factor
                factor *= DECAY
            node = page.parent[node]
        return row

    def marks(self, page: Page) -> list[float]:
        """What the marked ancestors of each node add up to, nearest first."""
        get, out = self.feature.get, [0.0] * len(page.parent)
        for i in range(1, len(out)):
            up = out[page.parent[i]]
            if page.marks[i]:
                share = page.share(i)
                own = sum(get(f"{m} {share}", get(f"{m} some", 0.0) if share == "large" else 0.0) for m in page.marks[i])  # a footer that makes up a tiny page is a footer
                if page.titled[i] and 2 * page.words[i] >= page.words[0]:
                    own = max(own, 0.0)  # what holds the title and most of the page is not noise for its name
                up = own + DECAY * min(up, INHERITED)
            out[i] = max(-LIMIT, min(LIMIT, up))
        return out

    def words(self, page: Page, marks: list[float]) -> list[float]:
        """Score of a word at each node."""
        get, blocks, out = self.feature.get, {}, []
        for i, m in enumerate(marks):
            key = (page.block[i], page.list[i])
            if key not in blocks:
                blocks[key] = self.bias + sum(get(f, 0.0) for f in page.block_features(i))
            out.append(max(LEAST, min(MOST, 0.5 * (blocks[key] + m))))
        return out


@lru_cache(maxsize=1)
def default_weights() -> Weights:
    return Weights()


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and end of the contiguous stretch with the largest sum; (0, 0) if no score is positive. The earliest of equal ones, and the shortest."""
    best = total = 0.0
    first = end = start = 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, first, end = total, start, i + 1
    return first, end


def whole_element(page: Page, first: int, end: int) -> tuple[int, int]:
    """The region grown to the ends of the innermost element around it, if it holds at least half of the words there; not to those of the page."""
    runs = [i for i in range(first, end) if page.seq[i][3]]
    if not runs:
        return first, end
    # nodes are numbered as they open, so those inside a node follow it without a gap
    last = list(range(len(page.parent)))
    for i in range(len(last) - 1, 0, -1):
        last[page.parent[i]] = max(last[page.parent[i]], last[i])
    around, most = min(page.seq[i][0] for i in runs), max(page.seq[i][0] for i in runs)
    while last[around] < most or page.name[around] in TEXT_BLOCKS or page.name[around] not in BLOCKS and around:
        around = page.parent[around]
    if not around or page.name[around] in ("html", "body") or 2 * sum(page.seq[i][3] for i in runs) < page.words[around]:
        return first, end
    inside = lambda i: around <= page.seq[i][0] <= last[around]
    while first and inside(first - 1):
        first -= 1
    while end < len(page.seq) and inside(end):
        end += 1
    return first, end


#: Elements that are beside a page's text whatever they hold.
BESIDE = ("nav", "footer", "aside", "form")


def least_bad(page: Page, marks: list[float], words: list[float]) -> tuple[int, int]:
    """The block of the best run that is no link, in an article or main element if there is one, else where nothing around it
    speaks against it; (0, 0) without one."""
    beside, within = [False] * len(page.parent), [False] * len(page.parent)
    for i in range(1, len(beside)):
        beside[i] = beside[page.parent[i]] or page.name[i] in BESIDE
        within[i] = within[page.parent[i]] or page.name[i] in ("article", "main")
    runs = [i for i, (node, t, _, n, _) in enumerate(page.seq) if not t and n and not beside[node] and not page.all_links(node) and (within[node] or marks[node] >= 0)]
    if not runs:
        return 0, 0
    best = max(runs, key=lambda i: (within[page.seq[i][0]], words[page.seq[i][0]], page.seq[i][3], -i))
    same = [i for i in runs if page.block[page.seq[i][0]] == page.block[page.seq[best][0]]]
    return same[0], same[-1] + 1


def main_text(page: str | None, weights: Weights | None = None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    weights = weights or default_weights()
    read = Page(page)
    marks = weights.marks(read)
    words = weights.words(read, marks)
    tag = weights.tag
    first, end = best_region([tag.get(t.lstrip("/"), -0.2) if t else n * words[node] for node, t, _, n, _ in read.seq])
    short = first == end  # a page too short for any stretch to be worth its tags
    if short:
        first, end = least_bad(read, marks, words)
    first, end = whole_element(read, first, end)
    lines, line = [], []

    def close() -> None:
        joined = " ".join("".join(line).split())
        if joined:
            lines.append(joined)
        line.clear()

    for node, t, text, n, _ in read.seq[first:end]:
        if t:
            if t.lstrip("/") in BLOCKS:
                close()
            elif text:
                line.append(text)
        elif not n:
            line.append(" ")
        elif short or marks[node] >= SURE or marks[node] >= 0 and not (words[node] <= LEAST and read.all_links(node)):
            line.append(text)
    close()
    return "\n".join(lines)


def extractor(spark: SparkSession, weights: Weights | None = None):
    """A column function: html to main text."""
    sent = spark.sparkContext.broadcast(weights or default_weights())

    @F.arrow_udf(T.StringType())
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py(), sent.value) for p in pages], pa.string())

    return extract


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", "url", extractor(spark)("html").alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
