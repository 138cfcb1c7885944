"""Main text of web pages by the distribution of text over lines.

Markup is stripped into lines, one per block element, each weighed by the characters that are not link text.  Lines of
menus, forms, adverts and the like weigh nothing.  Sums over a sliding window of lines make the distribution: it surges
where the article starts and dives where it ends.  Text between is the result.  Where a page marks articles or a main part,
the distribution is taken inside them: of several articles those that surge stay, and teasers do not.  Pages are single rows
and no page needs another, so the job is one pass without a shuffle, in time proportional to the page however broken it is.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts_of

#: Lines of a window, and characters a window of an unmarked page must reach to be a surge.
WINDOW = 3
SURGE = 80
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that start and end a line; all others, unknown ones too, stand within a line.
BLOCK = frozenset(
    "address article aside audio blockquote body br button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul video".split()
)
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in "script style noscript template iframe object svg math textarea select title".split()}
#: Elements that never hold the article, and words in class, id or role that say the same.
APART = frozenset("nav footer aside form button dialog menu header head datalist audio video canvas".split())
APART_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement advertising banner"
    " sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login"
    " comment comments commentlist respond replies disqus share sharing social related recommended recommendations widget search form toolbar pagination pager"
    " copyright contentinfo complementary hidden".split()
)
#: Words that may stand beside those in one class or id and change nothing; any other word makes it a name of its own.
BESIDE = frozenset(
    "site page main primary secondary global top bottom left right inner outer wrap wrapper container box block section area bar panel list item items link links"
    " button buttons icon icons slot unit group post posts mobile desktop js".split()
)
#: The words that count for an element within a line.
INLINE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion hidden".split())
HEADERS = frozenset(("header", "masthead"))
MARKED = frozenset(("article", "main"))
#: Opening one of these ends an open paragraph, and an item ends its open sibling.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _names_apart(value: str, in_article: bool, words: frozenset[str] = APART_WORDS) -> bool:
    """Is one of the classes or ids a name of what is apart, such as ``sidebar`` or ``cookie-notice``, but not ``has-sidebar``?"""
    for token in value.lower().split():
        parts = {p for p in re.split(r"[-_]+|\d+", token) if p}
        said = parts & words
        if said and parts <= words | BESIDE and not (in_article and said <= HEADERS):
            return True
    return False


def _apart(tag: str, attributes: str, in_article: bool) -> int:
    """0: not apart; 1: apart by its name or as a form, unless it holds the article; 2: apart with all it holds."""
    if tag in APART:
        return 0 if tag == "header" and in_article else 1 if tag == "form" else 2
    if not attributes.strip() or tag in ("html", "body", "article", "main"):
        return 2 * (tag == "article" and any(re.search(r"comment|reply", v or w or x, re.I) for _, v, w, x in ATTRIBUTE.findall(attributes)))
    named = 0
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop") and _names_apart(value, in_article, APART_WORDS if tag in BLOCK else INLINE_WORDS):
            named = 1
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return 2
    return named


class _Lines:
    """Lines of a page: text, characters of link text, whether apart, number of the article it is in (0: none), whether in a
    main part.  Every step costs a constant time but for elements that it opens or closes."""

    def __init__(self):
        self.lines: list[tuple[str, int, bool, int, bool]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.stack: list[tuple[str, int]] = []  # open elements, and how each is apart
        self.blocks: list[int] = []  # places of blocks in the stack
        self.inline: list[Counter] = [Counter()]  # open elements within a line, per block
        self.open_blocks: Counter = Counter()
        self.named: list[int] = []  # places of those apart by name
        self.apart = self.muted = self.articles = self.article = self.main = self.links = 0

    def end(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, min(self.linked, len(text)), self.apart > 0, self.article if self.articles else 0, self.main > 0))
        self.parts, self.linked = [], 0

    def _count(self, tag: str, apart: int, by: int) -> None:
        if apart and tag in BLOCK:
            self.apart += by
        elif apart:
            self.muted += by

    def push(self, tag: str, apart: int) -> None:
        if tag in MARKED and not apart:  # what holds the article is not apart
            for k in self.named:
                self._count(*self.stack[k], -1)
                self.stack[k] = (self.stack[k][0], 0)
            self.named = []
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
            self.open_blocks[tag] += 1
            self.inline.append(Counter())
        else:
            self.inline[-1][tag] += 1
        if apart == 1:
            self.named.append(len(self.stack))
        self.stack.append((tag, apart))
        self._count(tag, apart, 1)
        if tag == "article":
            self.article += not self.articles
            self.articles += 1
        self.main += tag == "main"
        self.links += tag == "a"

    def pop(self) -> None:
        tag, apart = self.stack.pop()
        self._count(tag, apart, -1)
        if self.named and self.named[-1] == len(self.stack):
            self.named.pop()
        if tag in BLOCK:
            self.blocks.pop()
            self.open_blocks[tag] -= 1
            self.inline.pop()
        else:
            self.inline[-1][tag] -= 1
        self.articles -= tag == "article"
        self.main -= tag == "main"
        self.links -= tag == "a"

    def open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.end()
        if tag in VOID:
            return
        if tag in BLOCK:
            ends = SIBLINGS.get(tag, ("p",))
            for k in reversed(self.blocks[-2:]):  # a paragraph holds no paragraph: behind it there is another block
                if self.stack[k][0] in ends:
                    while len(self.stack) > k:
                        self.pop()
                    break
                if self.stack[k][0] != "p":
                    break
        self.push(tag, _apart(tag, attributes, self.articles + self.main > 0))

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.end()
        if self.open_blocks[tag] if tag in BLOCK else self.inline[-1][tag]:  # an end tag within a line closes no block
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()

    def text(self, text: str) -> None:
        if self.muted:
            return
        text = html.unescape(text) if "&" in text else text
        self.parts.append(text)
        if self.links:
            self.linked += len(text.strip())


class _Tags:
    """Where tags of a page end.  A quote without a partner is a character like others; once no ``>`` is left outside
    quotes, quotes do not count in the rest of the page.  So a scan that leads nowhere is not repeated."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True
        self.last = {c: page.rfind(c) for c in "<>\"'"}

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag at ``at``, or -1."""
        if at > self.last[">"]:
            return -1
        here = at
        while self.quotes:
            stop = STOP.search(self.page, here)
            if not stop:
                self.quotes = False
            elif stop[0] == ">":
                return stop.start()
            else:
                here = stop.end() if stop.start() >= self.last[stop[0]] else self.page.find(stop[0], stop.end()) + 1
        return self.page.find(">", at)


def page_lines(page: str) -> list[tuple[str, int, bool, int, bool]]:
    """Lines of a page by one scan forward."""
    lines, tags, at = _Lines(), _Tags(page), 0
    while at < len(page):
        if page[at] != "<":
            end = page.find("<", at)
            end = end if end >= 0 else len(page)
            lines.text(page[at:end])
            at = end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        name = NAME.match(page, at, at + 260)
        end = tags.end(name.end()) if name else page.find(">", at) if page[at + 1 : at + 2] in ("!", "?", "/") and at < tags.last[">"] else -1
        if end < 0:  # no tag: a character like others
            lines.text("<")
            at += 1
            continue
        if name:
            tag, attributes = name[1].lower(), page[name.end() : end]
            if page[at + 1] == "/":
                lines.close(tag)
            elif tag in RAW:
                if tag not in ("svg", "math") or not attributes.endswith("/"):
                    close = RAW[tag].search(page, end)
                    end = page.find(">", close.end()) if close else -1
                    end = end if end >= 0 else len(page)
            else:
                lines.open(tag, attributes)
        at = end + 1
    lines.end()
    return lines.lines


def spans(weights: np.ndarray, window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Line ranges from a surge to its dive.

    A surge is the first weighty line of a window that reaches ``surge``; the dive is the last weighty line before the
    distribution falls to zero.  Spans grow over neighbours that weigh something, so nothing between the two is lost.
    """
    if not len(weights):
        return []
    sums = np.convolve(weights, np.ones(window, np.int64))[window - 1 :]  # sums[i]: lines i .. i + window - 1
    found, at, n = [], 0, len(weights)
    while at < n:
        if sums[at] == 0:
            at += 1
            continue
        end = at
        while end < n and sums[end] > 0:
            end += 1
        inside = [k for k in range(at, min(n, end + window)) if weights[k] > 0]
        if sums[at:end].max() >= surge:
            found.append((inside[0], inside[-1] + 1))
        at = max(end, inside[-1] + 1)
    return found


def _reach(weights: np.ndarray, window: int) -> int:
    """The largest sum over a window."""
    return int(np.convolve(weights, np.ones(window, np.int64)).max()) if len(weights) else 0


def _surging(lines: list, places: list[int], window: int, surge: int) -> list[int]:
    """Of the lines at ``places``, those between the first surge and the last dive, short paragraphs among them."""
    texts = np.array([0 if lines[k][2] else len(lines[k][0]) for k in places], np.int64)
    weights = np.array([0 if lines[k][2] else len(lines[k][0]) - lines[k][1] for k in places], np.int64)
    weights = weights if weights.any() else texts  # nothing but links
    found = spans(weights, window, min(surge, _reach(weights, window)))
    if not found:
        return []
    within = {k for a, b in found for k in range(a, b)}
    return [places[k] for k in range(found[0][0], found[-1][1]) if not lines[places[k]][2] and (k in within or weights[k] > 0)]


def _surging_articles(lines: list, window: int, surge: int) -> list[int]:
    """Lines of the articles whose distribution surges, from the first to the last that is not links alone, with the lines of
    the main part right above the first of them."""
    places: dict[int, list[int]] = {}
    for k, line in enumerate(lines):
        if line[3] and not line[2]:
            places.setdefault(line[3], []).append(k)
    weights = {a: np.array([len(lines[k][0]) - lines[k][1] for k in of], np.int64) for a, of in places.items()}
    if not any(w.any() for w in weights.values()):
        weights = {a: np.array([len(lines[k][0]) for k in of], np.int64) for a, of in places.items()}
    reach = {a: _reach(w, window) for a, w in weights.items()}
    enough = max(1, min(surge, max(reach.values())))
    keep = []
    for a, of in places.items():
        if reach[a] >= enough:
            weighty = np.flatnonzero(weights[a])
            keep += of[weighty[0] : weighty[-1] + 1]
    above = []
    for k in range(keep[0] - 1, -1, -1):
        text, linked, apart, article, main = lines[k]
        if apart or article or not main or linked == len(text):
            break
        above.append(k)
    return above[::-1] + keep


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """Main text of one page: white space inside a block is one space, blocks are joined by one."""
    lines = page_lines(page)
    if any(article and not apart for _, _, apart, article, _ in lines):
        keep = _surging_articles(lines, window, surge)
    else:
        main = [k for k, line in enumerate(lines) if line[4]]
        keep = _surging(lines, main if any(not lines[k][2] for k in main) else list(range(len(lines))), window, surge)
    return " ".join(lines[k][0] for k in keep)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """``page_id``, ``url``, ``text`` of every row.  A null or empty page, or one without text, gives an empty text."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(p, window, surge) for p in texts_of(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.selectExpr(f"cast(`{id_col}` as long) page_id", f"cast(`{url_col}` as string) url", f"`{html_col}` html")
    return rows.mapInArrow(extract, "page_id long, url string, text string")
