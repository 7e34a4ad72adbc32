"""Main text of web pages.

The standard library's streaming parser gives events; they become lines, one a block of
text, each with its characters, tags and linked characters, and the elements around it as a tree of parents.

* Ratio. A line's text-to-tag ratio is its characters over the tags since the line before. Lines of elements that name
  themselves as something else (navigation, footer, advert, comments, ...) have a ratio of 0.
* Smoothing by a Gaussian, then clustering by a threshold, the standard deviation of all smoothed ratios: lines that reach it are content; those
  whose own ratio reaches it too are core lines.
* Region. The smallest element that holds all core lines (a paragraph or inline element: the container around it) is the region; the article
  or main element around it, if there is one, takes its place. Core lines of several articles make each of these articles a region if they hold
  nearly all, else the element around them.
* Every line of a region stays, short ones too, but those whose elements name themselves as something else, and, where no article
  element says what belongs to it, lists of links. There, a title above the region belongs to it, and so do content lines outside that are running text.

Class and id values count by whole names or parts of names that stand for a box (`ad`, `site-footer`, `share-buttons`, not
`notice-of-motion`), on containers only (on paragraphs and their parts, if they name an advert), and not around an article or main element.

Null or empty html, and pages without text, give the empty string and 0; broken or cut-off
markup is read as far as it goes, and an unfinished tag at the end is no text. Work and memory are in proportion to
the page's length, at any depth of elements. Rows are independent: repeated rows give repeated results, ties cannot occur. Columns other than the id, url and html
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_of

# Elements without an end tag, elements that break lines, elements without text of their own, and other things than articles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
SILENT = frozenset("applet audio canvas datalist frameset head iframe map noscript object optgroup option script select style svg template textarea title video".split())
ASIDE = frozenset("aside dialog footer form menu nav search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id values of boilerplate, and words that may follow one in a name.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies discussion discussions disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion promoted related replies reply respond responses search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
BOXES = frozenset("area articles bar block body bottom box button buttons column container content feed footer form group header inner item items left link links list media message nav outer panel posts right row section slot stories text thread top unit widget wrap wrapper".split())
#: Those that can stand for nothing else, so they count on paragraphs and their parts, too.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsored".split())
PIECES = frozenset("a p span".split())
#: Elements whose class and id values count: boxes.
NAMED = frozenset("article aside center div dl fieldset figure footer form header iframe ins li menu nav ol section table td tr ul".split())
#: Elements whose text is an article's, by preference; elements of running text; and elements that may be a region.
ARTICLES = ("article", "main")
PROSE = frozenset("blockquote dd figcaption h1 h2 h3 h4 h5 h6 p pre".split())
CONTAINERS = frozenset("article body center details div fieldset html main section table td".split())
P_ENDERS = BLOCKS - {"body", "html", "head", "td", "th", "tr", "caption", "option", "optgroup"}
P_STOPS = ("article", "main", "section", "div", "td", "th", "li", "body", "blockquote", "table", "button", "object")
SELF_ENDING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS_INSIDE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
WORD = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")
#: Marks of elements: nothing, by class or id, by name, role or attribute.
PLAIN, NAMED_SO, SURELY = range(3)


def names_a_box(value: str, hints: frozenset = HINTS) -> bool:
    """Does one of the names of a class or id value stand for something else than an article?"""
    for name in value.split():
        parts = [w.lower() for w in WORD.findall(CAMEL.sub(r"\1 \2", name))]
        if parts and (parts[-1] in hints or len(parts) > 1 and parts[0] in hints and parts[1] in BOXES):
            return True
    return False


def mark(tag: str, attrs: list) -> int:
    if tag in SILENT or tag in ASIDE:
        return SURELY
    got = PLAIN
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return SURELY
        if not value:
            continue
        if name == "role" and value.strip().lower() in ROLES:
            return SURELY
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return SURELY
        if name in ("class", "id") and (tag in NAMED and names_a_box(value) or tag in PIECES and names_a_box(value, ADVERTS)):
            got = SURELY if tag == "article" else NAMED_SO
    return got


class Lines(HTMLParser):
    """Lines of a page (pieces of text with their elements, tags since the line before, linked characters), and its elements in order of their start."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.marks = [0], ["html"], [PLAIN]  # of each element; 0 is the page
        self.stack = [0]
        self.at: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
        self.blocks: list[int] = []  # of block elements
        self.silent = self.links = 0
        self.lines: list[tuple[list, int, int]] = []
        self.parts: list[tuple[int, str]] = []
        self.tags = self.linked = 0

    def flush(self):
        if self.parts:
            if any(x.strip() for _, x in self.parts):
                self.lines.append((self.parts, self.tags, self.linked))
                self.tags = self.linked = 0
            self.parts = []

    def pop_to(self, i: int):
        for place in range(len(self.stack) - 1, i - 1, -1):
            tag = self.tag[self.stack[place]]
            self.at[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            self.links -= tag == "a"
            self.silent -= tag in SILENT
        del self.stack[i:]

    def innermost(self, names) -> int:
        return max((self.at[x][-1] for x in names if self.at[x]), default=0)

    def close_open(self, names, stops) -> None:
        """End the innermost open element of `names` that no element of `stops` encloses more closely."""
        i = self.innermost(names)
        if i and i >= self.innermost(stops):
            self.pop_to(i)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append((self.stack[-1], " "))
            elif tag == "hr":
                self.flush()
            return
        if tag in BLOCKS:
            self.flush()
            if tag in P_ENDERS:
                self.close_open(("p",), P_STOPS)
            if tag in SELF_ENDING:
                self.close_open(SELF_ENDING[tag], KEEPS_INSIDE[tag])
        self.at[tag].append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.links += tag == "a"
        self.silent += tag in SILENT
        self.parent.append(self.stack[-1])
        self.stack.append(len(self.tag))
        self.tag.append(tag)
        self.marks.append(mark(tag, attrs))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        i = self.at[tag][-1] if self.at.get(tag) else 0
        if i and (tag in BLOCKS or not self.blocks or i > self.blocks[-1]):  # an inline end tag doesn't end blocks
            self.pop_to(i)

    def handle_data(self, data):
        if self.silent:
            return
        self.parts.append((self.stack[-1], data))
        if self.links:
            self.linked += len(data)

    def bad(self) -> list[bool]:
        """Which elements are something else than an article, or in such an element."""
        n = len(self.tag)
        holds, inside, out = [False] * n, [False] * n, [False] * n
        for e in range(n - 1, 0, -1):
            if (holds[e] or self.tag[e] in ARTICLES) and self.marks[e] != SURELY:
                holds[self.parent[e]] = True
        for e in range(1, n):
            up, tag = self.parent[e], self.tag[e]
            inside[e] = inside[up] or tag in ARTICLES
            out[e] = out[up] or self.marks[e] == SURELY or (self.marks[e] == NAMED_SO and not holds[e]) or (tag == "header" and not inside[e])
        return out


def smoothed(ratio: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is cut and scaled."""
    r = int(np.ceil(3 * sigma))
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return np.convolve(ratio, kernel)[r : r + len(ratio)] / np.convolve(np.ones(len(ratio)), kernel)[r : r + len(ratio)]


def content_lines(ratio: np.ndarray, sigma: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Threshold clustering: lines whose smoothed ratio reaches the standard deviation; and of these the core, whose own does too."""
    s = smoothed(ratio, sigma)
    least = min(s.std(), s[ratio > 0].max(initial=0))
    content = (s >= least) & (ratio > 0)
    core = content & (ratio >= least)
    return content, core if core.any() else content


def regions(p: Lines, bad: list[bool], where: list[int], weight: np.ndarray) -> tuple[set[int], bool]:
    """The elements that hold the core lines (`weight` characters at the element `where`, 0 for other lines), and whether they are articles."""
    n = len(p.tag)
    mass, total = [0.0] * n, float(weight.sum())
    for e, w in zip(where, weight.tolist(), strict=True):
        mass[e] += w
    for e in range(n - 1, 0, -1):
        mass[p.parent[e]] += mass[e]
    e = max(i for i in range(n) if mass[i] >= total - 1e-6)  # of elements that hold all, the last to start
    around = e
    while around and p.tag[around] not in ARTICLES:
        around = p.parent[around]
    if around:
        return {around}, True
    for kind in ARTICLES:
        outer, held = [False] * n, set()
        for i in range(1, n):
            outer[i] = outer[p.parent[i]] or p.tag[i] == kind
            if p.tag[i] == kind and not outer[p.parent[i]] and not bad[i] and mass[i]:
                held.add(i)
        if held and sum(mass[i] for i in held) >= 0.9 * total:
            return held, True
    while e and p.tag[e] not in CONTAINERS:
        e = p.parent[e]
    return {e}, False


def extract(html: str | None, sigma: float = 1.0) -> str:
    """The blocks of the content regions joined by line ends."""
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    if re.match(r"<[A-Za-z/!?]", p.rawdata):
        p.rawdata = ""  # an unfinished tag
    p.close()
    p.flush()
    if not p.lines:
        return ""
    bad = p.bad()
    texts, where, tags, linked = [], [], [], []
    for parts, n, a in p.lines:
        good = [x for x in parts if not bad[x[0]]]
        text = " ".join("".join(x for _, x in good).split())
        texts.append(text)
        where.append(next((e for e, x in good if x.strip()), parts[0][0]))
        tags.append(max(1, n))
        linked.append(a)
    size = np.fromiter(map(len, texts), float, len(texts))
    content, core = content_lines(size / tags, sigma)
    if not content.any():
        return ""
    held, sure = regions(p, bad, where, size * core)
    inside = [False] * len(p.tag)
    for e in range(len(p.tag)):
        inside[e] = e in held or (e > 0 and inside[p.parent[e]])
    if sure:
        return "\n".join(x for x, e in zip(texts, where, strict=True) if x and inside[e])
    titled, first = [False] * len(p.tag), next(i for i, e in enumerate(where) if inside[e] and size[i])
    for e in range(1, len(p.tag)):
        titled[e] = titled[p.parent[e]] or p.tag[e] == "h1"
    prose = [False] * len(p.tag)
    for e in range(1, len(p.tag)):
        prose[e] = p.tag[e] in PROSE or prose[p.parent[e]] and p.tag[e] not in BLOCKS
    belongs = lambda i, e: inside[e] or titled[e] and i < first or content[i] and prose[e] and linked[i] < 0.5 * size[i]
    # a line that is nearly all links, and no content by its ratio, is a menu's
    kept = [x for i, (x, e) in enumerate(zip(texts, where, strict=True)) if x and belongs(i, e) and (core[i] or linked[i] < 0.8 * size[i])]
    return "\n".join(kept)


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = 1.0) -> DataFrame:
    """id, url, text and n_chars of each page."""

    def one(b):
        text = [extract(x, sigma) for x in b.column("html").to_pylist()]
        return {"id": b.column("id"), "url": b.column("url"), "text": text, "n_chars": [len(x) for x in text]}

    kind = df.schema[id_col].dataType.simpleString()
    got = map_arrow(df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_of(html_col).alias("html")), one, f"id {kind}, url string, text string, n_chars long", "html", 1 << 20)
    return got.toDF(id_col, url_col, "text", "n_chars")


def op1(spark, pages: DataFrame) -> DataFrame:
    return extract_pages(pages)
