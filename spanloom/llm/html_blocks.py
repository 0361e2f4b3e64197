"""Web pages as a sequence of text blocks with their place in the document tree."""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass, field

#: Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
UNSEEN = frozenset("head template svg math canvas object audio video select datalist button noscript map".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An element that opens ends an open one of these just above it.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
#: What elements, roles and words of class and id say about the text inside.
AWAY_TAGS = frozenset("nav footer aside form dialog menu search".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status".split())
AWAY_WORDS = frozenset(
    "ad ads adbox adslot adsense adv advert banner bottombar breadcrumb breadcrumbs byline captcha cc consent cookie cookies copyright disclaimer disqus donate footer gdpr header headline-bar legal login logo "
    "masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popular popup promo rail recommended register related reply replies respond "
    "rss search share sharing sharebar sidebar sidenav signin signup skip skyscraper social sponsor subscribe tags teaser toolbar topbar trending warning widget widgets alert alerts feedback shoutbox".split()
)
AWAY_STEMS = ("advert", "breadcrumb", "comment", "cookie", "footer", "navig", "newsletter", "promot", "recommend", "sidebar", "sponsor", "subscri", "syndicat")
MAIN_WORDS = frozenset("article articlebody content entry main maincontent post prose story storybody text hentry".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*+)>")
_START = re.compile("<[A-Za-z/!?]")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


@dataclass
class Block:
    """A stretch of text between block elements: text, element, characters inside links, what its containers say (see State), and its place."""

    text: str
    tag: str
    linked: int
    state: int
    parent: int
    grand: int
    step: int  # elements left and entered since the block before
    sure: bool  # inside or outside by an element of its own kind, not by a word in a name


#: What containers say: nothing, main text, or something else; and whether an element says so by its kind.
NOTHING, MAIN, AWAY = 0, 1, -1


@functools.lru_cache(maxsize=20_000)
def hint(tag: str, attrs: str) -> tuple[int, bool]:
    """(state, sure) that an element claims for what is inside; a header is judged by the caller."""
    a = {k.lower(): (v[1:-1] if v[:1] in ("'", '"') else v) for k, v in _ATTR.findall(attrs)} if attrs else {}
    if tag in ("html", "body"):
        return NOTHING, False
    role = a.get("role", "").lower()
    if tag in AWAY_TAGS or role in AWAY_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return AWAY, True
    names = [p.lower() for p in _PART.findall(html.unescape(f"{a.get('class', '')} {a.get('id', '')}"))]
    names += [w.lower() for w in re.split(r"[^A-Za-z]+", f"{a.get('class', '')} {a.get('id', '')}") if w]
    if tag == "main" or role == "main" or "articlebody" in a.get("itemprop", "").lower():
        return MAIN, True
    if any(w in AWAY_WORDS or w.startswith(AWAY_STEMS) for w in names):
        return AWAY, False
    if tag == "article" or role == "article":
        return MAIN, True
    if any(w in MAIN_WORDS for w in names):
        return MAIN, False
    return NOTHING, False


def inherited(outer: tuple[int, bool], own: tuple[int, bool], tag: str) -> tuple[int, bool]:
    """State inside an element from that around it and its own claim."""
    if tag == "header" and own[0] == NOTHING:
        return outer if outer[0] else (AWAY, True)
    if own[0] == AWAY:
        return own
    if own[0] == MAIN and (outer[0] != AWAY or tag == "main" and not outer[1]):
        return MAIN, own[1] or outer[1]
    return outer


@dataclass
class _Reader:
    """State of one walk over a page."""

    out: list[Block] = field(default_factory=list)
    stack: list[tuple[str, int, tuple[int, bool]]] = field(default_factory=lambda: [("", 0, (NOTHING, False))])  # element, number, state inside
    count: dict[str, int] = field(default_factory=dict)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    unseen: int = 0  # open elements whose text is never shown
    link: int = 0  # depth of the stack where a link opened, plus one
    n: int = 0
    low: int = 0  # least depth since the last block
    depth: int = 0  # depth of the last block

    def text(self, s: str) -> None:
        if s and not self.unseen:
            s = html.unescape(s) if "&" in s else s
            self.parts.append(s)
            if self.link:
                self.linked += len(s)

    def flush(self) -> None:
        words = "".join(self.parts).split() if self.parts else ()
        if words:
            k, here = len(self.stack), self.stack[-1]
            text = " ".join(words)
            up = self.stack[max(0, k - 2)]
            self.out.append(Block(text, here[0], min(self.linked, len(text)), here[2][0], up[1], self.stack[max(0, k - 3)][1], self.depth + k - 2 * min(self.low, k), here[2][1]))
            self.low = self.depth = k
        self.parts, self.linked = [], 0

    def open(self, tag: str, attrs: str) -> None:
        if tag in UNSEEN:
            self.unseen += 1
        elif tag not in BLOCK:
            return
        self.flush()
        if self.stack[-1][0] == "p" and tag in BLOCK:
            self.pop()
        ends = ENDS.get(tag, ())
        while self.stack[-1][0] in ends:
            self.pop()
        if tag not in VOID:
            self.n += 1
            self.stack.append((tag, self.n, inherited(self.stack[-1][2], hint(tag, attrs), tag)))
            self.count[tag] = self.count.get(tag, 0) + 1

    def pop(self) -> None:
        tag = self.stack.pop()[0]
        self.count[tag] -= 1
        self.unseen -= tag in UNSEEN
        self.low = min(self.low, len(self.stack))
        if self.link > len(self.stack):
            self.link = 0

    def close(self, tag: str) -> None:
        if tag == "p" and not self.count.get("p"):
            self.flush()
        if self.count.get(tag):
            self.flush()
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()


@functools.cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


def blocks(page: str) -> list[Block]:
    """The text blocks of a whole page in its order, each with single spaces and without ends of white space.

    Character references are decoded; scripts, styles, comments, the head and controls of forms hold no text. Tags that are missing, crossed or never closed
    are borne as browsers do; line breaks are white space. Every character is looked at a bounded number of times.
    """
    r, pos, last = _Reader(), 0, page.rfind(">")
    while True:
        lt = page.find("<", pos)
        if lt < 0 or lt > last:  # no tag ends any more: what begins one is left out with the rest
            start = _START.search(page, pos)
            r.text(page[pos : start.start() if start else None])
            break
        r.text(page[pos:lt])
        two = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = lt + 4 if page.startswith(">", lt + 4) else page.find("-->", lt + 4)
            pos = len(page) if end < 0 else end + (1 if page[end] == ">" else 3)
            continue
        if two in "!?" or two == "/" and not page[lt + 2 : lt + 3].isalpha():
            if two:
                pos = page.find(">", lt) + 1
                continue
        m = _TAG.match(page, lt) if two.isascii() and (two.isalpha() or two == "/") else None
        if m is None:
            r.text("<")
            pos = lt + 1
            continue
        pos = m.end()
        closing, tag, attrs = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        tag = tag.lower()
        if closing:
            if tag == "a":
                r.link = 0
            elif tag in BLOCK or tag in UNSEEN:
                r.close(tag)
        elif tag in RAW:
            end = _end_of(tag).search(page, pos)
            if end is None:
                break
            pos = page.find(">", end.end()) + 1 or len(page)
        elif tag == "br":
            r.text("\n")
        elif tag == "a":
            r.link = len(r.stack)
        elif not (attrs.endswith("/") and tag in UNSEEN):
            r.open(tag, attrs)
    r.flush()
    return r.out
