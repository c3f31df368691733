"""Flat text blocks of a web page, each with what its place and its neighbours tell.

The page is read once, tag by tag, whole and however broken. Text between two block boundaries is a block. Open elements are held on a stack, so a block knows
whether it stands in an article, in something that is not the article's text (menus, notices, comments), in a link, or in what no
reader sees. End tags that nothing opened are skipped; elements that nothing closed end with the one around them, and paragraphs, items and cells with the next one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

#: Where a block stands, from comments and menus (which an article around or within doesn't redeem) to an article.
NEVER, OUTSIDE, OPEN, LIKELY, ARTICLE = -2, -1, 0, 1, 2

_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: What these hold is text for programs: it ends at their own end tag only.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
_UNSEEN = frozenset("head noscript template svg math select datalist button object canvas audio video dialog".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr label output".split())
_ELEMENTS = {"article": ARTICLE, "main": ARTICLE, "nav": NEVER, "aside": NEVER, "footer": NEVER, "menu": NEVER, "form": OUTSIDE, "address": OUTSIDE}
_ROLES = {"main": ARTICLE, "article": ARTICLE, "navigation": NEVER, "banner": NEVER, "contentinfo": NEVER, "complementary": NEVER, "search": NEVER, "dialog": NEVER, "alertdialog": NEVER, "alert": OUTSIDE, "form": OUTSIDE, "menu": NEVER, "menubar": NEVER}
#: Words in classes and ids.
_NAMES = dict.fromkeys("comment comments commentlist reply replies respond discussion disqus related recommended recommendations recirculation trending popular sidebar side rail widget widgets nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager footer".split(), NEVER)
_NAMES |= dict.fromkeys(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promoted promotion banner header masthead topbar toolbar cookie cookies consent gdpr ccpa notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login signin search share sharing social follow tags taglist copyright legal disclaimer form print skip tracking teaser teasers foot".split(), OUTSIDE,
)
_LIKELY = frozenset("article post entry story content main prose maincontent articlebody postbody".split())
#: Which open elements a start tag ends, and where the search for them stops.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
_HEADINGS = frozenset(f"h{k}" for k in range(1, 7))

_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+)>")
_QUOTED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_TOLD = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|hidden|itemprop|data-label)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_HINT = re.compile(r"class|id|role|style|hidden|itemprop|data-label", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[^a-z]+")
_GONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    zone: int
    heading: bool
    label: str | None  # of pages that are labelled


@dataclass(slots=True)
class _Element:
    name: str
    zone: int
    unseen: bool
    link: bool
    heading: bool
    label: str | None


def _names_zone(value: str) -> int | None:
    words = _SPLIT.split(_CAMEL.sub(" ", value).lower())
    found = [z for w in words if (z := _NAMES.get(w)) is not None]
    if found:
        return min(found)
    return LIKELY if not _LIKELY.isdisjoint(words) else None


def _opened(name: str, attributes: str, up: _Element) -> _Element:
    zone, unseen, label = None, up.unseen or name in _UNSEEN, up.label
    own = _ELEMENTS.get(name)
    if name == "header" and up.zone < LIKELY:
        own = OUTSIDE
    if attributes and name not in ("html", "body") and _HINT.search(attributes):
        for key, value in _TOLD.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or key == "style" and _GONE.search(value):
                unseen = True
            elif key == "role":
                zone = _ROLES.get(value.lower(), zone)
            elif key == "itemprop":
                zone = ARTICLE if value.lower() == "articlebody" else zone
            elif key == "data-label":
                label = value
            elif key in ("class", "id") and (named := _names_zone(value)) is not None:
                zone = named if zone is None else min(zone, named)
    if own is not None and (zone is None or zone >= OPEN or own < zone):
        zone = own  # an element's own meaning stands, unless its names say it isn't the text
    if zone is None or up.zone == NEVER or up.zone == ARTICLE and zone == LIKELY or up.zone == OUTSIDE and zone in (OUTSIDE, LIKELY):
        zone = up.zone
    return _Element(name, zone, unseen, up.link or name == "a", up.heading or name in _HEADINGS, label)


class _Page:
    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack = [_Element("", OPEN, False, False, False, None)]
        self.pieces: list[str] = []
        self.linked: list[str] = []

    def flush(self) -> None:
        """Ends the block."""
        if self.pieces:
            words = unescape("".join(self.pieces)).split()
            if words:
                top = self.stack[-1]
                linked = len(unescape(" ".join(self.linked)).split()) if self.linked else 0
                self.blocks.append(Block(" ".join(words), len(words), min(linked, len(words)), top.zone, top.heading, top.label))
            self.pieces, self.linked = [], []

    def text(self, text: str) -> None:
        top = self.stack[-1]
        if not top.unseen:
            self.pieces.append(text)
            if top.link:
                self.linked.append(text)

    def cut(self, to: int) -> None:
        """Ends all elements from place ``to`` of the stack on."""
        gone, left = self.stack[to:], self.stack[to - 1]
        if any(e.name not in _INLINE for e in gone) or gone[-1].zone != left.zone or gone[-1].label != left.label:
            self.flush()
        del self.stack[to:]

    def end(self, name: str) -> None:
        inline = name in _INLINE
        for k in range(len(self.stack) - 1, 0, -1):
            open_ = self.stack[k].name
            if open_ == name:
                self.cut(k)
                return
            if inline and open_ not in _INLINE:
                return
        if not inline:
            self.flush()

    def begin(self, name: str, attributes: str) -> None:
        stack = self.stack
        if name in _VOID:
            if name == "br":
                self.text(" ")
            elif name == "hr":
                self.flush()
            return
        if name == "a":
            self.end("a")
        elif name not in _INLINE:
            ends, stop = _ENDS.get(name, (None, None))
            for k in range(len(stack) - 1, 0, -1):
                open_ = stack[k].name
                if ends and open_ in ends or open_ == "p" or open_ in _HEADINGS and name in _HEADINGS:
                    self.cut(k)
                    if not ends or open_ in ends:
                        break
                elif ends and open_ in stop or not ends and open_ not in _INLINE:
                    break
        up = stack[-1]
        new = _opened(name, attributes, up)
        if name not in _INLINE or new.zone != up.zone or new.label != up.label:
            self.flush()
        stack.append(new)


def blocks(html: str) -> list[Block]:
    """The blocks of a page that hold words, in page order. White space within a block is one space each, character references are decoded."""
    page = _Page()
    at, tag = 0, _QUOTED
    while True:
        less = html.find("<", at)
        if less < 0:
            page.text(html[at:])
            break
        if less > at:
            page.text(html[at:less])
        after = html[less + 1 : less + 2]
        if after == "!" or after == "?":
            if html.startswith("<!--", less):
                end = html.find("-->", less + 2)
                at = end + 3 if end >= 0 else len(html)
            else:
                end = html.find(">", less)
                at = end + 1 if end >= 0 else len(html)
            continue
        found = _PLAIN.match(html, less) or tag.match(html, less)
        if not found:
            if not (after.isascii() and after.isalpha()) and not (after == "/" and html[less + 2 : less + 3].isalpha()):
                page.text("<")
                at = less + 1
                continue
            end = html.find(">", less)  # a quote that nothing ends: from here on, tags end at the first bracket
            if end < 0:
                break
            tag = _PLAIN
            name = re.split(r"[\s/>]", html[less + 1 : end].lstrip("/"), maxsplit=1)[0]
            slash, attributes, at = ("/" if after == "/" else ""), "", end + 1
        else:
            slash, name, attributes = found.groups()
            at = found.end()
        name = name.lower()
        if slash:
            page.end(name)
        elif name in _RAW:
            if name in ("textarea", "iframe", "xmp", "plaintext"):
                page.flush()
            close = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(html, at) if name != "plaintext" else None
            end = html.find(">", close.end()) if close else -1
            at = end + 1 if end >= 0 else len(html)
        else:
            page.begin(name, attributes)
            if attributes.endswith("/") and name not in _VOID and name in ("svg", "math", "object"):
                page.end(name)
    page.flush()
    return page.blocks
