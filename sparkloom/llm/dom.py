"""Leaf blocks of HTML pages, with the features that tell main text from the rest.

A page is read once from front to back, in time that grows with its length
whatever its markup: open elements are kept with the places of each tag name,
and the features of all ancestors are carried along with each open element.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Container
from functools import lru_cache
from typing import NamedTuple

#: Elements that begin and end a block of text, those without content, and those whose content is no text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul button textarea".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template annotation annotation-xml".split())
#: Elements that hold no elements; an unclosed one of the second set ends at the next block.
RAW = frozenset("script style title textarea".split())
SHORT_RAW = frozenset("title textarea".split())
#: Elements whose content most readers see only in place of something else.
INSTEAD = frozenset("noscript iframe object video audio canvas svg".split())
#: A new element of the key ends an open one of the values, unless an element of the last set stands between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}, "tbody": {"td", "th", "tr", "thead", "tbody"}, "tfoot": {"td", "th", "tr", "thead", "tbody"}}
FENCES = frozenset("ul ol menu table dl select body article section div main aside nav form".split())
SECTIONS = frozenset("article main nav header footer aside form section div body".split())

_OPEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/><]*)|[!?/])")
_STOP = re.compile(r"""=\s*["']|>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS - SHORT_RAW))})(?=[\s/>])", re.I)
_IN = {t: (f"in:{t}",) for t in BLOCKS | INSTEAD}
_MOST_WORDS = (1, 4, 9, 24, 59)
_WORDS = [f"words:{k}" for k in range(len(_MOST_WORDS) + 1)]
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


class Block(NamedTuple):
    text: str
    features: tuple[str, ...]


def tokens(attributes: str) -> tuple[str, ...]:
    """Words of an element's class, id and role."""
    return _tokens(attributes) if len(attributes) < 300 else _tokens.__wrapped__(attributes)


@lru_cache(4096)
def _tokens(attributes: str) -> tuple[str, ...]:
    return tuple(sorted({t for m in _NAMES.findall(attributes) for t in _TOKEN.findall(m.lower())}))


def shape(text: str, linked: int) -> tuple[str, ...]:
    """Features of a block's text."""
    share = linked / max(1, len(text))
    return (
        _WORDS[bisect_left(_MOST_WORDS, text.count(" ") + 1)],
        "links:0" if not linked else "links:1" if share < 0.3 else "links:2" if share < 0.7 else "links:3",
        "stop:True" if text[-1:] in ".!?…" else "stop:False",
        "upper:True" if text[:1].isupper() else "upper:False",
    )


class Ends:
    """Where the tags of a page end. A quoted value may hold ``>``; a quote that is never closed is an ordinary character."""

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in "\"'>"}
        self.quotes = True

    def of(self, at: int) -> int:
        """The place of the ``>`` that ends the tag read up to ``at``, or -1."""
        if at > self.last[">"]:
            return -1
        begin = at
        while self.quotes:
            m = _STOP.search(self.page, at)
            if m is None:  # all that is left stands in quotes: from here on quotes mean nothing
                self.quotes = False
            elif m[0] == ">":
                return m.start()
            else:
                at = m.end()
                if at <= self.last[m[0][-1]]:
                    at = self.page.index(m[0][-1], at) + 1
        return self.page.find(">", begin)


class Path:
    """The open elements. Of each: its tag, its features, those of it and all above it, and its nearest section."""

    def __init__(self, known: Container[str] | None):
        self.known = known
        self.open: list[tuple[str, tuple[str, ...], tuple[str, ...], str]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.fences: list[int] = []
        self.held: dict[str, int] = {}
        self.links = self.hidden = 0

    def push(self, tag: str, attributes: str) -> None:
        own = _IN.get(tag, ())
        if attributes:
            own += tuple(f"name:{n}" for n in tokens(attributes))
        _, _, above, section = self.open[-1] if self.open else ("", (), (), "none")
        held, known = self.held, self.known
        for f in own:
            held[f] = times = held.get(f, 0) + 1
            if times == 1 and (known is None or f in known):
                above += (f,)
        at = len(self.open)
        self.open.append((tag, own, above, tag if tag in SECTIONS else section))
        self.places[tag].append(at)
        if tag in BLOCKS:
            self.blocks.append(at)
        if tag in FENCES:
            self.fences.append(at)
        self.links += tag == "a"
        self.hidden += tag in HIDDEN

    def cut(self, at: int) -> None:
        """Close all elements from this place on."""
        while len(self.open) > at:
            tag, own, _, _ = self.open.pop()
            self.places[tag].pop()
            for f in own:
                self.held[f] -= 1
            self.links -= tag == "a"
            self.hidden -= tag in HIDDEN
        for marks in (self.blocks, self.fences):
            while marks and marks[-1] >= at:
                marks.pop()

    def close(self, tag: str) -> None:
        """A closing tag; one that closes nothing does nothing. Only those of blocks close beyond a block."""
        if (places := self.places[tag]) and (tag in BLOCKS or not self.blocks or places[-1] > self.blocks[-1]):
            self.cut(places[-1])

    def make_room(self, tag: str) -> None:
        """Close what a new block ends without a closing tag."""
        fence = self.fences[-1] if self.fences else -1
        ended = [p[bisect_right(p, fence)] for t in ("p", *ENDS.get(tag, ())) if (p := self.places[t]) and p[-1] > fence]
        if ended:
            self.cut(min(ended))

    def features(self) -> tuple[str, ...]:
        if not self.open:
            return ("tag:none", "section:none")
        tag, _, above, section = self.open[-1]
        return (f"tag:{tag}", f"section:{section}", *above)


def blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """The leaf blocks of a page in page order. Hidden elements give none; unclosed and stray tags do no harm.

    ``known``: of ancestors' features only these are carried, which bounds them however deep a page is.
    """
    out: list[Block] = []
    path, ends = Path(known), Ends(page)
    never_closed: set[str] = set()
    parts: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append(Block(text, path.features() + shape(text, linked)))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        """A text node: its references are decoded before it is joined to others."""
        nonlocal linked
        if text and not path.hidden:
            parts.append(html.unescape(text) if "&" in text else text)
            if path.links:
                linked += len(text.strip())

    look = 0
    while m := _OPEN.search(page, look):
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            end = len(page) if end < 0 else end + 2
        else:
            end = ends.of(m.end())
            if end < 0:  # no tag ends any more: what is left is text
                look = page.find("<!--", m.end())
                if look < 0:
                    break
                continue
        add(page[at : m.start()])
        at = look = end + 1
        if m[2] is None:
            continue
        tag, attributes = m[2].lower(), page[m.end() : end]
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCKS:
            flush()
        if m[1]:
            path.close(tag)
            continue
        if tag in BLOCKS:
            path.make_room(tag)
        if tag == "body" and path.hidden:  # a head that was never closed
            path.cut(min(p[0] for t in HIDDEN if (p := path.places[t])))
        if tag in EMPTY or attributes.endswith("/"):
            continue
        path.push(tag, attributes)
        if tag in RAW:
            found = None if tag in never_closed else _CLOSE[tag].search(page, at)
            if found is None:
                never_closed.add(tag)
                found = _BLOCK_TAG.search(page, at) if tag in SHORT_RAW else None
            look = found.start() if found else len(page)
            add(page[at:look])
            at = look
            if tag in never_closed:
                path.cut(len(path.open) - 1)
    add(page[at:])
    flush()
    return out
