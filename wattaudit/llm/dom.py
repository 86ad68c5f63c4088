"""A small HTML tree: elements in page order with their text, tolerant of missing and stray tags."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Fixed by HTML: elements without content, with raw text, and those that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An element that begins ends an open one of these, unless an element of the second set lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_HOLDERS = {"table", "td", "th", "li", "article", "section", "div", "body", "nav", "aside", "footer", "header", "form", "main"}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>"']|"[^"]*"|'[^']*')*))>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S
)
_CLOSING = {tag: re.compile(rf"</{tag}[^>]*>", re.I) for tag in RAW}


@dataclass(slots=True)
class Element:
    """``parent`` is a position in the list of elements, -1 for the page; parents come before their children."""

    tag: str
    attrs: str
    parent: int
    depth: int


@dataclass(slots=True)
class Page:
    """Elements in page order, and pieces of text with the element each lies in; None marks a line break."""

    elements: list[Element] = field(default_factory=list)
    pieces: list[tuple[int, str | None]] = field(default_factory=list)


def parse(html: str) -> Page:
    """Tree of a page. Any text is accepted; comments, declarations and raw text elements hold no text."""
    page, stack, at = Page(), [], 0
    while True:
        m = _TOKEN.search(html, at)
        end = m.start() if m else len(html)
        if end > at:
            page.pieces.append((stack[-1] if stack else -1, html[at:end]))
        if not m:
            return page
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            _close(page, stack, tag)
            continue
        _begin(page, stack, tag)
        if tag == "br":
            page.pieces.append((stack[-1] if stack else -1, None))
        attrs = m[3] if m[2] else m[6]
        page.elements.append(Element(tag, attrs or "", stack[-1] if stack else -1, len(stack)))
        if tag in RAW:
            closing = _CLOSING[tag].search(html, at)
            at = closing.end() if closing else len(html)
        elif tag not in VOID and not (attrs or "").endswith("/"):
            stack.append(len(page.elements) - 1)


def _begin(page: Page, stack: list[int], tag: str) -> None:
    """End what the start of ``tag`` ends."""
    ended, kept = CLOSES.get(tag, ((), ()))
    if tag in BLOCK and tag not in ("body", "html"):
        _end(page, stack, {"p"}, _HOLDERS)
    if ended:
        _end(page, stack, ended, kept)


def _end(page: Page, stack: list[int], ended: set[str], kept: set[str]) -> None:
    for k in range(len(stack) - 1, -1, -1):
        own = page.elements[stack[k]].tag
        if own in ended:
            del stack[k:]
            return
        if own in kept:
            return


def _close(page: Page, stack: list[int], tag: str) -> None:
    """End the innermost open ``tag``; an end tag of an inline element doesn't end blocks around it."""
    for k in range(len(stack) - 1, -1, -1):
        own = page.elements[stack[k]].tag
        if own == tag:
            del stack[k:]
            return
        if tag not in BLOCK and own in BLOCK:
            return
