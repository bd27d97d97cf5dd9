"""Leaf blocks of a page: text between block tags, with its ancestors' features.

The page is read once from front to back, so time grows linearly with it.
Comments, scripts, styles and other raw elements give no text; inline tags
are taken out without a space, block tags and ``br`` separate.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Container
from typing import NamedTuple

# fixed values: elements of HTML
BLOCK = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option output p pre search section select
    summary table tbody td tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("canvas datalist iframe math noembed noframes noscript object script style svg template textarea title xmp".split())
_CLOSED_BY = {  # what a start tag closes when it is open innermost, besides p
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "tbody": {"td", "th", "tr", "thead", "tbody"}, "tfoot": {"td", "th", "tr", "thead", "tbody"},
}
SECTIONS = frozenset("article aside footer form header main nav".split())
PAGE_WIDE = ("t=article", "t=main")  # what a block may stand outside of
_KEEPS_P = frozenset({"button", "label", "option", "optgroup", "select", "output"})

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LAX = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(?:^|(?<=[\s"'/]))([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")  # numbers name nothing


class Block(NamedTuple):
    text: str  # decoded, white space as single spaces
    tag: str  # the innermost block element
    around: frozenset[str]  # features of all its ancestors, and of the nearest that has a name or is a section
    linked: int  # characters inside links, white space counted


def _named(attributes: str) -> list[str]:
    """Features of an element's attributes: words of class and id, roles, whether it is hidden."""
    out = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id", "aria-label"):
            for word in _PART.findall(value):
                word = word.lower()
                out.append("c=" + (word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word))
        elif name in ("role", "itemprop"):
            out += [f"{name}={v.lower()}" for v in value.split()]
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            out.append("hidden")
    return out


def blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """All leaf blocks with text, in page order.

    With ``known``, only such features are kept, so that a deep page's
    ancestors hold no more than there are of these.
    """
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = [("", frozenset())]
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    tag_at, link_from, linked = _TAG, -1, 0
    at, end, size = 0, len(page), 0

    def flush() -> None:
        nonlocal linked, size, link_from
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                tag, around = stack[-1]
                out.append(Block(text, tag, around, linked + (size - link_from if link_from >= 0 else 0)))
            pieces.clear()
        linked, size, link_from = 0, 0, 0 if link_from >= 0 else -1

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            pieces.append(page[at:])
            break
        if lt > at:
            pieces.append(page[at:lt])
            size += lt - at
        if page.startswith("<!--", lt):
            if page.startswith(("<!-->", "<!--->"), lt):
                at = page.index(">", lt) + 1
                continue
            close = page.find("-->", lt + 4)
            at = close + 3 if close >= 0 else end
            continue
        if page.startswith(("<!", "<?"), lt):
            close = page.find(">", lt)
            at = close + 1 if close >= 0 else end
            continue
        found = tag_at.match(page, lt)
        if found is None:
            following = page[lt + 1 : lt + 3].lstrip("/")[:1]
            if not (following.isascii() and following.isalpha()):  # a plain sign
                pieces.append("<")
                size, at = size + 1, lt + 1
                continue
            tag_at = _LAX  # a quote that nothing closes; from here on quotes mean nothing
            found = _LAX.match(page, lt)
            if found is None:  # the page ends inside a tag
                break
        at, name = found.end(), found.group(2).lower()
        if found.group(1):
            if name == "a":
                if link_from >= 0:
                    linked, link_from = linked + size - link_from, -1
            elif name in BLOCK:
                flush()
                if opened[name]:
                    link_from = -1
                    while stack[-1][0] != name:
                        pop()
                    pop()
            continue
        if name in RAW:
            if not found.group(3).endswith("/") or name in ("script", "style"):
                close = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
                if close is None:
                    break
                at = close.start()
                shut = page.find(">", at)
                at = shut + 1 if shut >= 0 else end
            continue
        if name == "br":
            pieces.append(" ")
            size += 1
        elif name == "a":
            if link_from >= 0:
                linked += size - link_from
            link_from = size
        elif name in BLOCK:
            flush()
            link_from = -1
            if name in VOID:
                continue
            closed = _CLOSED_BY.get(name, frozenset())
            while stack[-1][0] in closed or stack[-1][0] == "p" and name not in _KEEPS_P:
                pop()
            around, named = stack[-1][1], _named(found.group(3))
            new = {f"t={name}", *named, *(f"near {f}" for f in named), *([f"in {name}"] if name in SECTIONS else [])}
            if known is not None:
                new = {f for f in new if f in known or f in PAGE_WIDE}
            past = ("near ",) * bool(named) + ("in ",) * (name in SECTIONS)
            inner = frozenset([f for f in around if not f.startswith(past)]) if past else around
            inner = inner if new <= inner else inner | new
            stack.append((name, around if inner == around else inner))
            opened[name] += 1
    flush()
    return out
