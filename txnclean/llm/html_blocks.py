"""Leaf blocks of a web page: text runs between block-level tags, with the path of open tags."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# fixed values of the markup language
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas title".split())
CLOSES_ITSELF = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
STOPS = frozenset("ul ol dl table select article section main div aside nav header footer body form".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, ...], ...]   # per open tag: its name and the words of its class, id and role
    linked: int                         # characters inside links


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    if not attributes or "=" not in attributes:
        return (tag,)
    words = [w for m in _NAMES.finditer(attributes) for w in _PART.findall((m[1] or m[2] or m[3] or "").lower())]
    return (tag, *("." + w for w in words))


def blocks(page: str) -> list[Block]:
    """All blocks with text, in page order. Unclosed and stray tags are borne; text outside tags counts."""
    out: list[Block] = []
    stack: list[tuple[str, ...]] = []
    parts: list[str] = []
    path: tuple = ()
    linked, links = 0, 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, path, linked))
            parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal path, linked
        if not parts:
            if text.isspace():
                return
            path = tuple(stack)
        text = html.unescape(text) if "&" in text else text
        parts.append(text)
        if links:
            linked += len(text)

    def close(at: int) -> None:
        nonlocal links
        links -= sum(1 for x in stack[at:] if x[0] == "a")
        del stack[at:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing = tag.lower(), m[1] or m[4]
        if tag not in INLINE:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag == "br":
            parts and parts.append(" ")
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            ends = CLOSES_ITSELF.get(tag, ("p",) if tag in STOPS or tag[0] == "h" else ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    close(k)
                    break
                if stack[k][0] in STOPS:
                    break
        stack.append(_names(tag, m[3] if m[2] else m[6]))
        links += tag == "a"
    flush()
    return out
