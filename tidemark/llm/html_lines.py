"""Blocks of text of an HTML page, with what the markup around each says about it."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_NAME = re.compile(r"[A-Za-z]+|\d+")
_SPACE = re.compile(r"\s+")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
#: Elements that never hold the article's text.
OUTSIDE = frozenset("nav menu footer aside form head button dialog".split())
#: Parts of class, id or role that name what isn't the article.
OUTSIDE_NAMES = frozenset(
    "nav navbar navigation menu footer sidebar aside ad ads advert adverts advertisement banner sponsor sponsored promo "
    "cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe signup login share sharing social "
    "related recommended comment comments reply replies disqus breadcrumb breadcrumbs pagination pager widget toolbar "
    "contentinfo complementary search skip".split()
)


@dataclass
class Block:
    text: str
    in_main: bool
    outside: bool


def _names(attrs: str) -> tuple[set[str], bool]:
    names, hidden = set(), False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key in ("class", "id", "role"):
            names.update(_NAME.findall(value))
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    return names, hidden


def blocks(page: str) -> list[Block]:
    """Texts between block-level tags in page order: references decoded, white space made one space, trimmed."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, in main text, outside of it
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                _, main, outside = stack[-1] if stack else ("", False, False)
                out.append(Block(text, main, outside))
            parts.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[1]:
                parts.append(" ")
            continue
        _, main, outside = stack[-1] if stack else ("", False, False)
        if m[2]:
            if any(e[0] == name for e in stack):
                if name not in INLINE or next(e for e in reversed(stack) if e[0] == name)[2] != outside:
                    flush()
                flush_to = max(i for i, e in enumerate(stack) if e[0] == name)
                if name not in INLINE or all(e[0] in INLINE for e in stack[flush_to:]):
                    if name not in INLINE or stack[flush_to][2]:
                        flush()
                    del stack[flush_to:]
            elif name not in INLINE:
                flush()
            continue
        if name in VOID:
            if name == "br":
                parts.append(" ")
            elif name not in INLINE:
                flush()
            continue
        names, hidden = _names(m[4]) if m[4] else (set(), False)
        # <header> is the page's own unless it stands in the article.
        leaves = name in OUTSIDE or hidden or bool(names & OUTSIDE_NAMES) or (name == "header" or "header" in names) and not main
        if name not in INLINE:
            flush()
            while stack and (stack[-1][0] in INLINE or name in ("p", "li", "h1", "h2", "h3", "div", "section", "article") and stack[-1][0] == "p" or name == "li" and stack[-1][0] == "li"):
                stack.pop()
            _, main, outside = stack[-1] if stack else ("", False, False)
        elif leaves and not outside:
            flush()
        if not m[4].rstrip().endswith("/") or name not in INLINE:
            stack.append((name, main or name in MAIN or "main" in names and "role" in m[4].lower(), outside or leaves and name not in MAIN and name not in ("body", "html")))
    tail = page[at:]
    if tail and not tail.lstrip().startswith("<"):
        parts.append(tail)
    flush()
    return out
