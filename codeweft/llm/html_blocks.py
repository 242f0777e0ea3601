"""Leaf blocks of a page's DOM: the text between block-level boundaries, with its ancestors.

A tolerant parser for what main-text extraction needs: paragraphs, list items and
table parts close themselves as HTML has it, stray end tags are ignored, comments,
scripts, styles, titles and other text that isn't shown are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|[^<]+|<""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math object select noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr nobr ruby rt rp button".split())
#: Elements that say what they hold.
TELLING = frozenset("article aside footer form header main nav section".split())
#: What a start tag closes first, up to a boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
P_STAYS = frozenset("table td th caption button object html body".split())


@dataclass
class Block:
    """``marks``: features of the ancestors; ``tag``: of the nearest block-level one; ``linked``: characters in links."""

    text: str
    tag: str
    marks: frozenset[str]
    linked: int


def _own(tag: str, attributes: str) -> frozenset[str]:
    out = {"tag:" + tag}
    if attributes:
        for name, value in _ATTR.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                out.add("hidden")
            elif name in ("class", "id", "role"):
                parts = _PART.findall(value)
                out.update("name:" + p for p in parts)
    return frozenset(out)


def _below(marks: frozenset[str], tag: str, own: frozenset[str]) -> frozenset[str]:
    """The marks under an element: those above it and its own, which say what is nearest if they say anything."""
    near = {f"near:{x}" for x in own if not x.startswith("tag:") or tag in TELLING}
    return frozenset(x for x in marks if not x.startswith("near:")) | own | near if near else marks | own


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page in order, empty ones left out."""
    if not html:
        return []
    out: list[Block] = []
    root = ("", frozenset(), "")
    stack: list[tuple[str, frozenset[str], str]] = [root]  # tag, marks so far, nearest block-level tag
    text: list[str] = []
    linked, links, home, known = 0, 0, root, {}

    def flush() -> None:
        nonlocal linked
        if text:
            said = " ".join("".join(text).split())
            if said:
                out.append(Block(said, home[2], home[1], linked))
            text.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal links
        links -= sum(1 for x in stack[k:] if x[0] == "a")
        del stack[k:]

    at, token = 0, _TOKEN.match
    while m := token(html, at):
        at = m.end()
        tag = m[2]
        if tag is None:
            said = m[0]
            if said[0] == "<" and len(said) > 1:
                continue
            if "&" in said:
                said = unescape(said)
            if not text or (said and not said.isspace() and not "".join(text).strip()):
                home = stack[-1]
            text.append(said)
            if links:
                linked += len(said)
            continue
        tag = tag.lower()
        inline = tag in INLINE
        if m[1]:
            if not inline:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if inline and stack[k][0] not in INLINE:
                    break
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(f"</{tag}\\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            if tag not in ("svg", "math", "object", "iframe"):
                continue
            text.append(" ")
            continue
        if tag in VOID:
            if not inline:
                flush()
            elif text or tag == "br":
                text.append(" ") if tag == "br" else None
            continue
        if not inline:
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] in P_STAYS:
                    break
            if tag in CLOSES:
                gone, stop = CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in gone:
                        pop_to(k)
                        break
                    if stack[k][0] in stop:
                        break
        _, marks, block = stack[-1]
        key = (marks, tag, m[3])
        if key not in known:
            known[key] = _below(marks, tag, _own(tag, m[3]))
        stack.append((tag, known[key], block if inline else tag))
        if tag == "a":
            links += 1
    flush()
    return out
