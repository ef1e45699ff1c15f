"""Text blocks of a web page: a tolerant, linear scan of its markup.

A block is the text between two block-level tags, with its character references
decoded and its white space folded; inline tags and ``<br>`` stay inside a block.
Comments, declarations and the contents of scripts, styles and other elements
that are never shown as text give no block. Unclosed and stray tags are taken as browsers take
them, roughly: a ``<p>`` ends the one before, an end tag without a start is passed over,
a tag or comment without an end swallows the rest of the page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

# Elements whose content is no text of the page.
UNSHOWN = frozenset("script style title template iframe noscript noembed noframes xmp textarea svg object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr br".split())
# A start tag of the key ends an open element of the value.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",)} | {
    t: ("p",) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre "
                       "section table ul".split()}
# Elements that such an implied end does not reach beyond.
SCOPES = frozenset("article aside blockquote body div dl fieldset footer form header main nav ol section table td th ul".split())
# Ancestors that make up a block's path: the nearest, and the outermost.
NEAR, FAR = 16, 8

_SIMPLE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\s*>")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s=>/][^\s=>/]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
_ENDS_OF = {name: re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I) for name in UNSHOWN}


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[str, ...]  # tokens of tags, classes, ids and roles from the outermost element inwards
    own: str  # the innermost block element
    linked: int  # characters inside links


def _tokens(name: str, attributes: str | None) -> tuple[str, ...]:
    if not attributes:
        return (name,)
    found = [name]
    for m in _ATTRIBUTE.finditer(attributes):
        key = m.group(1).lower()
        if key in ("class", "id", "role"):
            value = m.group(2) or m.group(3) or m.group(4) or ""
            found += ["." + part.lower() for part in _PARTS.findall(value)]
    return tuple(dict.fromkeys(found))[:12]


def _tag_end(html: str, at: int) -> int:
    """Position behind the ``>`` of the tag whose attributes begin at ``at``; -1 without one."""
    n = len(html)
    while at < n:
        if html[at] == ">":
            return at + 1
        m = _ATTRIBUTE.match(html, at)
        at = m.end() if m and m.end() > at else at + 1
    return -1


def blocks_of(html: str) -> list[Block]:
    """The page's blocks in order; none for an empty page."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    open_count: dict[str, int] = {}
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                near = stack if len(stack) <= NEAR + FAR else stack[:FAR] + stack[-NEAR:]
                path = tuple(t for _, tokens in near for t in tokens)
                own = next((name for name, _ in reversed(near) if name not in INLINE), "")
                found.append(Block(text, path, own, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop_to(name: str) -> None:
        while stack:
            gone = stack.pop()[0]
            open_count[gone] -= 1
            if gone == name:
                break

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text = unescape(html[at:lt])
            parts.append(text)
            if open_count.get("a"):
                linked += len(text.strip())
        if lt == n:
            break
        simple = _SIMPLE.match(html, lt)
        if simple:
            closing, name, attributes, at = simple.group(1), simple.group(2).lower(), None, simple.end()
        else:
            follows = html[lt + 1:lt + 2]
            if follows in ("!", "?"):
                comment = html.startswith("<!--", lt)
                end = html.find("-->" if comment else ">", lt + (4 if comment else 2))
                if comment and html.startswith((">", "->"), lt + 4):
                    end, comment = html.find(">", lt + 4), False
                at = n if end < 0 else end + (3 if comment else 1)
                continue
            m = _NAME.match(html, lt)
            if not m:
                if follows == "/":  # a bogus comment
                    end = html.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    parts.append("<")
                    at = lt + 1
                continue
            end = _tag_end(html, m.end())
            if end < 0:
                break
            closing, name, attributes, at = html[lt + 1] == "/", m.group(1).lower(), html[m.end():end - 1], end
        if closing:
            if name not in INLINE:
                flush()
            if open_count.get(name):
                pop_to(name)
            continue
        if name in UNSHOWN:
            end = _ENDS_OF[name].search(html, at)
            at = end.end() if end else n
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
            for over in ENDS.get(name, ()):
                if open_count.get(over):
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == over:
                            pop_to(over)
                            break
                        if stack[k][0] in SCOPES and stack[k][0] != over:
                            break
        if name not in VOID:
            stack.append((name, _tokens(name, attributes)))
            open_count[name] = open_count.get(name, 0) + 1
    flush()
    return found
