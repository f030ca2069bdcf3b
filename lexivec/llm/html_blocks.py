"""Leaf blocks of web pages: the runs of text between block-level tags, with their ancestors."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: Fixed lists of the HTML standard: elements that break text into blocks, that have no content, whose content is no markup, and whose content is no text.
BLOCK_TAGS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe "
    "legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = {"hr"}
RAW_TAGS = "script|style"
SKIPPED_TAGS = "noscript|template|svg|math|object|canvas|audio|video"
#: An open element of the first name is closed by the start of one of the others.
CLOSED_BY = {
    "p": BLOCK_TAGS - {"button", "option", "optgroup", "legend", "caption"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"},
    "head": {"body"},
}

#: To be used up to the last ">" of a page (closable), so that no tag is looked for an end that does not come.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|(?P<comment>\Z))|<(?P<raw>{RAW_TAGS})(?=[\s/>])[^>]*(?:/>|>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|(?P<content>\Z)))|<(?P<skip>{SKIPPED_TAGS})(?=[\s/>])(?P<rest>(?:\"[^\"<]*\"|'[^'<]*'|[^\"'<>])*+>|[^>]*>)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^\"'<>])*+)>|<[!?/][^>]*>", re.S | re.I
)
_SKIPPED = frozenset(SKIPPED_TAGS.split("|"))
_SKIP = re.compile(rf"<(?:{SKIPPED_TAGS})[\s/>]", re.I)
_NOSCRIPT = re.compile(r"<(/?)noscript(?=[\s/>])[^>]*>", re.I)
_NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


class Element:
    """An open element: what lies in it has numbers from its own to below `end`. The root, number 0, stands for the page."""

    __slots__ = ("end", "names", "number", "parent", "tag")

    def __init__(self, tag: str, names: frozenset[str], number: int, parent: Element | None):
        self.tag, self.names, self.number, self.parent, self.end = tag, names, number, parent, 0

    def holds(self, other: Element) -> bool:
        return self.number <= other.number < self.end


@dataclass
class Block:
    """text has its character references decoded and single spaces; element is the innermost one around it, shared by all
    blocks that lie in it, so that deep pages need no more room than flat ones."""

    text: str
    element: Element
    linked: int  # characters inside links

    @property
    def path(self) -> list[Element]:
        """The elements around the block, outermost first, without the root."""
        out, e = [], self.element
        while e.parent:
            out.append(e)
            e = e.parent
        return out[::-1]


def closable(page: str) -> tuple[str, str]:
    """The page up to its last ">", in which every tag finds an end, and the text after it, where no tag does."""
    at = page.rfind(">") + 1
    return page[:at], page[at:]


def names(attrs: str) -> frozenset[str]:
    found = " ".join(a or b or c for a, b, c in _NAMED.findall(attrs))
    return frozenset(_PART.findall(_CAMEL.sub(r"\1 \2", found).lower()))


def skipped(page: str) -> dict[int, int]:
    """The start and end of each outermost skipped element that is closed before what it lies in; one that is not closed
    loses only its tag, as all that follows would go with it. What is inside noscript are no tags."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    at = 0

    def pop() -> tuple[str, int]:
        opened[stack[-1][0]] -= 1
        return stack.pop()

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        tag = (m["skip"] or m["tag"] or "").lower()
        if tag == "noscript":
            end = not m["close"] and not (m["rest"] or "").endswith("/>") and _NOSCRIPT.search(page, m.end())
            if end and end[1]:
                ends[m.start()] = at = end.end()
        elif m["close"]:
            if opened[tag]:
                while (last := pop())[0] != tag:
                    pass
                if tag in _SKIPPED:
                    ends[last[1]] = m.end()
        elif tag in _SKIPPED or tag in BLOCK_TAGS:
            while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
                pop()
            if tag not in VOID_TAGS and not (m["rest"] or m["attrs"] or "").rstrip(" >").endswith("/"):
                stack.append((tag, m.start()))
                opened[tag] += 1
    return ends


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in page order; those without text are left out. Time and memory grow with the page's length,
    however deep its elements are and whatever is left open."""
    out: list[Block] = []
    root = at_element = Element("", frozenset(), 0, None)
    opened: Counter[str] = Counter()
    n_elements = 0
    parts: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, at_element, linked))
        parts, linked = [], 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            linked += len(text.strip()) * in_link

    def leave() -> str:
        nonlocal at_element
        left, at_element = at_element, at_element.parent
        left.end = n_elements + 1
        opened[left.tag] -= 1
        return left.tag

    head, tail = closable(page)
    ends = skipped(head) if _SKIP.search(head) else {}
    at, lost = 0, False
    for m in _TOKEN.finditer(head):
        if m.start() < at:
            continue
        say(head[at : m.start()])
        at = ends.get(m.start(), m.end())
        tag = (m["tag"] or "").lower()
        if not tag:
            lost = m["comment"] is not None or m["content"] is not None
            continue
        if tag == "a":
            in_link = not m["close"]
        elif tag == "br":
            parts.append(" ")
        if tag not in BLOCK_TAGS:
            continue
        flush()
        if m["close"]:
            if opened[tag]:
                while leave() != tag:
                    pass
            continue
        while tag in CLOSED_BY.get(at_element.tag, ()):
            leave()
        if tag not in VOID_TAGS and not m["attrs"].rstrip().endswith("/"):
            n_elements += 1
            at_element = Element(tag, names(m["attrs"]) if m["attrs"] else frozenset(), n_elements, at_element)
            opened[tag] += 1
    say(head[at:])
    if not lost:  # what follows a comment or script that never ends is part of it
        say(tail.partition("<!--")[0])
    flush()
    while at_element.parent:
        leave()
    root.end = n_elements + 1
    return out
