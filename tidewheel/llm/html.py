"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block, with the lengths of their text outside links.
Sums over sliding windows of lines show where text surges and where it dives; the lines
between are kept. Elements only weigh lines: text within an article counts ``MARKED`` times,
that of menus, adverts and the like not at all, and an article's ends are gaps.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

WINDOW = 3
#: Characters in a window from which text surges.
SURGE = 80
#: How often a character within an article counts.
MARKED = 4

# Kinds of elements of HTML.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "head nav header footer aside form button select option dialog noscript template svg math canvas object "
    "audio video menu figure script style textarea title xmp iframe noembed noframes".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
ARTICLE = frozenset(["article", "main"])
#: Words in class, id or role that name what is no part of an article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead "
    "comment comments commentlist disqus replies respond share sharing social related recommended newsletter subscribe "
    "subscription signup login search popup modal overlay widget toolbar pagination pager contentinfo complementary".split()
)
_IN_ARTICLE = NAMES - {"header", "masthead", "banner"}
#: Those that also say so as the first part of a name within an article; others may name its subject there.
_FIRST = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent "
    "comment comments commentlist disqus related recommended newsletter sidebar breadcrumb breadcrumbs".split()
)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PART = re.compile(r"[^A-Za-z]+")


def _named(attrs: str) -> set[str]:
    """The words in an element's class, id and role."""
    found = set()
    for groups in _NAMED.findall(attrs):
        for value in groups:
            if value:
                found.update(_PART.split(_CAMEL.sub(" ", value).lower()))
    return found


def _aside(attrs: str) -> bool:
    """Whether a name within an article says that its element is no part of it: by its last part, or the first of some."""
    for groups in _NAMED.findall(attrs):
        for name in "".join(groups).split():
            parts = [p for p in _PART.split(_CAMEL.sub(" ", name).lower()) if p]
            if parts and (parts[-1] in _IN_ARTICLE or parts[0] in _FIRST):
                return True
    return False


def _after_raw(page: str, name: str, at: int) -> int:
    """Where the content of a raw element that starts at ``at`` ends; the page's end if it is not closed."""
    end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
    return end.end() if end else len(page)


@dataclass(frozen=True)
class Tag:
    """A tag, or the content of a raw element, between two places of a page."""

    name: str
    end: bool
    attrs: str
    start: int
    stop: int


def tags_of(page: str) -> list[Tag]:
    """Tags in order. Comments have no name; nothing within a raw element is a tag."""
    tags = []
    at = 0
    while found := _TAG.search(page, at):
        name = (found["name"] or found["name2"] or "").lower()
        end = bool(found["end"] or found["end2"])
        at = _after_raw(page, name, found.end()) if name in RAW and not end else found.end()
        tags.append(Tag(name, end, found["attrs"] or found["attrs2"] or "", found.start(), at))
    return tags


def ends_of(tags: list[Tag]) -> dict[int, int]:
    """For the elements that start at some of the tags, the tag at which each ends.

    A block ends with its own end tag or that of a block around it, a paragraph also where a
    block starts, other elements with their own end tag only. Elements without an end are not there.
    """
    ends: dict[int, int] = {}
    blocks: list[int] = []
    opened: Counter[str] = Counter()
    others: dict[str, list[int]] = {}
    for i, tag in enumerate(tags):
        if tag.name in BLOCKS:
            if not tag.end:
                if blocks and tags[blocks[-1]].name == "p":
                    ends[blocks.pop()] = i
                    opened["p"] -= 1
                blocks.append(i)
                opened[tag.name] += 1
            elif opened[tag.name]:
                name = ""
                while name != tag.name:
                    last = blocks.pop()
                    name = tags[last].name
                    opened[name] -= 1
                    ends[last] = i
        elif tag.end:
            if others.get(tag.name):
                ends[others[tag.name].pop()] = i
        elif tag.name and tag.name not in VOID and tag.name not in RAW:
            others.setdefault(tag.name, []).append(i)
    return ends


@dataclass(frozen=True)
class Line:
    """A block's text, its weighted length, and whether an article holds it. No text: a gap."""

    text: str
    length: int
    inside: bool


_GAP = Line("", 0, False)


def lines_of(page: str) -> list[Line]:
    """Blocks of a page in order.

    An element that is no part of an article is one gap, or, if it has no end, its first
    block is. It ends where an article begins outside of any; such an article weighs as other text.
    """
    tags = tags_of(page)
    ends = ends_of(tags)
    lines: list[Line] = []
    parts: list[str] = []
    plain = total = 0
    in_link = inside = 0
    lone = False
    aside_until = doubtful_until = -1

    def close():
        nonlocal parts, plain, total, lone
        text = " ".join("".join(parts).split())
        if text:
            marked = inside > 0 and doubtful_until < 0
            lines.append(_GAP if lone else Line(text, MARKED * total if marked else plain, marked))
            lone = False
        parts, plain, total = [], 0, 0

    def add(raw: str):
        nonlocal plain, total
        if raw:
            text = unescape(raw)
            parts.append(text)
            n = len("".join(text.split()))
            total += n
            plain += 0 if in_link else n

    at = 0
    for i, tag in enumerate(tags):
        if aside_until < 0:
            add(page[at : tag.start])
        at = tag.stop
        name = tag.name
        if i == doubtful_until:
            close()
            doubtful_until = -1
        if aside_until >= 0:
            if not tag.end and name in ARTICLE and not inside:
                doubtful_until, aside_until = aside_until, -1
            elif i < aside_until:
                continue
            else:
                aside_until = -1
                if tag.end and name not in ARTICLE:
                    continue
        if not name:
            continue
        if name in BLOCKS:
            close()
        elif name == "br":
            parts.append(" ")
        if tag.end:
            if name in ARTICLE and inside:
                inside -= 1
                if not inside:
                    lines.extend([_GAP] * WINDOW)
            elif name == "a":
                in_link = 0
            continue
        if name in RAW or name in VOID:
            continue
        if name in ARTICLE:
            if not inside:
                lines.extend([_GAP] * WINDOW)
            inside += 1
            in_link = 0
            lone = False
        elif name == "a":
            in_link = 1
        if name not in ("html", "body", *ARTICLE):
            own = name in DROPPED and not (inside and name in ("header", "figure"))
            if own or (_aside(tag.attrs) if inside else _named(tag.attrs) & NAMES) or _HIDDEN.search(tag.attrs):
                if name in BLOCKS and lines and lines[-1].text:
                    lines.append(_GAP)
                if i in ends:
                    aside_until = ends[i]
                elif name in BLOCKS:
                    lone = True
                if name == "a":
                    in_link = 0
    if aside_until < 0:
        add(page[at:])
    close()
    return lines


def extract(page: str | None) -> str:
    """The main text of a page: blocks in page order, joined by an empty line; empty if there is none.

    Text surges in windows of more than ``SURGE`` characters, or more than half the largest
    window where that is smaller, and dives where a window is empty. If the largest window lies
    in an article, text elsewhere surges in windows of more than half of that only. Any text
    within an article surges.
    """
    lines = lines_of(page or "")
    before = [0, *accumulate(line.length for line in lines)]
    sums = [before[min(i + WINDOW, len(lines))] - before[i] for i in range(len(lines))]
    peak = max(sums, default=0)
    top = next((i for i, n in enumerate(sums) if n == peak), 0)
    marked = any(line.inside and line.length for line in lines[top : top + WINDOW])
    outside = peak / 2 if marked else min(SURGE, peak / 2)
    kept, on = [], False
    for i, line in enumerate(lines):
        if not sums[i]:
            on = False
        elif line.length and sums[i] > (0 if line.inside else outside):
            on = True
        if on and line.text:
            kept.append(line.text)
    return "\n\n".join(kept)


def main_text(page: Column) -> Column:
    """Main text of whole pages; empty for null."""

    @pandas_udf("string")
    def of(pages):
        return pages.map(extract)

    return of(F.coalesce(page, F.lit("")))
