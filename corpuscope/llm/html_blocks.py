"""Text blocks of a web page, each with its root-to-leaf path of block elements.

The tag stream is read once with a stack of open elements: paragraphs, items and cells that HTML
lets end without a tag are closed where it says so, end tags without a start end a block, comments,
scripts and styles hold no text, names are matched in any case, and attribute values may be quoted,
bare or broken.  Inline elements are not part of a path; they neither start nor end a block.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

# -- fixed values: what HTML says of its elements, and what sites call the parts around a text --
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math object audio video canvas".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element that ends open ones of these names, up to one of the second names.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody"]), frozenset(["table"])),
}
CELLS = frozenset("td th table caption".split())
AROUND_TAGS = frozenset("head nav footer aside button select dialog menu".split())
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
AROUND_NAMES = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|billboard|nav|navbar|navigation|menu\w*|breadcrumbs?|side-?bar|"
    r"footer|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|notification|popup|modal|overlay|newsletter|subscri\w+|signup|login|"
    r"share|sharing|social|comments?|comment-?list|commentlist|disqus|respond|replies|related|recommend\w*|widget|pagination|pager|"
    r"search|skip|copyright|disclaimer|paywall)(?![a-z])")
HEADER_NAMES = re.compile(r"(?<![a-z])header(?![a-z])")
ARTICLE_NAMES = re.compile(r"(?<![a-z])(?:article|post|entry|story|content|main|text|body|page)(?![a-z])")
NOT_A_PART = re.compile(r"(?<![a-z])(?:with|has|no|without)(?![a-z])")

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>?|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>?|"
    r"<(?P<start>[a-zA-Z][^\s/>]*+)"
    r"(?P<attributes>(?:[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+|[\s/=]++)*+)>?", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role|itemprop|hidden|aria-hidden|style)"
                       r"(?![^\s/=])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.I)
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

#: Why an element's text is left out.
KEPT, FORM, HEADER, AROUND = range(4)


@dataclass(slots=True)
class Element:
    tag: str
    path: int  # number of its path of block elements
    out: int  # why its text is left out
    region: int  # number of the article it lies in, or -1
    link: bool


@dataclass(slots=True)
class Block:
    path: int
    region: int
    text: str
    linked: int  # code points inside links
    heading: bool


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    paths: dict[tuple[int, str], int] = field(default_factory=dict)
    parents: list[int] = field(default_factory=lambda: [-1])
    ranks: list[int] = field(default_factory=list)  # of each region: 2 an article, 1 a main part


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip() else {}


def _names(values: dict[str, str]) -> list[str]:
    return [CAMEL.sub("-", name).lower() for name in f"{values.get('class', '')} {values.get('id', '')}".split()]


def _left_out(tag: str, values: dict[str, str], names: list[str], inside: bool) -> int:
    role = values.get("role", "").lower()
    if tag in AROUND_TAGS or role in AROUND_ROLES or "hidden" in values and values["hidden"].lower() != "until-found":
        return AROUND
    if values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", values.get("style", ""), re.I):
        return AROUND
    if tag in ("html", "body", "main"):
        return KEPT
    for name in names:
        if AROUND_NAMES.search(name) and not NOT_A_PART.search(name):
            return AROUND
        if HEADER_NAMES.search(name) and not ARTICLE_NAMES.search(name) and tag not in HEADINGS and not inside:
            return HEADER
    if tag == "form":
        return FORM
    return HEADER if tag == "header" else KEPT


def _rank(tag: str, values: dict[str, str], names: list[str]) -> int:
    if tag == "article" or values.get("itemprop", "").lower() == "articlebody" or values.get("role", "").lower() == "article":
        return 2
    return int(tag == "main" or values.get("role", "").lower() == "main")


def blocks_of(html: str) -> Page:
    """The blocks of a page that lie in no part which is around its text by name."""
    page = Page()
    stack = [Element("", 0, KEPT, -1, False)]
    open_tags: Counter[str] = Counter()  # so that the stack is searched only for what is open
    parts: list[tuple[str, bool]] = []

    def flush() -> None:
        if parts:
            words = "".join(p for p, _ in parts).split()
            if words:
                top = stack[-1]
                linked = sum(len("".join(p.split())) for p, link in parts if link)
                page.blocks.append(Block(top.path, top.region, " ".join(words), linked,
                                         any(e.tag in HEADINGS for e in stack[-3:])))
            parts.clear()

    def pop_to(depth: int) -> None:
        """Open elements beyond ``depth`` end; the block ends if one of them is a block element."""
        ended = [e.tag for e in stack[depth:]]
        if not INLINE.issuperset(ended):
            flush()
        open_tags.subtract(ended)
        del stack[depth:]

    def put(element: Element) -> None:
        stack.append(element)
        open_tags[element.tag] += 1

    def find(names, limits) -> int | None:
        if not any(open_tags[name] for name in names):
            return None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                return k
            if stack[k].tag in limits:
                return None
        return None

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        to = m.start() if m else n
        if to > at and stack[-1].out == KEPT:
            parts.append((unescape(html[at:to]), stack[-1].link))
        if not m:
            break
        at = m.end()
        if m["end"]:
            tag = m["end"].lower()
            k = find((tag,), () if tag in CELLS or tag in ("body", "html") else CELLS)
            if k is not None:
                pop_to(k)
            elif tag not in INLINE:
                flush()
            elif tag == "br":
                parts.append((" ", False))
        elif m["start"]:
            tag = m["start"].lower()
            if tag in ("br", "wbr", "img"):
                if stack[-1].out == KEPT and tag == "br":
                    parts.append((" ", False))
                continue
            if tag in RAW:
                if not m["attributes"].endswith("/") or tag in ("script", "style"):
                    close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
                    at = close.end() if close else n
                continue
            top = stack[-1]
            if tag in INLINE:
                if tag == "a" and (k := find(("a",), CELLS)) is not None and all(e.tag in INLINE for e in stack[k:]):
                    pop_to(k)
                values = _attributes(m["attributes"])
                out = top.out or (_left_out(tag, values, _names(values), True) if values else KEPT)
                put(Element(tag, stack[-1].path, out, stack[-1].region, stack[-1].link or tag == "a"))
                continue
            if tag in ENDS:
                k = find(*ENDS[tag])
                if k is not None:
                    pop_to(k)
            if (k := find(("p",), CELLS)) is not None and tag not in VOID - {"hr"}:
                pop_to(k)
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                pop_to(len(stack) - 1)
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            flush()
            top = stack[-1]
            values = _attributes(m["attributes"])
            names, rank = _names(values), _rank(tag, values, _names(values))
            out = _left_out(tag, values, names, top.region >= 0)
            if top.out == FORM and rank or top.out == HEADER and top.region >= 0 and tag in HEADINGS:
                pass  # the text's own form or title
            else:
                out = max(top.out, out)
            region = top.region
            if rank and out == KEPT and (region < 0 or rank > page.ranks[region]):
                region = len(page.ranks)
                page.ranks.append(rank)
            step = (top.path, f"{tag}.{'.'.join(names)}")
            if step not in page.paths:
                page.paths[step] = len(page.parents)
                page.parents.append(top.path)
            put(Element(tag, page.paths[step], out, region, top.link))
    flush()
    return page
