"""HTML as pieces of text over a tree of structural elements, read in one pass that is linear in the page.

An element of the tree is told apart by its parent, its name and class words, and its number among equal siblings. Its
token is a hash of these, so that a path of any depth costs one number.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from html import unescape

import xxhash

# Element names by what they do.
STRUCTURE = frozenset(
    "html head body div nav article section main header footer aside form ul ol table dialog menu figure details "
    "fieldset noscript template iframe svg button select object video audio canvas".split()
)
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6".split())
BLOCKS = STRUCTURE | LEAVES | frozenset("li tr blockquote pre dl dt dd figcaption hr address summary caption thead tbody tfoot".split())
RAW = frozenset("script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head noscript template iframe svg button select object video audio canvas".split())
ASIDE_ELEMENTS = frozenset("nav footer aside form dialog menu".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo banner menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar footer header masthead comment comments disqus reply replies cookie cookies consent notice newsletter subscribe "
    "social share sharing related recommended popup modal pagination login copyright".split()
)
ARTICLE_WORDS = frozenset("article entry post story".split())
"""Names such as entry-header are of the article."""
STATES = frozenset("has with no without is not open closed on off enabled disabled active".split())
"""Names such as has-sidebar and comments-open speak of the page, not of the element."""

PLAIN, ARTICLE, ASIDE, HIDDEN = range(4)
"""What an element says of itself."""

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_PLAIN_PART = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"""([a-zA-Z:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NOTABLE = re.compile(r"class|id|role|itemprop|hidden|style", re.IGNORECASE)
_NUMBERS = re.compile(r"\d+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}


def attributes(rest: str) -> dict[str, str]:
    if not _NOTABLE.search(rest):
        return {}
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)}


def signature(name: str, at: dict[str, str]) -> str:
    """Name, class words, id and role; numbers are dropped, so that ids in names don't part alike elements."""
    words = sorted({_NUMBERS.sub("", w.lower()) for w in (at.get("class", "") + " " + at.get("id", "")).split()} - {""})
    return ".".join([name, *words, *(f"@{at[k].lower()}" for k in ("role", "itemprop") if k in at)])


def _aside_word(names: str) -> bool:
    for one in names.lower().split():
        w = [x for x in re.split(r"[^a-z]+", one) if x]
        if w and not STATES & {w[0], w[-1]} and w[0] not in ARTICLE_WORDS and ASIDE_WORDS & {w[0], w[-1]}:
            return True
    return False


def kind_of(name: str, at: dict[str, str], inside: bool) -> int:
    """inside: of an article or of the page's main part, whose headers are their own."""
    own = at.get("role", "").lower()
    if name in UNSEEN or "hidden" in at or at.get("aria-hidden") == "true" or _NOT_SHOWN.search(at.get("style", "")):
        return HIDDEN
    if name == "article" or own == "article" or at.get("itemprop", "") == "articleBody":
        return ARTICLE
    if name in ("html", "body"):
        return PLAIN
    if name in ASIDE_ELEMENTS or (name == "header" and not inside) or own in ASIDE_ROLES or _aside_word(at.get("class", "")) or _aside_word(at.get("id", "")):
        return ASIDE
    return PLAIN


def _tag(html: str, at: int) -> tuple[bool, str, str, int, bool] | None:
    """(end tag, name, attributes, place behind it, closed) of the tag that starts here; None if none does.

    A quote that is never closed counts as an ordinary character, and a tag that is never closed ends with the page."""
    m = _TAG.match(html, at)
    if m:
        return bool(m[1]), m[2].lower(), m[3], m.end(), True
    m = _NAME.match(html, at)
    if not m:
        return None
    i, n = m.end(), len(html)
    while i < n:
        i = _PLAIN_PART.match(html, i).end()
        if i >= n or html[i] == ">":
            break
        end = html.find(html[i], i + 1)
        i = end + 1 if end >= 0 else i + 1
    return bool(m[1]), m[2].lower(), html[m.end() : i], min(i + 1, n), i < n


@dataclass
class Element:
    token: int
    parent: int
    """Place of the parent in Page.elements; of the root, itself."""
    kind: int = PLAIN
    n: int = 1
    place: int = 0
    chars: int = 0
    linked: int = 0
    text: int = 0
    """Running CRC of the text directly in it."""
    like: int = 0
    """Token of the first of its equal siblings."""


@dataclass
class Page:
    """elements: the tree, a row for each token, the root first. others: number and parent of tokens of start tags that
    are not structural. pieces: (element, text), with element -1 at the edge of a block."""

    html: str
    elements: list[Element] = field(default_factory=lambda: [Element(0, 0)])
    others: dict[int, list[int]] = field(default_factory=dict)
    pieces: list[tuple[int, str]] = field(default_factory=list)

    def __post_init__(self):
        html, n = self.html, len(self.html)
        elements, pieces = self.elements, self.pieces
        names, path, seen = [""], [0], [{}]  # open elements: name, place in elements, equal children so far
        open_: dict[str, int] = {}
        known: dict[int, int] = {0: 0}
        links = place = at = 0

        def pop():
            open_[names.pop()] -= 1
            path.pop()
            seen.pop()

        while at < n:
            start = html.find("<", at)
            tag = _tag(html, at) if start == at else None
            if tag is None:
                if start == at and html[at + 1 : at + 2] in ("!", "?"):
                    comment = html.startswith("<!--", at)
                    end = html.find("-->" if comment else ">", at + 2)
                    at = n if end < 0 else end + (3 if comment else 1)
                    continue
                end = html.find("<", at + 1)
                end = n if end < 0 else end
                text = html[at:end]
                text = unescape(text) if "&" in text else text
                at = end
                pieces.append((path[-1], text))
                if not text.isspace():
                    e = elements[path[-1]]
                    e.chars += len(text)
                    e.linked += len(text) if links else 0
                    e.text = zlib.crc32(text.encode("utf-8", "replace"), e.text)
                continue
            ends, name, rest, at, closed = tag
            if not closed:
                continue
            if ends:
                if name == "a":
                    links = max(0, links - 1)
                if name in BLOCKS:
                    links = 0
                    pieces.append((-1, ""))
                if open_.get(name):
                    while names[-1] != name:
                        pop()
                    pop()
                continue
            if name in RAW:
                close = _CLOSE[name].search(html, at)
                at = close.end() if close else n
                continue
            own = attributes(rest) if rest else {}
            if name in BLOCKS:
                links = 0
                pieces.append((-1, ""))
                while names[-1] in LEAVES or names[-1] == name == "li":
                    pop()
            sign = signature(name, own) if own else name
            place += 1
            if (name in STRUCTURE or (own and name in BLOCKS and sign != name)) and name not in VOID:
                if rest.rstrip().endswith("/"):
                    continue
                among = seen[-1]
                among[sign] = k = among.get(sign, 0) + 1
                token = xxhash.xxh64_intdigest(f"{sign}#{k}", elements[path[-1]].token)
                i = known.get(token)
                if i is None:
                    i = known[token] = len(elements)
                    inside = bool(open_.get("article") or open_.get("main"))
                    first = token if k == 1 else xxhash.xxh64_intdigest(f"{sign}#1", elements[path[-1]].token)
                    elements.append(Element(token, path[-1], kind_of(name, own, inside), 0, place, like=first))
                elements[i].n += 1
                names.append(name)
                path.append(i)
                seen.append({})
                open_[name] = open_.get(name, 0) + 1
                continue
            if name == "a":
                links += 1
            if name not in VOID:
                token = xxhash.xxh64_intdigest(f">{sign}", elements[path[-1]].token)
                other = self.others.setdefault(token, [0, path[-1], place])
                other[0] += 1
            if name in ("br", "td", "th", "img", "wbr"):
                pieces.append((path[-1], " "))
