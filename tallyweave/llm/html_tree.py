"""HTML as a tree of elements in page order, in time linear in the page, whatever its markup.

Tags may be unclosed, crossed or unknown: an element ends with its parent, and where HTML ends it unasked (a
paragraph before a block, a list item before the next one). Comments, declarations and the contents of RAW
elements are no text. Text is kept as pieces, each with the element that owns it; a piece begins with a space where a
block begins or ends before it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape
from typing import NamedTuple

# Fixed values of HTML: elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noframes template xmp select option button svg math object canvas audio video".split())
#: Elements whose contents are characters up to their own end tag.
CHARACTERS = frozenset("script style title textarea iframe noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: A paragraph ends before these.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: What an element ends unasked, up to the nearest element that holds such.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
ENDS |= {"tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ENDS |= {k: ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}) for k in ("thead", "tbody", "tfoot")}
#: A paragraph outside of these is not open inside.
HOLDS_P = frozenset("td th table button object caption".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"""((?:\s+[a-zA-Z][\w:.-]*(?:="[^"<>]*")?)*+)\s*/?>""")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)\s*(=?)\s*""")
_UNQUOTED = re.compile(r"""[^\s>]*""")
_PAIR = re.compile(r"""([a-zA-Z][\w:.-]*)(?:="([^"<>]*)")?""")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LETTERS = re.compile(r"[a-z]+")
_END = {t: re.compile(f"</{t}(?=[\\s/>])", re.IGNORECASE | re.ASCII) for t in CHARACTERS}
#: Attributes that say what an element is for.
TELLING = ("class", "id", "role", "itemprop")


class Page(NamedTuple):
    tags: list[str]
    parents: list[int]  # -1 for the root, which is element 0
    ends: list[int]  # elements k + 1 to ends[k] - 1 are below k
    tokens: list[tuple[str, ...]]
    label: list[str | None]  # the attribute data-part
    pieces: list[tuple[int, str]]


def _attributes(html: str, at: int, gone: dict[str, int]) -> tuple[dict[str, str], int]:
    """Attributes from position at, and where the tag's content begins. gone: from where on a quote is known to be missing."""
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(html, at)
        if m is None:
            end = html.find(">", at)
            return found, len(html) if end < 0 else end + 1
        name, at, value = m[1].lower(), m.end(), ""
        if m[2]:
            quote, end = html[at : at + 1], -1
            if quote in ('"', "'") and at < gone.get(quote, len(html)):
                end = html.find(quote, at + 1)
                if end < 0:  # never closed: an ordinary character
                    gone[quote] = at
            if end >= 0:
                value, at = html[at + 1 : end], end + 1
            else:
                value = _UNQUOTED.match(html, at)[0]
                at += len(value)
        found.setdefault(name, value)


def tokens_of(attributes: dict[str, str]) -> tuple[str, ...]:
    """Lower-case words of the attributes that say what an element is for."""
    text = " ".join(attributes[k] for k in TELLING if k in attributes)
    return tuple(dict.fromkeys(_LETTERS.findall(_CAMEL.sub(" ", text).lower()))) if text else ()


def above(heights: list[int], floor: int) -> list[int]:
    """Those of rising heights that are over floor."""
    k = len(heights)
    while k and heights[k - 1] > floor:
        k -= 1
    return heights[k:]


def parse(html: str) -> Page:
    tags, parents, ends, tokens, label, pieces = ["html"], [-1], [0], [()], [None], []
    stack, places = [0], defaultdict(list)  # open elements; their heights in the stack by tag
    raw, gap, gone = 0, True, {}

    def close(height: int) -> None:
        """Ends the open elements from this height on."""
        nonlocal raw
        while len(stack) > height:
            k = stack.pop()
            ends[k] = len(tags)
            places[tags[k]].pop()
            raw -= tags[k] in RAW

    def last(names) -> int:
        return max((places[t][-1] for t in names if places.get(t)), default=0)

    def text(chunk: str) -> None:
        nonlocal gap
        if not chunk or raw:
            return
        if chunk.isspace():
            gap = True
        else:
            pieces.append((stack[-1], (" " if gap else "") + (unescape(chunk) if "&" in chunk else chunk)))
            gap = False

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        m = _NAME.match(html, lt)
        if m is None:
            if html.startswith(("<!", "<?", "</"), lt):
                text(html[at:lt])
                comment = html.startswith("<!--", lt)
                # "<!-->" and "<!--->" are whole comments
                end = html.find("-->", lt + 2) if comment else html.find(">", lt)
                at = size if end < 0 else end + (3 if comment else 1)
            else:
                text(html[at : lt + 1])
                at = lt + 1
            continue
        text(html[at:lt])
        tag = m[2].lower()
        plain = _PLAIN.match(html, m.end())
        if plain:
            attributes, at = {k.lower(): v for k, v in reversed(_PAIR.findall(plain[1]))} if plain[1] else {}, plain.end()
        else:
            attributes, at = _attributes(html, m.end(), gone)
        if tag not in INLINE:
            gap = True
        if m[1]:
            if tag not in ("html", "body") and places.get(tag):
                close(places[tag][-1])
            continue
        if tag == "html":
            continue
        if tag in ENDS_P and (p := last(("p",))) and p > last(HOLDS_P):
            close(p)
        if tag in ENDS:
            ended, holders = ENDS[tag]
            floor = last(holders)
            open_ones = [h for t in ended if places.get(t) for h in above(places[t], floor)]
            if open_ones:
                close(min(open_ones))
        k = len(tags)
        tags.append(tag)
        parents.append(stack[-1])
        ends.append(k + 1)
        tokens.append(tokens_of(attributes) if attributes else ())
        label.append(attributes.get("data-part") if attributes else None)
        if tag in VOID:
            continue
        places[tag].append(len(stack))
        stack.append(k)
        raw += tag in RAW
        if tag in CHARACTERS:
            end = _END[tag].search(html, at)
            at = end.start() if end else size
    close(1)
    ends[0] = len(tags)
    return Page(tags, parents, ends, tokens, label, pieces)
