"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each under its root-to-leaf path of
block-level tags (inline tags such as links and emphasis are part of the block
they stand in). For every path the length of its text and its punctuation are
added up and divided by the number of its blocks. Both ratios are smoothed over
the blocks in page order and fused with the path's whole text:

    fused = sqrt(text ratio * (1 + punctuation ratio) * text) * (1 - link share ** 2) * marks

so a path of many long sentences outweighs one that says little, or says it once.
Marks are what the path itself says, a factor and no more: side matter (by tag,
class, id or role) and text outside the page's article or main part weigh less.
A path is content at ``THRESHOLD`` of the page's best path or above.

Content paths lead to the content node: the lowest element that holds ``MOST`` of
their text, or the article or main part around it. Of that node's other blocks
those stay that come with running text, with nothing but such elements between
them and the node (headings, lists, quotations, tables), and aren't mostly links. A
block in a division of its own has to be on a content path, and outside the node
among more than a ``FEW`` of such text, so adverts, notices and comment threads go
whatever they are called, as long as the article outweighs them.

Time and memory are linear in the page: tags are found by scanning forward, open
elements are held with an index by tag, and a path is a number that its parent
path and its tag give.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: A path is content at this share of the best fused ratio of its page.
THRESHOLD = 0.5
#: Share of the text on content paths that the content node holds; and that the element around a block outside it has to hold.
MOST, FEW = 0.8, 0.1
#: Factors of side matter, and of what lies outside the article or main part of a page that has one.
SIDE, OUTSIDE = 0.02, 0.3
#: Weights of a block and its neighbours in page order.
SMOOTH = (0.25, 0.5, 0.25)

_name = re.compile(r"[a-zA-Z][^\s/<>]*")
_part = re.compile(r"[^>=]*(?:=\s*([\"'])?)?")
_attribute = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*$", re.I)
_bare = re.compile(r"[^\s>]*")
_split = re.compile(r"[\s_\-]+")
_punctuation = re.compile(r"[.,;:!?…。，、；：！？¿¡]")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements whose inside isn't markup, and is no text of the page either.
_RAW = frozenset("script style noscript template textarea iframe svg xmp".split())
_raw_end = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in _RAW}
#: Elements whose text can't be an article's.
_NEVER = frozenset("head title nav form button select option dialog menu object canvas audio video".split())
#: Elements that are side matter as a rule; a header is, outside an article.
_ASIDE = frozenset("aside footer".split())
#: Names in class, id or role that mark side matter.
_SIDE = frozenset("ad ads adv advert adverts advertisement advertising advertorial banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist disqus reply replies share sharing social related recommended recommendations newsletter subscribe subscription popup modal overlay login signup search skip pagination pager complementary contentinfo form".split())
#: Those of them that count on an article, main, body or html element too.
_SIDE_ANYWHERE = frozenset("comment comments reply ad ads advert sponsored promo related".split())
_MAIN = frozenset("main article content post entry story".split())
#: Elements that come with running text.
_ALONG = frozenset("p h1 h2 h3 h4 h5 h6 hgroup header section ul ol li dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr td th address details summary".split())
#: What a start tag of these closes, if it is open and not further out than the stops.
_ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_ENDS = {tag: (ends.split(), stops.split()) for tag, (ends, stops) in _ENDS.items()}
_P_ENDS = (["p"], "article aside body button caption div footer form header html main nav object section table td th".split())


class Block:
    """Text between block-level tags: the element it stands in, its pieces, and how much of it stands in links."""

    __slots__ = ("element", "linked", "pieces")

    def __init__(self, element: int):
        self.element, self.pieces, self.linked = element, [], 0


class Element(NamedTuple):
    """A block-level element: the one around it, its tag and its path's number."""

    around: int
    tag: str
    path: int


class _Reader:
    """Reads a page forward; ``paths`` holds for each path its flags (side, main)."""

    def __init__(self, page: str):
        self.page = page
        self.number: dict[tuple, int] = {(): 0}
        self.paths: list[tuple[bool, bool]] = [(False, False)]
        self.blocks: list[Block] = [Block(0)]
        self.elements: list[Element] = [Element(0, "", 0)]
        # Open elements: tag, block-level element, (never, side, main), and by tag their places; the places of block-level ones; open links.
        self.stack: list[tuple[str, int, tuple[bool, bool, bool]]] = [("", 0, (False, False, False))]
        self.open: dict[str, list[int]] = {}
        self.levels: list[int] = [0]
        self.links = 0

    def read(self) -> _Reader:
        page, at, size, last = self.page, 0, len(self.page), self.page.rfind(">")
        self.unclosed: set[str] = set()
        while at < size:
            start = page.find("<", at)
            if start < 0:
                start = size
            if start > at:
                self._text(page[at:start])
            if start == size:
                break
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = end + 3 if end >= 0 else size
                continue
            closes = page.startswith("/", start + 1)
            found = _name.match(page, start + 1 + closes)
            if found is None:
                if page.startswith(("<!", "<?", "</"), start):
                    at = page.find(">", start) + 1 if start < last else size
                else:
                    self._text("<")
                    at = start + 1
                continue
            if start > last:  # a tag that the page's end cuts off
                break
            names, empty, at = self._attributes(found.end(), last)
            tag = found[0].lower()
            if closes:
                self._end(tag)
            else:
                self._start(tag, names, empty)
                if tag in _RAW:
                    end = _raw_end[tag].search(page, at)
                    at = end.end() if end else size
                    self._end(tag)
        return self

    def _attributes(self, at: int, last: int) -> tuple[set[str], bool, int]:
        """Names in class, id and role; whether the tag closes itself; the place after its end."""
        page, names = self.page, set()
        if page[at] == ">":
            return names, False, at + 1
        while True:
            m = _part.match(page, at)
            quote, value = m[1], m.end()
            if m.end() > m.start() and (quote or page[value - 1 : value].isspace() or page[value - 1] == "="):
                if quote and quote not in self.unclosed:
                    end = page.find(quote, value)
                    if end >= 0:
                        after = end + 1
                    else:  # read on without regard to a quote that nothing closes
                        self.unclosed.add(quote)
                        end = after = _bare.match(page, value).end()
                else:
                    end = after = _bare.match(page, value).end()
                if _attribute.search(page, max(at, value - 64), page.rindex("=", at, value)):
                    names.update(_split.split(page[value:end].lower()))
                at = after
                continue
            if value >= len(page):
                return names, False, len(page)
            return names, page[value - 1] == "/", value + 1

    def _text(self, piece: str) -> None:
        never = self.stack[-1][2][0]
        if not never:
            block = self.blocks[-1]
            block.pieces.append(piece)
            if self.links:
                block.linked += len("".join(html.unescape(piece).split()))

    def _block(self) -> None:
        if self.blocks[-1].pieces:
            self.blocks.append(Block(self.stack[self.levels[-1]][1]))
        else:
            self.blocks[-1].element = self.stack[self.levels[-1]][1]

    def _pop(self, place: int) -> None:
        while len(self.stack) > place:
            tag = self.stack.pop()[0]
            self.open[tag].pop()
            if tag not in _INLINE:
                self.levels.pop()
            elif tag == "a":
                self.links -= 1

    def _end(self, tag: str) -> None:
        places = self.open.get(tag)
        if tag in _INLINE:
            if places and places[-1] > self.levels[-1]:  # an inline end doesn't close the block it is in
                self._pop(places[-1])
            return
        if places:
            self._pop(places[-1])
        self._block()

    def _start(self, tag: str, names: set[str], empty: bool) -> None:
        if tag == "br":
            self._text(" ")
            return
        if tag not in _INLINE and tag not in _VOID:
            ends, stops = _ENDS.get(tag, _P_ENDS)
            inside = [p[-1] for e in ends if (p := self.open.get(e))]
            if inside:
                limit = max((p[-1] for s in stops if (p := self.open.get(s))), default=0)
                if max(inside) > limit:
                    self._pop(min(i for i in inside if i > limit))
        if tag in _VOID:
            if tag not in ("img", "wbr"):
                self._block()
            return
        never, side, main = self.stack[-1][2]
        own = tag in ("article", "main", "body", "html")
        side = side or tag in _ASIDE or (tag == "header" and not main) or bool(names & (_SIDE_ANYWHERE if own else _SIDE))
        main = not side and (main or tag in ("article", "main") or "main" in names or bool(names & _MAIN and tag in ("div", "section", "td")))
        never = never or tag in _NEVER
        element = self.stack[-1][1]
        if tag not in _INLINE:
            path = self.number.setdefault((self.elements[element].path, tag, side, main), len(self.number))
            if path == len(self.paths):
                self.paths.append((side, main))
            self.elements.append(Element(element, tag, path))
            element = len(self.elements) - 1
        if empty and tag not in _INLINE and tag not in ("p", "div"):
            self._block()
            return
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in _INLINE:
            self.links += tag == "a"
        else:
            self.levels.append(len(self.stack))
        self.stack.append((tag, element, (never, side, main)))
        if tag not in _INLINE:
            self._block()


def _smoothed(values: np.ndarray, path: np.ndarray, count: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    """By path the mean of its blocks' smoothed values; each block has its path's value at first."""
    reach = len(weights) // 2
    blurred = np.convolve(np.pad(values[path], reach, mode="edge"), weights, mode="valid")
    return np.bincount(path, blurred, len(values)) / count


def _content_node(elements: list[Element], paths: list[tuple[bool, bool]], at: np.ndarray, text: np.ndarray) -> tuple[int, np.ndarray]:
    """The lowest element that holds MOST of the text of the blocks on content paths (their elements, their lengths), or the article or main part around it; and by element how much each holds."""
    held = np.zeros(len(elements))
    np.add.at(held, at, text)
    own = held > 0
    for e in range(len(elements) - 1, 0, -1):  # an element comes after the one around it
        held[elements[e].around] += held[e]
    node = 0
    for e in range(1, len(elements)):
        if elements[e].around == node and held[e] >= MOST * held[0] and not (own[e] and held[e] == text[at == e].sum()):
            node = e
    while node and paths[elements[elements[node].around].path][1]:
        node = elements[node].around
    return node, held


def extract(page: str | None, smooth: tuple[float, ...] = SMOOTH, punctuation: float = 1.0, threshold: float = THRESHOLD, ratios: bool = True) -> str:
    """The page's main text: blocks of content, white space single, joined by a blank.

    punctuation is the weight of the punctuation ratio; smooth must have an odd length. Without ratios all paths are alike but for their links and marks.
    """
    reader = _Reader(page or "").read()
    kept = []
    for b in reader.blocks:
        raw = html.unescape("".join(b.pieces)) if any("&" in p for p in b.pieces) else "".join(b.pieces)
        text = " ".join(raw.split())
        if text:
            kept.append((b.element, text, b.linked))
    if not kept:
        return ""
    elements = reader.elements
    at = np.array([e for e, _, _ in kept])
    names, path = np.unique([elements[e].path for e in at], return_inverse=True)
    n = len(names)
    size = np.array([len(t) - t.count(" ") for _, t, _ in kept], float)
    links = np.minimum(np.array([x for _, _, x in kept]) / size, 1)
    count = np.bincount(path, minlength=n)
    length = np.bincount(path, size, n)
    marks = np.bincount(path, [len(_punctuation.findall(t)) for _, t, _ in kept], n)
    linked = np.bincount(path, links * size, n) / length
    side, main = np.array([reader.paths[i] for i in names]).T
    text_ratio, mark_ratio = (_smoothed(x / count, path, count, smooth) for x in (length, marks))
    fused = np.sqrt(text_ratio * (1 + punctuation * mark_ratio) * length) if ratios else np.ones(n)
    fused = fused * (1 - linked**2) * np.where(side, SIDE, 1) * np.where(main.any() & ~main & ~side, OUTSIDE, 1)
    content = (fused >= threshold * fused.max()) & (fused > 0)
    chosen = content[path]
    if not chosen.any():
        return ""
    node, held = _content_node(elements, reader.paths, at[chosen], size[chosen])
    inside, along = ([e == node for e in range(len(elements))] for _ in range(2))
    for e in range(node + 1, len(elements)):
        inside[e] = inside[elements[e].around]
        along[e] = along[elements[e].around] and elements[e].tag in _ALONG
    chosen &= np.array([inside[e] or held[elements[e].around] >= FEW * held[0] for e in at])
    chosen |= np.array([along[e] for e in at]) & (links <= 0.5) & ~side[path]
    return " ".join(t for (_, t, _), good in zip(kept, chosen, strict=True) if good)


def main_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text as a column; a column of that name is replaced.

    Null, empty and broken pages are read as far as they go: unclosed comments and
    scripts reach to the end, a tag that the end cuts off is dropped, unclosed
    elements end with what encloses them. A quote that nothing closes is no quote. A
    page without content, or of links alone, has the empty text. A header inside an article or
    main part belongs to it. Equal pages have equal texts; very long and very deep pages are read whole.
    """

    @F.arrow_udf("string")
    def read(batch: pa.Array) -> pa.Array:
        return pa.array([extract(x.as_py()) for x in batch], pa.string())

    return pages.select(*[c for c in pages.columns if c != out], read(text_of(html_col)).alias(out))
