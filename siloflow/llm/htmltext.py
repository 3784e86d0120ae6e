"""Main-text extraction by tag-path ratios.

A page is cut into blocks of text, each with the path of open elements from the root. Blocks of one
path share a fate, as templates give content and boilerplate paths of their own. For each path the
length of its text, its punctuation and its link text are summed over its blocks, and names of elements, classes and roles
that often mark boilerplate weaken the ratio by a factor; none of them decides alone. The ratios are smoothed along
the page, by neighbours as far as their elements are close, and fused into one score of the path; paths above a share of the spread of
scores are content. The deepest element that holds nearly all content text is the article. Its blocks come out in page order:
all those of content paths, and those of weaker paths that nothing speaks against, such as
headings, list items and short paragraphs; weak paths that are links or that are marked go. Outside of it, unmarked paths
with scores like its own stay too.

Edge cases: null html counts as empty; a page without content gives an empty text and 0 characters.
Broken markup is read as browsers do: a new paragraph ends an open one, unknown end tags are passed
over, a lone ``<`` is text. Elements that have no text of the page (scripts, styles, the head, form controls, hidden ones) are left out.
Repeated rows give a row each. ``extract`` writes the columns text and n_chars, in place of columns of these names, and leaves all others alone. The
work is linear in the page, its depth included, and one page is all that is in memory.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import exp, log1p, sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*'|["'])*+)>?""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; their text ends at their own end tag only.
RAW = frozenset("script style textarea title xmp noframes noembed iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that have no text of the page by their definition.
NO_TEXT = frozenset("head script style noscript template svg canvas iframe object audio video title xmp noframes noembed button select option datalist textarea label legend".split())
#: What names of elements and roles, and words in classes and ids, weaken a path by.
WEAK_NAMES = dict.fromkeys("nav footer header aside form dialog menu".split(), 0.02)
WEAK_ROLES = frozenset("navigation banner contentinfo complementary dialog alertdialog alert search form menu menubar toolbar".split())
WEAK_WORDS = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert "
    "sidebar nav navbar navigation breadcrumb breadcrumbs header masthead footer share sharing social comment comments reply replies "
    "respond disqus related recommended newsletter subscribe subscription popup modal overlay login signup search toolbar "
    "pagination pager tags widget copyright".split()
)
#: Last parts of a name, such as ad-box, that leave the first part to say what it is.
BOXES = frozenset("area bar block body box button buttons container content form inner item items link links list menu outer panel section slot text thread top unit wrap wrapper".split())
WEAK = 0.05
#: Elements that hold an article strengthen a path, however many there are.
STRONG_NAMES = frozenset("article main".split())
STRONG = 3.0
#: A start tag ends these open elements, up to the nearest element of SCOPE.
ENDS = {name: ("p",) for name in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()} | {
    "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "tr", "td", "th"), "td": ("p", "td", "th"), "th": ("p", "td", "th"),
    "tbody": ("tr", "td", "th", "tbody", "thead"), "thead": ("tr", "td", "th"), "tfoot": ("tr", "td", "th", "tbody", "thead"), "option": ("option",),
}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "option": ("select",)}
BARRIER = frozenset("table td th caption button object html body article section aside nav header footer main div form".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、]")


#: Smoothing radius in blocks, the share of the scores' spread that content must reach, and of the content text that the article must hold.
RADIUS = 3
SPREAD = 1.2
HOLD = 0.9
#: Share of the content's mean score that unmarked paths outside the article must reach.
ALONE = 0.5
#: Above this share of link text a weak path is a menu.
LINKED = 0.6
#: No article by themselves: their parent is.
PARTS = frozenset("p li dd dt dl ul ol td th tr tbody thead tfoot blockquote pre figure figcaption".split()) | HEADINGS


class Element:
    """An open element; its path is the number of (its parent's path, its label) in the page's table of paths."""

    __slots__ = ("name", "up", "at", "path", "depth", "hidden", "prior", "strong", "bounds", "block")

    def __init__(self, name: str, up: Element | None, at: int, path: int, hidden: bool, weak: float):
        self.name, self.up, self.at, self.path = name, up, at, path
        self.depth = up.depth + 1 if up else 0
        self.hidden = hidden or bool(up and up.hidden)
        self.prior = max((up.prior if up else 1.0) * weak, 1e-6)
        self.strong = name in STRONG_NAMES or bool(up and up.strong)
        self.bounds = name not in INLINE and not self.hidden  # a block ends where it begins and where it ends
        self.block = self if self.bounds or not up else up.block


class Block:
    __slots__ = ("owner", "text", "linked", "shared")

    def __init__(self, owner: Element, text: str, linked: int, shared: int):
        self.owner, self.text, self.linked, self.shared = owner, text, linked, shared  # shared: the depth of what holds this and the block before


def weak_name(name: str) -> bool:
    """Whether a class or id, such as cookie-notice, site-footer or ad-box but not ad-hoc, is said of boilerplate."""
    parts = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
    while len(parts) > 1 and parts[-1] in BOXES:
        parts.pop()
    return bool(parts) and parts[-1] in WEAK_WORDS


def marks(attributes: str) -> tuple[str, bool, bool]:
    """The classes, id and role as one label, whether one of them is said of boilerplate, and whether the element is hidden."""
    label: list[str] = []
    hidden = weak = False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE)):
            hidden = True
        elif key in ("class", "role"):
            label += sorted(value.split())
            weak = weak or any(v.lower() in WEAK_ROLES if key == "role" else weak_name(v) for v in value.split())
        elif key == "id":
            weak = weak or weak_name(value)
    return " ".join(label), weak, hidden


class Page:
    """The blocks of a page in page order, and all its elements, parents first."""

    def __init__(self, html: str):
        self.paths: dict[tuple[int, str, str], int] = {}
        root = Element("#", None, 0, 0, False, 1.0)
        self.elements, self.blocks = [root], []
        self._stack, self._open = [root], Counter()
        self._parts: list[str] = []
        self._owner, self._linked, self._lowest = root, 0, 0
        self._read(html)
        self._close(1)
        self._flush()

    def _flush(self) -> None:
        text = " ".join(unescape("".join(self._parts)).split()) if self._parts else ""
        if text:
            self.blocks.append(Block(self._owner, text, self._linked, self._lowest))
            self._lowest = self._owner.depth
        self._parts.clear()
        self._linked = 0

    def _add(self, text: str) -> None:
        if self._stack[-1].hidden:
            return
        owner = self._stack[-1].block
        if not self._parts or owner is not self._owner:
            self._flush()
            self._owner = owner
        self._parts.append(text)
        if self._open["a"]:
            self._linked += len(text.strip())

    def _push(self, name: str, attributes: str) -> None:
        up = self._stack[-1]
        label, weak, hidden = marks(attributes) if attributes and not attributes.isspace() else ("", False, False)
        factor = 1.0 if name == "header" and up.strong else WEAK_NAMES.get(name, 1.0)
        path = up.path if name in INLINE else self.paths.setdefault((up.path, name, label), len(self.paths) + 1)
        new = Element(name, up, len(self.elements), path, hidden or name in NO_TEXT, min(factor, WEAK if weak and name not in ("html", "body", "main") else 1.0))
        if new.bounds:
            self._flush()
        self.elements.append(new)
        self._stack.append(new)
        self._open[name] += 1

    def _close(self, depth: int) -> None:
        while len(self._stack) > depth:
            e = self._stack.pop()
            if e.bounds:
                self._flush()
            self._open[e.name] -= 1
        self._lowest = min(self._lowest, self._stack[-1].depth)

    def _end(self, name: str, stop) -> None:
        """Close the innermost open element of a name, unless one that stops comes first."""
        if not self._open[name]:
            return
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k].name == name:
                self._close(k)
                return
            if stop(self._stack[k].name):
                return

    def _start(self, name: str, attributes: str) -> None:
        for ended in ENDS.get(name, ()):
            self._end(ended, lambda x, e=ended: x in SCOPE.get(name, ()) or (e == "p" and x in BARRIER))
        if name == "br":
            self._parts.append(" ") if self._parts else None
        elif name in VOID:
            self._flush() if name == "hr" else None
        else:
            if name == "a":
                self._end("a", lambda x: False)
            if not (attributes.endswith("/") and name in ("path", "rect", "circle", "use", "g", "line")):
                self._push(name, attributes.rstrip("/"))

    def _read(self, html: str) -> None:
        at = 0
        m = TOKEN.search(html)
        while m:
            if m.start() > at:
                self._add(html[at : m.start()])
            at, name = m.end(), (m.group(2) or "").lower()
            if name and not m.group(1):
                self._start(name, m.group(3))
                if name in RAW:
                    end = re.compile(rf"</{re.escape(name)}[^>]*>?", re.IGNORECASE).search(html, at)
                    at = end.end() if end else len(html)
                    self._close(len(self._stack) - 1)
            elif name:
                self._end(name, (lambda x: x not in INLINE) if name in INLINE else lambda x: False)
            m = TOKEN.search(html, at)
        if at < len(html):
            self._add(html[at:])


def path_scores(blocks: list[Block]) -> dict[int, float]:
    """The fused score of each path: text and punctuation for each block, without link text, weakened by its marks, smoothed along the page."""
    length, stops, linked, count = Counter(), Counter(), Counter(), Counter()
    for x in blocks:
        p = x.owner.path
        length[p] += len(x.text)
        stops[p] += len(PUNCTUATION.findall(x.text))
        linked[p] += x.linked
        count[p] += 1
    own = [length[p] / count[p] * (1 + log1p(stops[p] / count[p])) * max(0.0, 1 - linked[p] / length[p]) * x.owner.prior * (STRONG if x.owner.strong else 1.0) for x in blocks for p in (x.owner.path,)]
    fused = Counter()
    for i, x in enumerate(blocks):
        total, weight = own[i], 1.0
        for step in (-1, 1):
            shared, j = x.owner.depth, i
            for d in range(1, RADIUS + 1):
                if not 0 <= j + step < len(blocks):
                    break
                shared = min(shared, blocks[max(j, j + step)].shared)  # the depth of what holds all blocks from here to there
                j += step
                near = exp(-(d * d) / RADIUS) * (shared / max(x.owner.depth, blocks[j].owner.depth, 1)) ** 3
                total += near * own[j]
                weight += near
        fused[x.owner.path] += total / weight
    return {p: fused[p] / count[p] for p in count}


def main_text(html: str | None) -> str:
    page = Page(html or "")
    nodes = page.blocks
    if not nodes:
        return ""
    scores = path_scores(nodes)
    mean = sum(scores[x.owner.path] for x in nodes) / len(nodes)
    spread = sqrt(sum((scores[x.owner.path] - mean) ** 2 for x in nodes) / len(nodes))
    floor = min(max(scores.values()), SPREAD * spread)
    content = {p for p, score in scores.items() if score >= floor}
    # the deepest element that holds nearly all content: text is summed from the last elements to their parents
    held = [0] * len(page.elements)
    for x in nodes:
        if x.owner.path in content:
            held[x.owner.at] += len(x.text)
    for e in reversed(page.elements[1:]):
        held[e.up.at] += held[e.at]
    article = max((e for e in page.elements if held[e.at] >= HOLD * held[0]), key=lambda e: e.depth)
    while article.up and article.name in PARTS:
        article = article.up
    inside = [False] * len(page.elements)
    for e in page.elements:
        inside[e.at] = e is article or bool(e.up and inside[e.up.at])
    length, linked = Counter(), Counter()
    for x in nodes:
        length[x.owner.path] += len(x.text)
        linked[x.owner.path] += x.linked
    alone = max(floor, ALONE * sum(scores[p] * length[p] for p in content) / held[0])

    def stays(x: Block) -> bool:
        e = x.owner
        unmarked = e.prior >= article.prior
        if inside[e.at]:
            return e.path in content or unmarked and (e.name in HEADINGS or linked[e.path] <= LINKED * length[e.path])
        return scores[e.path] >= alone and unmarked

    return "\n".join(x.text for x in nodes if stays(x))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Append text and n_chars to every row; all other columns stay."""

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(x) for x in s], dtype=object)

    return pages.withColumn("text", extracted(F.col(html))).withColumn("n_chars", F.length("text").cast("long"))


def op9(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
