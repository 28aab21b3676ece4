"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its path from the root to the element
that holds it.  Over the blocks of one path the text outside links and the punctuation marks in it are
added up and divided by the blocks; both ratios are smoothed over neighbouring blocks,
weighted by how much of their place in the page they share, and fused.  Paths whose
fused ratio reaches a share of the page's typical one hold the content.

Labels that say what an element is come before that: menus, forms, scripts and the like are no
content whatever their ratios, and paths within ``article`` or ``main`` count for more.

Each page is worked on by itself, where it was read: nothing is shuffled, and a task holds
one batch and one page's blocks.

Defined results: a null, empty or textless page gives an empty text; a comment, script or
style that never ends reaches to the end of the page; tags that never close end with
their parents; repeated rows each get their own result; an empty table gives no rows; columns other than those named pass through.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.frames import map_arrow
from basketlens.llm.words import slices

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""(?P<name>[^\s"'>/=]+)(?:\s*=\s*(?:"(?P<double>[^"]*)"|'(?P<single>[^']*)'|(?P<plain>[^\s"'>]+)))?""", re.S)
#: Elements whose text is no markup; only their own end tag ends them.
RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Which open elements a start tag closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: ... but never beyond these.
SCOPE = frozenset("ul ol dl table select html body div article main section td th".split())
#: Elements that are no content, whatever is in them.
NO_CONTENT = frozenset("nav footer aside form button select option head menu dialog object audio video canvas svg math datalist applet input".split()) | RAW.keys()
#: Words of classes, ids and roles of elements that are no content.
NO_CONTENT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promoted promotion banner banners adsense nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs pager pagination "
    "toolbar topbar footer foot contentinfo sidebar sidebars aside complementary comment comments commentlist disqus replies reply respond responses guestbook cookie cookies consent gdpr notice notices "
    "alert alertdialog notification notifications popup modal overlay disclaimer newsletter subscribe subscription signup login search share sharing social related recommended recommendations copyright skip".split()
)
#: ... and of such that are none outside the article only.
OUTSIDE_WORDS = frozenset("header masthead".split())
#: Elements that end menus and heads left open.
STARTS = frozenset("body main article".split())
LEFT_OPEN = frozenset("head header nav menu".split())
IN_HEAD = frozenset("head title meta link script style base noscript template".split())
PUNCTUATION = re.compile(r"[,.;:!?…。，、；：！？¿¡]")
#: Blocks to either side that smoothing looks at, and the width of its bell.
REACH = 2
WIDTH = 1.0
#: Factor for paths within ``article`` or ``main``, and share of the typical ratio that a path must reach.
INSIDE = 4.0
#: What a linked character within these takes off the text outside links: titles there are often links.
LINKED_INSIDE = 0.5
SHARE = 0.1


@dataclass(slots=True)
class Element:
    tag: str
    path: int
    depth: int
    dropped: bool
    inside: bool
    link: bool
    block: Element | None = None  # the nearest element that is not inline, itself included


@dataclass(slots=True)
class Block:
    text: str
    path: int
    depth: int
    shared: int  # levels that it has in common with the block before
    inside: bool
    linked: int
    marks: int


def _labels(attributes: str, inside: bool) -> tuple[str, bool]:
    """Words of class, id and role, and whether they or the attributes say that the element is no content or not shown."""
    words, hidden = [], False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m["name"].lower(), m["double"] or m["single"] or m["plain"] or ""
        if name in ("class", "id", "role"):
            words += re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", html.unescape(value)).lower())
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hidden = True
    said = {w for k, w in enumerate(words) if k == 0 or words[k - 1] not in ("no", "has", "with", "without")}
    return ".".join(words), hidden or not said.isdisjoint(NO_CONTENT_WORDS) or not (inside or said.isdisjoint(OUTSIDE_WORDS))


class Reader:
    """Reads one page into its blocks."""

    def __init__(self) -> None:
        self.paths: dict[tuple[int, str], int] = {}
        self.stack = [Element("", 0, 0, False, False, False)]
        self.stack[0].block = self.stack[0]
        self.opened: Counter[str] = Counter()
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.lowest = 0
        self.holder = self.stack[0]

    def text(self, raw: str) -> None:
        top = self.stack[-1]
        if not raw or top.dropped:
            return
        if not self.parts:
            self.holder = top.block
        self.parts.append(raw)
        if top.link:
            self.linked.append(raw)

    def flush(self) -> None:
        """End a block: everything since the last one, white space as single spaces."""
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                linked = "".join(self.linked)
                e = self.holder
                marks = len(PUNCTUATION.findall(text)) - len(PUNCTUATION.findall(linked))
                self.blocks.append(Block(text, e.path, e.depth, min(self.lowest, e.depth), e.inside, min(len(text), len(" ".join(linked.split()))), marks))
                self.lowest = e.depth
            self.parts, self.linked = [], []

    def pop(self, down_to: int) -> None:
        if any(e.tag not in INLINE for e in self.stack[down_to:]):
            self.flush()
        self.opened.subtract(e.tag for e in self.stack[down_to:])
        del self.stack[down_to:]
        self.lowest = min(self.lowest, self.stack[-1].depth)

    def close_within(self, tags: set[str]) -> None:
        """Close the nearest open element of these, with what is in it, unless another one bounds it."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                return self.pop(k)
            if self.stack[k].tag in SCOPE:
                return None
        return None

    def open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            return self.text(" ")
        inline = tag in INLINE
        if not inline:
            self.flush()
            if tag in STARTS or (self.opened["head"] > 0 and tag not in IN_HEAD):
                ends = LEFT_OPEN if tag in STARTS else {"head"}
                if (k := next((k for k, e in enumerate(self.stack) if e.tag in ends), 0)) > 0:
                    self.pop(k)
            closes = CLOSES.get(tag, set()) | {"p"}
            if any(self.opened[t] > 0 for t in closes):
                self.close_within(closes)
        if tag in VOID:
            return None
        top = self.stack[-1]
        words, said = _labels(attributes, top.inside) if attributes.strip() else ("", False)
        inside = top.inside or tag in ("article", "main")
        frame = tag in ("html", "body", "main") or (tag == "article" and not top.inside)
        dropped = top.dropped or tag in NO_CONTENT or (said and not frame) or (tag == "header" and not top.inside)
        path = top.path if inline else self.paths.setdefault((top.path, f"{tag}.{words}"), len(self.paths) + 1)
        made = Element(tag, path, top.depth + (not inline), dropped, inside, top.link or tag == "a")
        made.block = top.block if inline else made
        self.stack.append(made)
        self.opened[tag] += 1
        return None

    def close(self, tag: str) -> None:
        if tag in ("p", "br"):
            self.text(" ")
        if self.opened[tag] <= 0:
            return None
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                return self.pop(k)
            if tag in INLINE and self.stack[k].tag not in INLINE:
                return None
        return None

    def read(self, page: str) -> list[Block]:
        at = 0
        decode = lambda s: html.unescape(s) if "&" in s else s
        while m := TOKEN.search(page, at):
            self.text(decode(page[at : m.start()]))
            at = m.end()
            if m["cdata"] is not None:
                self.text(m["cdata"])
            if not (tag := m["tag"]):
                continue
            tag = tag.lower()
            if m["end"]:
                self.close(tag)
                continue
            self.open(tag, m["attributes"])
            if tag in RAW:
                end = RAW[tag].search(page, at)
                at = end.start() if end else len(page)
        self.text(decode(page[at:]))
        self.flush()
        return self.blocks


def ratios(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """The fused ratio of each block's path, and the number of that path."""
    of, path = np.unique([b.path for b in blocks], return_inverse=True)
    length = np.array([len(b.text) for b in blocks], float)
    free = length - [b.linked * (LINKED_INSIDE if b.inside else 1) for b in blocks]
    nodes = np.bincount(path)
    ratio = np.stack([np.bincount(path, free), np.bincount(path, [b.marks for b in blocks])]) / nodes
    series = ratio[:, path]
    depth = np.array([b.depth for b in blocks], float)
    shared = np.array([b.shared for b in blocks], float)
    total, weight = series.copy(), np.ones(len(blocks))
    common = np.full(len(blocks), np.inf)
    for step in range(1, min(REACH, len(blocks) - 1) + 1):
        common = np.minimum(common[1:], shared[step:])  # levels that blocks at this distance share
        alike = np.where(path[step:] == path[:-step], 1.0, 2 * common / np.maximum(1, depth[step:] + depth[:-step]))
        bell = alike**2 * np.exp(-(step**2) / (2 * WIDTH**2))
        total[:, step:] += bell * series[:, :-step]
        total[:, :-step] += bell * series[:, step:]
        weight[step:] += bell
        weight[:-step] += bell
    smooth = total / weight
    fused = smooth[0] * (1 + smooth[1]) * np.where([b.inside for b in blocks], INSIDE, 1.0)
    free_share = np.bincount(path, free) / np.bincount(path, length)
    return (np.bincount(path, fused) / nodes * free_share)[path], path


def main_text(page: str | None) -> str:
    """The blocks of the paths that hold content, in page order, joined by a space."""
    blocks = [b for b in Reader().read(page or "") if not b.text.startswith(("©", "Copyright ©"))]
    if not blocks:
        return ""
    fused, _ = ratios(blocks)
    length = np.array([len(b.text) for b in blocks], float)
    typical = (fused * length).sum() / length.sum()
    return " ".join(b.text for b, f in zip(blocks, fused, strict=True) if f >= SHARE * typical)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of its markup."""
    names = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    fields = [f"`{c}` {kind}" for c, kind in pages.dtypes if c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch, column)):
            text = pa.array((main_text(x.as_py()) for x in batch.column(column)), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), text], names=[*names, "text"])

    found = map_arrow(pages.select(*names, column), run, ", ".join([*fields, "text string"]))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def query(spark, folder):
    """``op11``: the main text of every page."""
    return extract(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html"))
