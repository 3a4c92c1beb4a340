"""Main text of web pages by two-pass block rules.

Pass one walks the markup, cuts the page into blocks and classifies each: blocks inside menus,
footers, forms, notices, adverts, comments and the like are boilerplate; link-heavy blocks are
boilerplate; long blocks are content where the page marks them as its article, and elsewhere where
they hold enough stop words.  Headings and paragraphs of an article stay whatever they link to.  What is too short to tell stays open.  In pass two an open block
takes the label of its nearest decided neighbours within the same article or page body.

Defined cases: null or empty html gives the empty text; unclosed tags, comments and truncated pages
are read as far as they go; texts of any length are taken whole; repeated pages give repeated rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import query, table

# HTML elements by role, names of page furniture, frequent function words.
BLOCK = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template".split())
FURNITURE = set("nav header footer aside form head menu dialog button select datalist search object svg math canvas audio video map noscript".split())
FURNITURE_NAMES = set("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline caption-ad comment comments consent cookie cookies
copyright disclaimer disqus feedback footer footnav gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification
outbrain overlay pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social
sponsor sponsored subscribe subscription taboola teaser toolbar topbar widget widgets""".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar note status".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Parts of a compound class name that say nothing of its content: beside them a furniture name stands alone.
NEUTRAL = set("""area article aside bar block blocks body box button buttons card column container content core count element entry form group head holder inline inner
item items label left line link links list main mobile module note outer page panel part post posts right row section site slot story strip text title top unit view wrap
wrapper zone""".split())
#: First parts of class names that tell how a page is laid out, not what an element holds.
LAYOUT = set("has no with without".split())
STOP_WORDS = set("""a about after all also an and are as at be because been but by can could did do for from had has have he her his how i if in into is it
its may more most my no not of on one or other our out over she should so some than that the their them then there these they this to up was we were
what when which who will with would you your
aber als am an auch auf aus bei bin bis das dass dem den der des die ein eine einem einen einer es für hat ich im in ist ja kann mit nach nicht noch
nur oder sich sie sind so über um und uns unter vom von vor war was wenn wie wir wird zu zum zur
au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais même ne nous on ou par pas plus pour qu que qui sa se
ses son sont sur un une vous y
al como con cuando de del desde donde el ella en entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por porque que se si
sin sobre su sus también un una y ya""".split())

#: Characters of a block that is long enough to be judged, and thresholds of the two densities.
SHORT = 70
LINK_DENSITY = 0.5
STOP_DENSITY = 0.15

_START = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*+)")
_COMMENT_END = re.compile(r"--!?>")
#: What follows a tag's name up to its end; quoted values may hold the end's character.  No part is tried twice.
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: A name begins only where the one before has ended, so that a long run is read once.
_ATTRIBUTE = re.compile(r"(?<![^\s\"'<>/=])([^\s\"'<>/=]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'<>`]++))|(?<![^\s])hidden(?![^\s])", re.S)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    link_chars: int
    area: int  # number of the article or main element it lies in; 0 outside
    furniture: bool
    listed: bool
    told: bool  # a heading, or a paragraph outside lists


@dataclass
class Element:
    tag: str
    furniture: bool
    link: bool
    area: int
    listed: bool
    heading: bool
    paragraph: bool
    number: int


def _names_furniture(token: str, how: str) -> bool:
    """Whether a class name or id tells of furniture: as it stands (``whole``), all its parts taken together (``all``), or by any part."""
    if how == "whole":
        return token in FURNITURE_NAMES
    parts = [x for x in re.split(r"[-_]+", token) if x and not x.isdigit()]
    named = [x in FURNITURE_NAMES for x in parts]
    if how == "all":
        return any(named) and all(n or x in NEUTRAL for x, n in zip(parts, named))
    return bool(parts) and parts[0] not in LAYOUT and any(named)


def _is_furniture(tag: str, attributes: str, wrapper: bool, inside: bool = False) -> bool:
    """Whether an element is page furniture; a ``wrapper`` of an article, or a heading, by whole names only.

    ``inside`` an article a compound name counts only if all its parts are furniture or neutral.
    """
    if tag in FURNITURE:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return False
    page_part = tag in ("html", "body", "main", "article")
    for m in _ATTRIBUTE.finditer(attributes):
        name = (m[1] or "hidden").lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value.strip() in FURNITURE_ROLES:
            return not page_part
        if name in ("class", "id"):
            for token in value.split():
                if _names_furniture(token, "whole" if page_part or wrapper or tag in HEADINGS else "all" if inside else "any"):
                    return token in ("comment", "reply", "ad", "advert", "teaser") if page_part else True
    return False


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    stack: list[Element] = field(default_factory=list)
    opened: Counter = field(default_factory=Counter)
    parts: list[str] = field(default_factory=list)
    link_parts: list[str] = field(default_factory=list)
    areas: int = 0
    elements: int = 0
    wrappers: set[int] = field(default_factory=set)  # numbers of elements outside areas that hold an article or main element
    held: set[int] = field(default_factory=set)  # those found so far where furniture holds one
    marked: int = 0  # so many elements at the bottom of the stack are in ``held`` already

    def top(self) -> Element:
        return self.stack[-1] if self.stack else Element("", False, False, 0, False, False, False, 0)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top = self.top()
                links = len(" ".join("".join(self.link_parts).split()))
                self.blocks.append(Block(text, links, top.area, top.furniture, top.listed, top.heading or top.paragraph and not top.listed))
            self.parts, self.link_parts = [], []

    def say(self, raw: str) -> None:
        if raw and not self.top().furniture:
            text = html.unescape(raw)
            self.parts.append(text)
            if self.top().link:
                self.link_parts.append(text)

    def close(self, tag: str) -> None:
        if not self.opened[tag]:
            return
        while self.stack:
            gone = self.stack.pop()
            self.marked = min(self.marked, len(self.stack))
            self.opened[gone.tag] -= 1
            if gone.tag == tag:
                return

    def open(self, tag: str, attributes: str) -> None:
        above = self.top()
        area = above.area
        self.elements += 1
        furniture = above.furniture or _is_furniture(tag, attributes, self.elements in self.wrappers, bool(area))
        if tag in ("article", "main") and not furniture and not area:
            self.areas += 1
            area = self.areas
        elif tag in ("article", "main") and above.furniture and not area:
            self.held.update(e.number for e in self.stack[self.marked :])
            self.marked = len(self.stack)
        self.stack.append(Element(tag, furniture, above.link or tag == "a", area, above.listed or tag in ("ul", "ol", "menu"), above.heading or tag in HEADINGS, above.paragraph or tag == "p", self.elements))
        self.opened[tag] += 1


def blocks(source: str) -> list[Block]:
    """The page's text blocks in order."""
    page = _walk(source, set())
    if page.held:  # what lies around an article is known only now
        page = _walk(source, page.held)
    return page.blocks


def _markup(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(begin, end, tag, closing, attributes) of the markup in order; comments and declarations have no tag.

    The place never moves back: after one tag whose quotes stay open to the page's end, quotes are no
    longer honoured, and after the last ``>`` nothing is a tag.  A caller may ``send`` a place to go on from.
    """
    at, honour, closed = 0, True, True
    while m := _START.search(source, at):
        if m[2] is None:
            if m[0] == "<!--":
                e = _COMMENT_END.search(source, m.end())
                at = e.end() if e else len(source)
            else:
                e = source.find(">", m.end())
                at = e + 1 if e >= 0 else len(source)
            yield m.start(), at, "", False, ""
            continue
        rest = _REST.match(source, m.end()) if honour and closed else None
        if rest:
            at, attributes = rest.end(), rest[1]
        else:
            honour = False
            e = source.find(">", m.end()) if closed else -1
            if e < 0:
                closed, at = False, m.end()
                continue
            at, attributes = e + 1, source[m.end() : e]
        at = (yield m.start(), at, m[2].lower(), bool(m[1]), attributes) or at


def _walk(source: str, wrappers: set[int]) -> _Page:
    page, at, found = _Page(wrappers=wrappers), 0, _markup(source)
    skip = None
    while True:
        try:
            begin, end, tag, closing, attributes = found.send(skip)
        except StopIteration:
            break
        skip = None
        page.say(source[at:begin])
        at = end
        if not tag:
            continue
        if tag in BLOCK:
            page.flush()
        if closing:
            page.close(tag)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            skip = at = end.end() if end else len(source)
        elif tag == "br":
            page.say(" ")
        elif tag not in VOID:
            if tag in BLOCK and page.opened["p"]:
                page.close("p")
            if tag == "li" and page.top().tag == "li":
                page.close("li")
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                page.open(tag, attributes)
    page.say(source[at:])
    page.flush()
    return page


def _first_pass(b: Block, words: bool = True) -> bool | None:
    """Whether a block is content; None where it is too short to tell.  Without ``words`` links alone decide."""
    if b.furniture:
        return False
    links = b.link_chars / len(b.text)
    if links > LINK_DENSITY and not (b.area and b.told) and (b.listed or not b.area):
        return False
    if len(b.text) < SHORT:
        return None
    if b.area or not words:
        return True
    found = _WORD.findall(b.text.lower())
    return sum(w in STOP_WORDS for w in found) >= STOP_DENSITY * len(found)


def _second_pass(labels: list[bool | None], otherwise: bool) -> list[bool]:
    """Open labels from the nearest decided neighbours; content if either one is, or none is decided."""
    before, last = [], None
    for x in labels:
        last = last if x is None else x
        before.append(last)
    after, last = [], None
    for x in reversed(labels):
        last = last if x is None else x
        after.append(last)
    out = []
    for x, p, n in zip(labels, before, reversed(after)):
        near = [y for y in (p, n) if y is not None]
        out.append(x if x is not None else any(near) if near else otherwise)
    return out


def main_text(source: str | None) -> str:
    """The article's blocks joined by line ends."""
    found = blocks(source or "")
    inside = [b for b in found if b.area and not b.furniture]
    chosen = inside or [b for b in found if not b.furniture]
    # a page in a language without a word list here: no long block would pass, so links alone decide
    known = any(len(b.text) >= SHORT and _first_pass(b) for b in chosen)
    out: list[str] = []
    for area in sorted({b.area for b in chosen}):
        part = [b for b in chosen if b.area == area]
        labels = [_first_pass(b, known) for b in part]
        if area:  # a list of links between short paragraphs of an article says nothing about them
            labels = [True if x is None and (b.told or not b.listed) else x for x, b in zip(labels, part)]
        out += [b.text for b, keep in zip(part, _second_pass(labels, True)) if keep]
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as (page_id, url, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id bigint, url string, text string")


@query("op2_html_extraction")
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("bigint"))
