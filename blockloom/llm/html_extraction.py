"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass decides blocks by stop-word density,
length and link density, in every region; names of elements tell boilerplate, and a main region that
is believed only if most of the good text lies in it.  The second pass gives each block left open the
label of its nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.shared import two_columns

# Names of HTML elements, and words of class, id and role values.
_RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "select", "canvas", "audio", "video")
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
_MARK = re.compile(r"[>\"']")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in (*_RAW, "title")}
_ATTR = re.compile(r"([A-Za-z_:][\w:.-]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LEAVES = frozenset("p li dt dd tr td th option figcaption".split()) | _HEADINGS
_BOILER_TAGS = frozenset("nav footer aside form menu dialog button fieldset head".split())
_BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu topmenu submenu breadcrumb breadcrumbs sidebar aside footer "
    "masthead topbar banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments commentlist disqus reply replies respond pagination pager widget widgets toolbar search complementary contentinfo disclaimer copyright skip tags byline paywall".split()
)
_BOILER_STARTS = ("advert", "cookie", "comment", "newsletter", "sidebar", "navbar", "breadcrumb", "adslot", "adbox", "adunit", "sitenav", "sitefooter")
_ABOUT = frozenset("has with no without is".split())  # such values tell what an element goes with
_MAIN_WORDS = frozenset("main article articlebody".split())
_STOP = frozenset(
    "the of and to in a is that for on with as was it be by are this from at or an have not they but his her which you were their has been "
    "de la le les et des en un une du est que qui dans pour pas sur au par avec ce il plus ne se "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er so "
    "el los las y una por con para su al lo como más pero sus o este no".split()
)
_WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    link_chars: int
    main: bool
    boiler: bool
    heading: bool
    label: int = 0  # 1 good, -1 bad, 0 not decided


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTR.finditer(raw)}


def _kind(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element begins a main region, and whether a boilerplate region."""
    boiler, main = tag in _BOILER_TAGS, tag in ("article", "main")
    if "=" in attrs or "hidden" in attrs:
        a = _attributes(attrs)
        for value in " ".join(a.get(k, "") for k in ("class", "id", "role", "itemprop")).split():
            parts = [w.lower().rstrip("0123456789") for w in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])", value) if w]
            if not parts or parts[0] in _ABOUT:
                continue
            if any(w in _BOILER_WORDS or w.startswith(_BOILER_STARTS) for w in parts):
                boiler = boiler or tag not in ("body", "html", "main")
            elif parts[-1] in _MAIN_WORDS:
                main = True
        if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
            boiler = boiler or tag not in ("body", "html")
    return main and not boiler, boiler


class _Reader:
    """Cuts a page into texts and tags from left to right; no character is looked at more than a few times.

    A quote opens a value only after an equals sign, and one that never closes opens none."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.unclosed: set[str] = set()

    def _tag_end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` has its '>', or the page its end."""
        page = self.page
        while m := _MARK.search(page, at):
            mark, at = m[0], m.end()
            if mark == ">":
                return at - 1
            if mark in self.unclosed or page[m.start() - 1] != "=" and not page[max(0, m.start() - 20) : m.start()].rstrip().endswith("="):
                continue
            close = page.find(mark, at)
            if close < 0:
                self.unclosed.add(mark)
            else:
                at = close + 1
        return len(page)

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        """(kind, value, attributes): text, open or close; comments and declarations are left out."""
        page, begin = self.page, 0
        while (lt := page.find("<", max(self.at, begin))) >= 0:
            after = page[lt + 1 : lt + 2]
            name = _NAME.match(page, lt + 2 if after == "/" else lt + 1) if after else None
            if not name and after not in ("!", "?"):
                self.at = lt + 1  # a bare '<' is text
                continue
            if lt > begin:
                yield "text", page[begin:lt], ""
            if name:
                end = self._tag_end(name.end())
                begin = self.at = end + 1
                yield "close" if after == "/" else "open", name[0].lower(), page[name.end() : end]
                begin = max(begin, self.at)
                continue
            opened, closed = next((x for x in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(x[0], lt)), (page[lt : lt + 2], ">"))
            end = page.find(closed, lt + len(opened))
            if opened == "<![CDATA[":
                yield "text", page[lt + len(opened) : end if end >= 0 else len(page)], ""
            begin = self.at = len(page) if end < 0 else end + len(closed)
        if begin < len(page):
            yield "text", page[begin:], ""

    def skip_to(self, closing: re.Pattern) -> None:
        """Goes on after the closing tag of an element whose content isn't read."""
        m = closing.search(self.page, self.at)
        self.at = m.end() if m else len(self.page)


class _Open:
    """The elements that are open, with counts of what they are."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []  # tag, main, boiler
        self.tags: Counter[str] = Counter()
        self.main = self.boiler = 0

    def push(self, tag: str, main: bool, boiler: bool) -> None:
        self.stack.append((tag, main, boiler))
        self.tags[tag] += 1
        self.main += main
        self.boiler += boiler

    def pop(self) -> str:
        tag, main, boiler = self.stack.pop()
        self.tags[tag] -= 1
        self.main -= main
        self.boiler -= boiler
        return tag

    def close(self, tag: str) -> None:
        if self.tags[tag]:
            while self.pop() != tag:
                pass


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, with the regions they stand in."""
    out: list[Block] = []
    pieces: list[str] = []
    open_, reader = _Open(), _Reader(page)
    link = [0, 0]  # depth of <a>, characters within
    heading, breaks = False, 0

    def flush() -> None:
        nonlocal pieces
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            main = open_.main > 0
            boiler = open_.boiler > 0 or open_.tags["header"] > 0 and not (main and heading)
            out.append(Block(text, min(link[1], len(text)), main, boiler, heading))
        pieces, link[1] = [], 0

    for kind, value, attrs in reader:
        if kind == "text":
            pieces.append(value)
            if not value.isspace():
                breaks = 0
            if link[0]:
                link[1] += len(" ".join(value.split()))
            continue
        tag = value
        if kind == "close":
            if tag == "a":
                link[0] = max(0, link[0] - 1)
            elif tag not in _INLINE or open_.tags[tag]:
                flush()
                if tag in _HEADINGS:
                    heading = False
            open_.close(tag)
            continue
        if tag in _RAW_END and not attrs.endswith("/"):
            reader.skip_to(_RAW_END[tag])
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                pieces.append("\n")
            continue
        main, boiler = _kind(tag, attrs)
        if tag == "a":
            link[0] += not attrs.endswith("/")
        if tag in _INLINE:
            if boiler and tag != "a" and tag not in _VOID:
                flush()
                open_.push(tag, main, boiler)
            continue
        flush()
        if tag in _VOID:
            continue
        link[0] = 0 if tag in _LEAVES else link[0]
        if tag in _LEAVES:
            heading = tag in _HEADINGS
        elif tag not in ("header", "hgroup", "div"):
            heading = False
        while open_.stack and open_.stack[-1][0] in _LEAVES and (open_.stack[-1][0] == tag or open_.stack[-1][0] == "p" or open_.stack[-1][0] in _HEADINGS):
            open_.pop()
        if tag == "body":
            open_ = _Open()
        if (main or boiler or tag not in _LEAVES or tag == "li") and not attrs.endswith("/"):
            open_.push(tag, main, boiler)
    flush()
    return out


def stop_density(text: str) -> float:
    words = _WORDS.findall(text.lower())
    return sum(w in _STOP for w in words) / len(words) if words else 0.0


def classify(blocks: list[Block], short: int = 70, long: int = 200, links: float = 0.5, stop_low: float = 0.1, stop_high: float = 0.2) -> None:
    """Labels the blocks in place.

    First pass: blocks of boilerplate elements are bad.  Of the others, in whatever region, those are
    good that have stop words enough for their length, and those bad that are made of links, or are
    long, partly links and without stop words; the rest, short ones above all, stays open.  A region
    named as the main one is believed if it holds at least half of the good text (of all text, where
    there is none good): then what lies outside is bad.
    Second pass: open blocks take the label of the nearest decided neighbours of their region, and of
    two that differ the good one inside a believed region.  A believed region without any decided
    block is good."""
    good = [0, 0]
    whole = [0, 0]
    linked = [b.link_chars > 0.9 * len(b.text) for b in blocks]
    for i, b in enumerate(blocks):
        if b.boiler:
            b.label = -1
            continue
        n, density, stops = len(b.text), b.link_chars / len(b.text), stop_density(b.text)
        listed = linked[i] and (any(linked[max(0, i - 1) : i]) or any(linked[i + 1 : i + 2]))
        if n >= short and (density > links or n >= long and density > 0.2) and stops < stop_low / 2 or not b.main and (density > links or listed and n < long):
            b.label = -1
        elif n >= short and stops >= stop_high or n >= long and stops >= stop_low:
            b.label = 1
        whole[b.main] += n
        good[b.main] += n * (b.label > 0)
    believed = whole[1] > 0 and (good[1] >= good[0] if any(good) else whole[1] >= whole[0])
    inside = [not b.boiler and (b.main or not believed) for b in blocks]
    for b, i in zip(blocks, inside):
        if not i:
            b.label = -1
    n = len(blocks)
    decided = [b.label for b in blocks]
    before, after, last = [(0, 0)] * n, [(0, 0)] * n, (0, 0)
    for i in range(n):
        before[i] = last
        if decided[i] and (inside[i] or not believed):
            last = (decided[i], i)
    last = (0, 0)
    for i in range(n - 1, -1, -1):
        after[i] = last
        if decided[i] and (inside[i] or not believed):
            last = (decided[i], i)
    for i, b in enumerate(blocks):
        if b.label == 0:
            (left, li), (right, ri) = before[i], after[i]
            if left == right:
                b.label = left or 1
            elif believed and b.main or b.heading and right == 1:
                b.label = max(left, right) or 1
            elif not left or not right:
                b.label = left or right
            else:
                told = blocks[li if left < 0 else ri].boiler
                b.label = left if i - li < ri - i else right if ri - i < i - li else 1 if told else -1


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label > 0)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """The main text of whole pages: id, carried columns, text (blocks joined by \\n; '' if none), n_chars.

    Null and empty pages give ''.  Character references are decoded, white space inside a block
    becomes one space. Broken markup is read as far as it goes; a page without any tag is one block.
    Repeated rows give repeated results, null ids stay null, empty tables give empty results, and
    columns not named are ignored.
    """
    source = two_columns(pages, id_col, html_col, carry)
    names = ["_id", *["_c" + c for c in carry]]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x) for x in batch.column("_text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], texts], names=[*names, "text"])

    done = source.mapInArrow(extract, types + ", text string")
    return done.select(F.col("_id").alias(id_col), *[F.col(f"`_c{c}`").alias(c) for c in carry], "text", F.char_length("text").cast("long").alias("n_chars"))
