"""Main text of web pages by two passes of block rules.

Markup is cut into blocks with their length, link share and enclosing elements.
First pass: blocks inside boilerplate elements (navigation, footers, sidebars,
forms, adverts, notices, comments, by element, role, or a class that says nothing
else) are bad; of the rest, link share, length and stop-word density make a block
good, bad or leave it undecided if it is short or in between. On a page where stop
words make no block good, because its language is not of the lists or hardly has
any, link share and length decide alone, with sentence marks or a script that
writes no spaces. A class that names boilerplate beside another word
(``share-price``) is only a hint: long dense blocks in it are good, short ones take
the label of their nearest decided neighbour in that box.

Second pass: an undecided block takes the label of the nearest decided block before
or after it in its section (the enclosing article or main element if there is one);
a good one wins a tie, and a section with none decided takes the label of the
section's kind.

Defined results: null and empty html give an empty text; broken and cut-off
markup is read as far as it goes; repeated rows are extracted row by row; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_LINKS, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.4, 70, 200, 0.12, 0.22
_ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(script|style|noscript|template|svg|math|iframe|object|canvas|video|audio|textarea|select|button|title)\b{_ATTRS}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-z][a-z0-9:-]*)({_ATTRS})(?:>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-label|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
BLOCKS = set("p div section article main h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table tr td th tbody thead tfoot caption blockquote pre figure figcaption address hr header footer nav aside form fieldset body html head center details summary menu dialog".split())
CONTAINERS = BLOCKS - set("p hr html li dt dd tr td th tbody thead tfoot".split())
BAD_ELEMENTS = set("nav footer aside form menu dialog head fieldset".split())
BAD_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BAD_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs crumbs footer "
    "comment comments commentlist reply replies discussion disqus cookie cookies consent notice notices gdpr alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations trending teaser widget toolbar pagination pager masthead topbar copyright legal disclaimer form search skip tags taglist outbrain taboola paywall".split()
)
GOOD_NAMES = set("article content main post entry story body text page wrapper container layout".split())
#: Words of class names that say nothing of their own.
PLAIN_NAMES = set("box wrap inner outer item items list block bar unit left right top bottom section area panel button buttons link links icon icons col row module region holder group site global primary secondary desktop mobile js fixed sticky small large".split())
#: Scripts that write no spaces between words, where a character weighs more.
SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Marks that end sentences, and how a line of ownership begins.
SENTENCE = re.compile("[.!?\u2026\u3002\uff01\uff1f\u0964\u06d4\u061f\u0589\u1362](?:\\s|[\"'\u201d\u300d)]|$)")
OWNER = re.compile(r"\s*(?:\u00a9|\(c\)|copyright\b)", re.I)
STOPS = set(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over me even most made after also did many before must through back where much your "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei "
    "le la les de des du un une et est en que qui dans pour pas sur au par il plus ce ne se son avec aux ou elle mais sont été cette ses être fait comme nous vous on tout "
    "el los las una y del por con para su al lo como más pero sus ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos uno ni ese eso "
    "il di che non si da sono una della nel alla più ha gli anche delle dei o do da em os no na uma para com não dos mais het een van ik dat je op te zijn niet".split()
)


class _Open:
    __slots__ = ("bad", "box", "name", "section")

    def __init__(self, name: str, bad: bool, section: int, box: int):
        self.name, self.bad, self.section, self.box = name, bad, section, box


class Block(NamedTuple):
    text: str
    links: int  # characters in links
    bad: bool  # in boilerplate
    section: int  # number of the article or main element, or 0
    element: str
    box: int  # number of the element whose class hints at boilerplate, or 0


def _named(value: str, inside: bool) -> int:
    """What class or id names say: 2 boilerplate, 1 a hint of it, 0 nothing."""
    found = 0
    for token in value.split():
        parts = set(re.findall(r"[a-z0-9]+", token))
        if parts & {"comment", "comments", "sidebar"} and not parts & {"with", "has", "no"}:
            return 2
        if parts & GOOD_NAMES:
            continue
        if "header" in parts and not inside:
            return 2
        if parts & BAD_NAMES:
            found = max(found, 2 if all(x in BAD_NAMES or x in PLAIN_NAMES or x.isdigit() for x in parts) else 1)
    return found


def _suspect(name: str, attrs: str, inside: bool) -> int:
    """Whether an element's name and attributes mark boilerplate, 2, or hint at it, 1; `inside`: within an article."""
    if name in ("body", "html"):
        return 0
    if name in BAD_ELEMENTS or name == "header" and not inside:
        return 2
    found = 0
    for key, value in ATTR.findall(attrs) if attrs else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 2
        if key == "role" and value in BAD_ROLES:
            return 2
        if key in ("class", "id"):
            found = max(found, _named(value, inside))
    return found


def blocks(page: str) -> list[Block]:
    """The blocks in page order."""
    out: list[Block] = []
    stack: list[_Open] = []
    text: list[str] = []
    links = sections = boxes = depth = at = 0
    element = "body"

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                top = stack[-1] if stack else None
                out.append(Block(joined, min(links, len(joined)), bool(top and top.bad), top.section if top else 0, element, top.box if top else 0))
            text.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        part = entities.unescape(raw) if "&" in raw else raw
        text.append(part)
        if depth:
            links += len(part.strip())

    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if not name:
            continue  # comments, scripts and the like
        name, closing, attrs = name.lower(), (m[2] or m[5]) == "/", m[4] or m[7] or ""
        if name == "a":
            depth = 0 if closing else 1
        elif name == "br":
            text.append(" ")
        elif name in BLOCKS:
            flush()
            depth = 0
            element = "body" if closing else name
            if name not in CONTAINERS:
                continue
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name == name:
                        del stack[k:]
                        break
            else:
                top = stack[-1] if stack else None
                own = _suspect(name, attrs, bool(top and top.section))
                section, box = (top.section, top.box) if top else (0, 0)
                bad = own == 2 or bool(top and top.bad)
                if own == 1 and not box:
                    boxes += 1
                    box = boxes
                if name in ("article", "main") and own != 2:
                    box = 0
                    if not (top and top.section):
                        sections += 1
                        section = sections
                    # An article frees itself of a box that was never closed, but not of a comment list or an aside.
                    bad = any(x.bad and x.name in BAD_ELEMENTS for x in stack)
                    if top and top.bad and top.section:
                        bad = True
                stack.append(_Open(name, bad, section, box))
    if at < len(page):
        add(page[at:])
    flush()
    return out


def _size(text: str) -> int:
    """Length in letters of a spaced script: one character of the others stands for about two and a half."""
    return len(text) if text.isascii() else len(text) + 3 * len(SPACELESS.findall(text)) // 2


def _stops(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?") in STOPS for w in words) / len(words)


def _by_stops(b: Block) -> str:
    """The label of a block of some length and few links, by its share of stop words."""
    stops = _stops(b.text)
    if stops >= STOP_HIGH or b.section and stops >= STOP_LOW:
        return "good"
    return "undecided" if stops >= STOP_LOW or b.section or _size(b.text) < LONG and b.element[0] == "h" else "bad"


def _by_length(b: Block) -> str:
    """The same by length alone."""
    written = SENTENCE.search(b.text) or len(SPACELESS.findall(b.text)) > len(b.text) / 3
    return "good" if written and (_size(b.text) >= LONG or b.section) else "undecided"


def _first_pass(b: Block, rule: Callable[[Block], str]) -> str:
    if b.bad:
        return "bad"
    size, share = _size(b.text), b.links / len(b.text)
    if not b.section and size < LONG and OWNER.match(b.text):
        return "bad"
    if share > MAX_LINKS:
        return "bad" if b.element != "p" or not b.section else "undecided"
    if b.box:
        return "good" if size >= LONG and share <= MAX_LINKS / 2 and rule(b) == "good" else "undecided"
    return "undecided" if size < SHORT else rule(b)


def _second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Which blocks are good, once each undecided one has the label of its nearest decided neighbour."""
    near: list[list[tuple[int, str] | None]] = []  # for each block the nearest decided one of its section and box, before and after
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: dict[tuple[int, int], tuple[int, str]] = {}
        side: list[tuple[int, str] | None] = [None] * len(found)
        for i in order:
            b = found[i]
            side[i] = last.get((b.section, b.box))
            if labels[i] != "undecided" and not (b.bad and b.section):
                last[b.section, b.box] = (i, labels[i])
        near.append(side)
    out = []
    for i, b in enumerate(found):
        label = labels[i]
        if label == "undecided":
            both = [(abs(i - x[0]), x[1] != "good") for x in (near[0][i], near[1][i]) if x]
            label = ("bad" if min(both)[1] else "good") if both else ("good" if b.section and not b.box else "bad")
            if not b.section and near[0][i] is None:
                # Outside of an article a title before the first good block goes with it.
                after = near[1][i]
                label = "good" if after and after[1] == "good" else label
        out.append(label == "good")
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    labels = [_first_pass(b, _by_stops) for b in found]
    if "good" not in labels:
        labels = [_first_pass(b, _by_length) for b in found]
    return " ".join(b.text for b, good in zip(found, _second_pass(found, labels), strict=True) if good)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                texts = [main_text(x) for x in batch.column(2).to_pylist()]
                cols = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
