"""Main text of HTML pages by block rules in two passes.

A page is cut into blocks at block-level tags. Pass one decides a block by the containers that it
stands in (menus, footers, adverts, forms and the like never hold main text), by link density, and
by length and stop-word density; short blocks stay open. Pass two gives an open block the label of
the nearest decided block, one inside its own container before one outside it, the block before it
at equal distance.

The names of classes and identifiers count in full inside an article: there a container is left out
only if its whole name says so ("comments", "article-footer"), and a heading or paragraph never is.
A header or banner inside an article stays if it holds a heading, which is the article's own, unless
it is named the site's; else it goes. Elsewhere one part of a name is enough.

Scanning takes time in proportion to the page, however malformed: a quoted value ends at the next
such quote, and a tag whose quotes never close ends at the next ">".

Cases: a null or empty page has an empty text; so has a page without blocks of main text; unclosed
and stray tags end where their container ends; an unclosed comment, script or style takes the rest
of the page; a "<" that opens no tag is text; a very long page is scanned whole, as one row; equal and
repeated pages have equal texts; other columns are kept, one of the name text or n_chars under a new
name with an underscore before it; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import fresh

# HTML element names by their role.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "canvas", "math", "xmp", "noembed", "noframes", "title"}
NEVER = {"nav", "footer", "aside", "form", "search", "head", "button", "select", "menu", "dialog", "fieldset", "datalist", "label", "audio", "video", "map"}
MAIN = {"article", "main"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol",
    "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES_ITSELF = {"p", "li", "dt", "dd", "option", "tr", "td", "th"}  # an open one ends where another begins
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Words in class, id and role that mark containers beside the main text.
BESIDE = {
    "ad", "ads", "advert", "advertisement", "adverts", "aside", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "consent", "cookie",
    "cookies", "copyright", "dialog", "disqus", "disclaimer", "footer", "form", "gdpr", "header", "hidden", "login", "masthead", "menu", "modal", "nav",
    "navbar", "navigation", "newsletter", "notice", "pagination", "paywall", "popup", "promo", "promoted", "recommended", "related", "remark", "replies",
    "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "tags",
    "toolbar", "widget", "contentinfo", "complementary", "alert", "feedback", "discussion",
}
# Words that mark a container inside an article, and words that may stand beside these in its name.
STRONG = {
    "ad", "ads", "advert", "advertisement", "adverts", "alert", "alerts", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "feedback", "footer", "form", "gdpr", "login",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "paywall", "popup", "promo", "promoted", "recommended", "related", "remark", "remarks", "replies",
    "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "widget", "widgets",
}
TOP = {"header", "banner"}  # of an article if they hold a heading
SITE = {"site", "global", "masthead"}
FILLER = {
    "area", "article", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "card", "col", "column", "container", "content", "entry", "form", "global", "group", "icons", "inner", "item", "left", "list", "links", "main",
    "message", "outer", "page", "panel", "post", "posts", "reader", "right", "row", "section", "site", "slot", "sticky", "stories", "story", "thread", "top", "unit", "user", "wrap", "wrapper",
}
# Common function words of English, German, French and Spanish.
STOP_WORDS = set(
    "a an and are as at be but by for from had has have he in is it its not of on or she that the this to was were which with you "
    "als auch auf aus bei das dem den der des die ein eine einen einer es für im in ist mit nicht sich sie sind und von war wie zu zum zur "
    "au aux avec ce dans de des du elle en est et il la le les leur mais ne ou par pas plus pour que qui sa se son sur un une "
    "al como con de del el en es esta ha la las lo los más no para pero por que se sin su sus un una y".split()
)
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_STOP = re.compile(r">|=[\t\n\f\r ]*([\"'])")  # a tag's end, or where a quoted value begins
NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
LONG, DENSE, SPARSE, LINKED = 40, 0.25, 0.12, 0.5


@dataclass
class Block:
    text: str
    tag: str
    links: int
    beside: bool
    main: bool
    container: int
    top: int = 0  # the header inside an article that it stands in, by number
    label: int = field(default=0)  # 1 main text, -1 not, 0 open


def says_beside(name: str, in_main: bool) -> bool:
    """Whether a class name, identifier or role marks a container beside the main text."""
    parts = [x.lower() for x in PARTS.findall(name)]
    if in_main:
        told = any(x in STRONG for x in parts) or any(x in TOP for x in parts) and any(x in SITE for x in parts)
        return told and all(x in STRONG or x in TOP or x in FILLER for x in parts)
    return any(x in BESIDE for x in parts)


def is_top(tag: str, attributes: str) -> bool:
    """Whether an element inside an article is a header of some kind."""
    if tag == "header":
        return True
    if "=" not in attributes or tag in ("html", "body", *MAIN, *HEADINGS, "p"):
        return False
    for m in NAMED.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            for name in (m[2] or "").strip("\"'").split():
                parts = [x.lower() for x in PARTS.findall(name)]
                if any(x in TOP for x in parts) and all(x in TOP or x in FILLER for x in parts):
                    return True
    return False


def is_beside(tag: str, attributes: str, in_main: bool) -> bool:
    """Whether the element holds no main text, by its name and attributes."""
    if tag in NEVER or tag == "header" and not in_main:
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    names = () if tag in ("html", "body", *MAIN, *HEADINGS, "p") else ("class", "id", "role")
    for m in NAMED.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in names and any(says_beside(x, in_main) for x in value.split()):
            return True
    return False


class Tags:
    """Finds where tags end. A failed search leaves marks, so that no later one walks the same way again."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.dead: set[int] = set()  # places outside quotes from which no end is found

    def end(self, at: int) -> int:
        """The place after the tag whose name ends at this place."""
        page, i, walked = self.page, at, []
        while i not in self.dead:
            walked.append(i)
            m = TAG_STOP.search(page, i)
            if m is None:
                break
            if m[1] is None:
                return m.end()
            close = page.find(m[1], m.end())
            if close < 0:
                break
            i = close + 1
        self.dead.update(walked)
        return page.find(">", at) + 1 or len(page)


@dataclass
class Open:
    """An element that is open, with what it takes from those around it."""

    tag: str
    beside: bool
    main: bool
    container: int
    depth: int  # of blocks
    block: tuple[str, bool, int]  # the nearest block's tag, whether main, container
    top: int = 0  # the header inside an article, by number


class Stack:
    """Open elements, with the places of each name."""

    def __init__(self) -> None:
        self.items: list[Open] = [Open("", False, False, 0, 0, ("", False, 0))]
        self.places: dict[str, list[int]] = {}

    def push(self, item: Open) -> None:
        self.places.setdefault(item.tag, []).append(len(self.items))
        self.items.append(item)

    def pop(self) -> None:
        self.places[self.items.pop().tag].pop()

    def close(self, tag: str) -> None:
        """End the last open element of this name, with all inside it; an inline one never ends a block."""
        if places := self.places.get(tag):
            at = places[-1]
            if tag in BLOCK or self.items[-1].depth == self.items[at].depth:
                while len(self.items) > at:
                    self.pop()


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order."""
    out: list[Block] = []
    stack, tags = Stack(), Tags(page)
    text: list[str] = []
    links = containers = tops = 0
    in_link = False

    def finish() -> None:
        nonlocal links
        joined = " ".join("".join(text).split())
        if joined:
            tag, main, container = stack.items[-1].block
            out.append(Block(joined, tag, links, stack.items[-1].beside, main, container, stack.items[-1].top))
        text.clear()
        links = 0

    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        after = page[begin + 1 : begin + 3] if begin >= 0 else ""
        while begin >= 0 and not (after[:1] in ("!", "?") or after[:1].isascii() and after[:1].isalpha() or after[:1] == "/"):
            begin = page.find("<", begin + 1)
            after = page[begin + 1 : begin + 3] if begin >= 0 else ""
        raw = page[at : begin if begin >= 0 else size]
        if raw:
            text.append(unescape(raw) if "&" in raw else raw)
            if in_link:
                links += len(raw.strip())
        if begin < 0:
            break
        if after[0] in "!?":
            close = "-->" if page.startswith("<!--", begin) else "]]>" if page.startswith("<![CDATA[", begin) else ">"
            end = page.find(close, begin + (4 if close == "-->" else 2))
            at = end + len(close) if end >= 0 else size
            continue
        closing = after[0] == "/"
        name = NAME.match(page, begin + 1 + closing)
        if name is None:  # "</" before anything but a letter
            at = page.find(">", begin) + 1 or size
            continue
        tag, at = name[0].lower(), tags.end(name.end())
        if tag == "br":
            text.append(" ")
            continue
        attributes = page[name.end() : at].removesuffix(">")
        if tag in RAW and not closing:
            if not attributes.rstrip().endswith("/"):
                end = RAW_END[tag].search(page, at)
                at = page.find(">", end.end()) + 1 or size if end else size
            continue
        if tag in BLOCK:
            finish()
        if tag == "a":
            in_link = not closing
        if tag in VOID:
            continue
        if closing:
            stack.close(tag)
            continue
        if tag in BLOCK:
            in_link = False
            while len(stack.items) > 1 and stack.items[-1].tag not in BLOCK and not stack.items[-1].beside:  # unclosed inline elements end with their block
                stack.pop()
            if stack.items[-1].tag == "p" or tag in CLOSES_ITSELF and stack.items[-1].tag == tag:
                stack.pop()
        above = stack.items[-1]
        main = above.main or tag in MAIN or 'role="main"' in attributes
        beside = above.beside or is_beside(tag, attributes, main)
        container = above.container
        if tag in BLOCK and (tag in MAIN or beside and not above.beside or tag in ("section", "div", "ul", "ol", "table")):
            containers += 1
            container = containers
        inside, top = tag in BLOCK, above.top
        if main and inside and not beside and not top and is_top(tag, attributes):
            tops += 1
            top = tops
        stack.push(Open(tag, beside, main, container, above.depth + inside, (tag, main, container) if inside else above.block, top))
    finish()
    headed = {b.top for b in out if b.tag in HEADINGS}
    for b in out:
        b.beside |= b.top > 0 and b.top not in headed
    return out


def decide(block: Block, has_main: bool) -> int:
    """Pass one: 1 main text, -1 not, 0 open."""
    if block.beside:
        return -1
    words = block.text.split()
    linked = block.links / max(1, len(block.text))
    dense = sum(w.strip(".,;:!?\"'()").lower() in STOP_WORDS for w in words) / len(words)
    if has_main and not block.main:
        return -1
    if linked > LINKED and not block.main:
        return -1
    if len(block.text) >= LONG and (dense >= DENSE or block.main):
        return 1
    if not block.main and len(block.text) >= 4 * LONG:
        return 1 if dense >= SPARSE else -1
    return 0


def nearest_decided(found: list[Block]) -> list[int | None]:
    """For each block the nearest decided one: inside its container before outside, the one before at equal distance."""
    out: list[int | None] = [None] * len(found)
    best = [(2, 0)] * len(found)
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: int | None = None
        inside: dict[int, int] = {}
        for i in order:
            for far, j in ((0, inside.get(found[i].container)), (1, last)):
                if j is not None and (far, abs(i - j)) < best[i]:
                    best[i], out[i] = (far, abs(i - j)), j
            if found[i].label:
                last = inside[found[i].container] = i
    return out


def main_text(page: str | None) -> str:
    """The main text: its blocks joined by line ends."""
    found = blocks(page) if page else []
    has_main = any(b.main and not b.beside for b in found)
    for b in found:
        b.label = decide(b, has_main)
    kept = []
    for b, near in zip(found, nearest_decided(found), strict=True):
        label = b.label
        if not label:
            label = 1 if near is None else found[near].label
            if b.main and not (near is not None and found[near].container == b.container and found[near].main):
                label = 1
        if label == 1:
            kept.append(b.text)
    return "\n".join(kept)


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """pages without the html, with text and n_chars."""
    own = {c: fresh([x for x in pages.columns if x != c] + ["text", "n_chars"], c) for c in pages.columns if c != html_col}
    kept = list(own.values())
    table = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], F.col(f"`{html_col}`").cast("string").alias("__html"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [main_text(x) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*kept, "text", "n_chars"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields[:-1])
    return table.mapInArrow(run, f"{types + ', ' if kept else ''}text string, n_chars long")
