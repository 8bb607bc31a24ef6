"""Parts of web pages: each start tag with its own end, however deep elements of the same name are nested.

Elements are intervals of the segment table of quarry.operators.html: an end tag ends the innermost open element of its name
and all that was opened inside it and never closed, so intervals nest and never cross.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, text_batches, tidy
from quarry.operators.html import _ATTRIBUTE, _SEGMENT, page_text

# Elements without an end tag; those that begin and end lines in a page's text.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
LINES = frozenset(("p", "li", "h2", "h3", "h4", "h5", "h6", "div"))


@dataclass(frozen=True)
class Element:
    """Where an element begins, its content begins and ends, and it ends; how many elements it stands in."""

    name: str
    attributes: str
    begin: int
    inside: int
    until: int
    end: int
    depth: int

    def has(self, name: str, key: str | None = None, word: str | None = None) -> bool:
        """Whether it is such an element; with a key: whether that attribute holds the word among others."""
        if self.name != name:
            return False
        given = {k.lower(): unescape(a or b or c) for k, a, b, c in reversed(_ATTRIBUTE.findall(self.attributes))} if key else {}
        return not key or word in given.get(key, "").split()


def elements(html: str) -> list[Element]:
    """All elements of a page in order of their start tags. An end tag without a start counts for nothing, what is never closed ends where that does
    which it stands in, and at the end of the page at last."""
    found: list[Element | None] = []
    held: list[tuple[int, str, re.Match]] = []

    def close(upto: int, until: int, end: int) -> None:
        while len(held) > upto:
            at, name, m = held.pop()
            found[at] = Element(name, m["more"], m.start(), m.end(), until, end if len(held) == upto else until, len(held))

    for m in _SEGMENT.finditer(html):
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            at = next((i for i in range(len(held) - 1, -1, -1) if held[i][1] == name), None)
            if at is not None:
                close(at, m.start(), m.end())
        elif name in VOID or m["more"].endswith("/"):
            found.append(Element(name, m["more"], m.start(), m.end(), m.end(), m.end(), len(held)))
        else:
            held.append((len(found), name, m))
            found.append(None)
    close(0, len(html), len(html))
    return [x for x in found if x is not None]


@dataclass(frozen=True)
class Rule:
    """Elements to strip: by name and a word of an attribute; `within`: only those whose source holds it; `which`: all, the first, or only one that
    the page begins with (before anything but white space and start tags named in `behind`)."""

    name: str
    key: str | None = None
    word: str | None = None
    within: str | None = None
    which: str = "all"
    behind: tuple[str, ...] = ()


# What the sections of four publishers begin with or hold besides their text.
HEADING = Rule("h4", which="first")
HISTORY = Rule("div", "class", "history", which="leading")
NAMED = Rule("div", "class", "phx-name", which="leading", behind=("div",))
CRUMBS = Rule("p", within="H1_H2_Ref")


def strip(html: str, rules: tuple[Rule, ...]) -> str:
    """A page without the elements that a rule names, rule by rule; of elements inside each other the outer goes."""
    for rule in rules:
        every = elements(html)
        chosen = [e for e in every if e.has(rule.name, rule.key, rule.word) and (rule.within is None or rule.within in html[e.begin : e.end])]
        if rule.which == "leading":
            opened = "".join(rf"<{x}\b[^>]*>\s*" for x in rule.behind)
            chosen = [e for e in chosen[:1] if re.fullmatch(rf"\s*{opened}", html[: e.begin], re.IGNORECASE)]
            # With the element go those it was the whole of.
            chosen += [x for x in every for e in chosen if x.begin < e.begin and e.end <= x.end and x.name in rule.behind and not html[e.end : x.until].strip()]
        elif rule.which == "first":
            chosen = chosen[:1]
        at, kept = 0, []
        for e in sorted(chosen, key=lambda e: e.begin):
            if e.begin >= at:
                kept.append(html[at : e.begin])
                at = e.end
        html = "".join(kept) + html[at:]
    return html


def container_text(html: str, name: str, key: str | None = None, word: str | None = None, skip: tuple[str, ...] = ("h1",)) -> str:
    """The text of the first such element, without the elements of `skip` in it, lines as its blocks and breaks make them; the whole page's text
    where there is no such element or it is empty."""
    every = elements(html)
    box = next((e for e in every if e.has(name, key, word)), None)
    lines: list[str] = []
    if box:
        hidden = [(e.begin, e.end) for e in every if e.name in skip and box.inside <= e.begin and e.end <= box.until]
        given = []
        for m in _SEGMENT.finditer(html, box.inside, box.until):
            if any(a <= m.start() < b for a, b in hidden):
                continue
            if m["text"] is not None:
                given.append(unescape(m["text"]))
            elif m["name"] and (m["name"].lower() in LINES or m["name"].lower() == "br" and not m["end"]):
                given.append("\n")
        for line in "".join(given).split("\n"):
            line = re.sub(r"[ \t\r\f\v]+", " ", line).strip()
            if line or (lines and lines[-1]):
                lines.append(line)
    return "\n".join(lines).strip() or page_text(html)


def _each(pages: DataFrame, id_col: str, html_col: str, name: str, change: Callable[[str], str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_batches(batch, batch.column(1), 1_000_000):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([change(x or "") for x in texts], pa.string())], [id_col, name])

    bounded_batches(pages.sparkSession, 2_000_000)
    return pages.select(id_col, F.col(html_col).cast("string")).mapInArrow(tidy(run), f"{id_col} {pages.schema[id_col].dataType.simpleString()}, {name} string")


def stripped_pages(pages: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, html) of each page without what the rules name; a null page is empty."""
    return _each(pages, id_col, html_col, "html", lambda html: strip(html, rules))


def container_texts(pages: DataFrame, name: str, key: str | None = None, word: str | None = None, skip: tuple[str, ...] = ("h1",), id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of each page: see container_text; a null page is empty."""
    return _each(pages, id_col, html_col, "text", lambda html: container_text(html, name, key, word, skip))
