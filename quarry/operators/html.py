"""Text of web pages.

A page is read as a table of segments: tags and the runs of text between them. Running counts of open elements say for
each segment whether it is dropped and whether it stands in a cell; what a segment gives depends on these alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import bounded_batches, text_batches, tidy

# Elements that are dropped whole, that break lines, that are cells.
DROPPED = frozenset(("script", "style", "noscript", "nav", "header", "footer", "form", "button"))
BREAKING = frozenset(("p", "div", "br", "li", "ul", "ol", "tr", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6"))
CELLS = frozenset(("td", "th"))
#: Pictures of which the name is text: table symbols.
_SYMBOL = re.compile(r"[A-Za-z0-9/*+-]{1,4}")
_SEGMENT = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style)\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<more>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAMING = ("data-image-filename", "alt", "src")


def _picture(more: str) -> str:
    """The name of a picture, if it is a symbol's: of the first of its naming attributes that isn't empty, without folders and the last ending."""
    given = {k.lower(): unescape(a or b or c) for k, a, b, c in reversed(_ATTRIBUTE.findall(more))}
    name = next((given[k] for k in _NAMING if given.get(k)), "")
    stem = re.sub(r"(?s)^.*/|\.[^./]*$", "", name).strip()
    return stem if _SYMBOL.fullmatch(stem) else ""


def _open(segments: list[re.Match], elements: frozenset[str]) -> list[int]:
    """How many of the elements are open behind each segment. An end without a start counts for nothing, an element closed in its own tag is never open."""
    steps = [0 if m["name"] is None or m["name"].lower() not in elements or m["more"].endswith("/") and not m["end"] else -1 if m["end"] else 1 for m in segments]
    return list(accumulate(steps, lambda n, step: max(0, n + step), initial=0))[1:]


def page_text(html: str | None) -> str:
    """Lines of a page's text: cells parted by bars, a row on a line, boilerplate elements dropped, at most one empty line in a row."""
    segments = list(_SEGMENT.finditer(html or ""))
    given = []
    for m, hidden, cells in zip(segments, _open(segments, DROPPED), _open(segments, CELLS), strict=True):
        name = (m["name"] or "").lower()
        if m["text"] is not None:
            given.append("" if hidden else re.sub(r"\s+", " ", unescape(m["text"])))
        elif name in CELLS:
            given.append(" | " if m["end"] or m["more"].endswith("/") else "")
        elif name in BREAKING:
            given.append(" " if cells else "\n")
        elif name == "img" and not hidden:
            given.append(_picture(m["more"]))
    text = "".join(given).replace("\xa0", " ").replace("​", "")
    lines = [re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def clean_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_batches(batch, batch.column(1), 1_000_000):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([page_text(x) for x in texts], pa.string())], [id_col, "text"])

    bounded_batches(pages.sparkSession, 2_000_000)
    return pages.select(id_col, html_col).mapInArrow(tidy(run), f"{id_col} {pages.schema[id_col].dataType.simpleString()}, text string")
