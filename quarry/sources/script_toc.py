"""Tables of contents that publishing tools write as scripts.

A site has one tree file, `({numchunks:2,prefix:'Chunk',tree:{n:[{i:0,n:[{i:1}]}]}})`, and chunk files with the entries by
page in columns, `({'/Content/a.htm':{i:[0,1],t:['A','A.1'],b:['','#x']}})`: numbers, titles and anchors that belong
together by their places. Literals are read by a tolerant parser: keys bare or quoted, either kind of quotes, comments,
commas too many. Most become JSON by a few substitutions and are read as that; only the others are read token by token.
A file that can't be read gives an error and no entries; the others of its site count all the same.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.trees import climb
from quarry.sources.tables import settled

_TOKEN = re.compile(
    r"\s+|//[^\n]*|/\*.*?\*/"
    r"|(?P<mark>[{}\[\]:,])"
    r"|'(?P<one>(?:[^'\\]|\\.)*)'|\"(?P<two>(?:[^\"\\]|\\.)*)\""
    r"|(?P<bare>[^\s{}\[\]:,'\"/]+)",
    re.DOTALL,
)
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.))", re.DOTALL)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}
_WORDS = {"true": True, "false": False, "null": None, "undefined": None}
_CLOSES = {"}": dict, "]": list}
# Strings and comments, up to the end of the script where they don't end; without going back, so that a broken one costs no more than its length.
_PIECE = re.compile(r"('[^'\\]*+(?:\\.[^'\\]*+)*+'?|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"?|//[^\n]*+|/\*.*?(?:\*/|\Z))", re.DOTALL)
_KEY = re.compile(r"(?<![\w$])([A-Za-z_$][\w$]*+)(?=[ \t\r\n]*+:)")
_MORE = re.compile(r",(?=[ \t\r\n]*+[}\]])")
_HREF = re.compile(r"\.html?$")


def _text(quoted: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), quoted)


def _word(bare: str) -> object:
    if bare in _WORDS:
        return _WORDS[bare]
    return int(bare) if re.fullmatch(r"-?\d+", bare) else float(bare) if re.fullmatch(r"-?\d*\.\d+(?:[eE][-+]?\d+)?", bare) else bare


_JSON = json.JSONDecoder(parse_float=_word, parse_constant=str)


def _quoted(piece: str) -> str:
    """A string of a script as one of JSON, a comment as a space."""
    if piece[0] == "/":
        return " "
    inner = piece[1:-1]
    return encode_basestring(_text(inner) if "\\" in inner else inner)


def _as_json(script: str) -> dict | list | None:
    """What literal() finds at the start of a script, if a few substitutions make JSON of it; else None. They keep each token as it is, and
    all that JSON takes means the same in a script, so that None is the only other answer."""
    pieces = _PIECE.split(script)
    between = "\0".join(pieces[::2])
    if between.count("\0") != len(pieces) // 2 or "/" in between or (len(pieces) > 1 and not _TOKEN.fullmatch(pieces[-2])):
        return None
    pieces[::2] = _MORE.sub("", _KEY.sub(r'"\1"', between)).split("\0")
    pieces[1::2] = map(_quoted, pieces[1::2])
    try:
        return _JSON.raw_decode("".join(pieces))[0]
    except (ValueError, RecursionError):
        return None


def literal(script: str, start: int = 0) -> dict | list:
    """The object or list that begins at `start` of a script, of any depth. ValueError says where it is broken."""
    found = _as_json(script[start:]) if script.startswith(("{", "["), start) else None
    return _by_tokens(script, start) if found is None else found


def _by_tokens(script: str, start: int) -> dict | list:
    """literal() token by token."""
    held: list[tuple[dict | list, list]] = []  # what is open, each object with its key and whether the colon was read
    at = start
    while m := _TOKEN.match(script, at):
        value, is_value = None, False
        mark = m["mark"]
        if mark in ("{", "["):
            held.append(({} if mark == "{" else [], []))
        elif mark in ("}", "]"):
            if not held or not isinstance(held[-1][0], _CLOSES[mark]) or held[-1][1]:
                raise ValueError(f"'{mark}' out of place at {at}")
            value, is_value = held.pop()[0], True
            if not held:
                return value
        elif mark == ":":
            if not held or len(held[-1][1]) != 1:
                raise ValueError(f"':' out of place at {at}")
            held[-1][1].append(True)
        elif mark == ",":
            if not held or held[-1][1]:
                raise ValueError(f"',' out of place at {at}")
        elif m["one"] is not None or m["two"] is not None:
            value, is_value = _text(m["one"] if m["one"] is not None else m["two"]), True
        elif m["bare"]:
            value, is_value = _word(m["bare"]), True
        if is_value:
            if not held:
                raise ValueError(f"no object or list at {at}")
            inside, key = held[-1]
            if isinstance(inside, list):
                inside.append(value)
            elif not key and not isinstance(value, dict | list):
                key.append(str(m["bare"] or value))
            elif len(key) == 2:
                inside[key[0]] = value
                key.clear()
            else:
                raise ValueError(f"value out of place at {at}")
        at = m.end()
    raise ValueError(f"ends at {at} with {len(held)} open" if at >= len(script) else f"can't be read at {at}")


def parents(tree: dict) -> tuple[list[int], list[int | None]]:
    """(numbers, the number of each one's parent or None), in the tree's order. What has no number is left out with all below it."""
    numbers, above, todo = [], [], [(x, None) for x in reversed(tree.get("n") or [])]
    while todo:
        entry, parent = todo.pop()
        number = entry.get("i") if isinstance(entry, dict) else None
        if isinstance(number, int) and not isinstance(number, bool):
            numbers.append(number)
            above.append(parent)
            todo += [(x, number) for x in reversed(entry.get("n") or [])]
    return numbers, above


_PAGE = "struct<href:string,i:array<int>,t:array<string>,b:array<string>>"
_ARROW_PAGE = pa.struct([("href", pa.string()), ("i", pa.list_(pa.int32())), ("t", pa.list_(pa.string())), ("b", pa.list_(pa.string()))])


def _read(script: str | None) -> tuple:
    """(error, chunks, prefix, numbers, parents, pages) of one script."""
    try:
        start = (script or "").find("{")
        if start < 0:
            raise ValueError("no object")
        value = literal(script, start)
        if "tree" in value or "numchunks" in value:
            if not isinstance(value.get("numchunks"), int) or not isinstance(value.get("prefix"), str):
                raise ValueError("no numchunks or prefix")
            numbers, above = parents(value["tree"]) if isinstance(value.get("tree"), dict) else ([], [])
            return None, value["numchunks"], value["prefix"], numbers, above, []
        pages = []
        for href, columns in value.items():
            if _HREF.search(href) and isinstance(columns, dict):
                i, t, b = (columns.get(k) if isinstance(columns.get(k), list) else [] for k in "itb")
                pages.append({"href": href, "i": [x if isinstance(x, int) else None for x in i], "t": [str(x) for x in t], "b": [str(x) for x in b]})
        return None, None, None, [], [], pages
    except ValueError as error:
        return str(error), None, None, [], [], []


def read_scripts(scripts: DataFrame, site: str = "site", name: str = "name", body: str = "body") -> DataFrame:
    """site, name, error, chunks, prefix, numbers, parents, pages: one row for each script, its columns as they stand in it. A null, empty or
    broken script has an error; repeated scripts give a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            error, chunks, prefix, numbers, above, pages = zip(*[_read(x.as_py()) for x in batch.column(2)], strict=True) if len(batch) else [()] * 6
            lists = pa.list_(pa.int32())
            out = [pa.array(error, pa.string()), pa.array(chunks, pa.int32()), pa.array(prefix, pa.string()), pa.array(numbers, lists), pa.array(above, lists), pa.array(pages, pa.list_(_ARROW_PAGE))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], ["site", "name", "error", "chunks", "prefix", "numbers", "parents", "pages"])

    kind = f"site {scripts.schema[site].dataType.simpleString()}, name string, error string, chunks int, prefix string, numbers array<int>, parents array<int>, pages array<{_PAGE}>"
    return scripts.select(site, F.col(name).cast("string"), body).mapInArrow(run, kind)


def entries(read: DataFrame) -> DataFrame:
    """site, i, parent, href, title, anchor: the entries of all chunks under the tree of their site. Titles and anchors that a page has too few of
    are empty; entries that the tree lacks have no parent; of entries that share a number in a site the one with the least href and place counts."""
    page = read.select("site", F.explode("pages").alias("p"))
    at = page.select("site", F.col("p.href").alias("href"), F.posexplode(F.arrays_zip("p.i", "p.t", "p.b")).alias("place", "e")).where("e.i is not null")
    one = at.select("site", F.col("e.i").alias("i"), F.struct("href", "place", F.trim(F.coalesce("e.t", F.lit(""))).alias("title"), F.coalesce("e.b", F.lit("")).alias("anchor")).alias("x")).groupBy("site", "i").agg(F.min("x").alias("x"))
    up = read.select("site", F.explode(F.arrays_zip("numbers", "parents")).alias("e")).groupBy("site", F.col("e.numbers").alias("i")).agg(F.min("e.parents").alias("parent"))
    return one.join(up, ["site", "i"], "left").select("site", "i", "parent", "x.href", "x.title", "x.anchor")


def paths(rows: DataFrame) -> DataFrame:
    """rows, as of entries(), with path: the titles of an entry's ancestors and its own, from the root down. Only entries that are a parent
    climb, mostly few beside the others; each entry then takes over its parent's path, in one join."""
    rows = settled(rows)
    above = rows.where("parent is not null").select("site", F.col("parent").alias("i")).distinct()
    key = F.struct("site", "i")
    found = climb(rows.join(above, ["site", "i"], "left_semi").select(key.alias("node"), F.when(F.col("parent").isNotNull(), F.struct("site", F.col("parent").alias("i"))).alias("parent"), "title"), label=F.col("title"))
    found = found.select("node.site", F.col("node.i").alias("parent"), F.col("path").alias("__above"))
    path = F.concat(F.coalesce("__above", F.array().cast("array<string>")), F.array("title"))
    return rows.join(found, ["site", "parent"], "left").select(*rows.columns, path.alias("path"))
