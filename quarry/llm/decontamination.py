"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of test items, run once over every text.

Item texts are normalised to lower-case words with single spaces; each run of `width` words is a pattern of the automaton,
with a space at both ends, so that matches are whole words. A document is normalised the same way, byte by byte, and read
once; only where something matched are the words' places in the original text looked up, so that the spans put out are
offsets of the original. The automaton is built in the workers, from windows whose size is counted first: beyond `most`
bytes the windows are dealt to several automata, each of which gets its own run over the texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, parts_of, settle, table, terms, terms_of, tidy

WIDTH = 10
#: A term in the original text, upper case not yet lowered.
_ANY_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SPANS = "array<struct<start:int,end:int>>"
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
#: The windows a worker built its automaton of last, and the automaton: later tasks of the worker use it again.
_built: list = [None, None]


def item_classes(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """cls, words, ids: items of equal words are one class, with the ids of all of them; those without words are left out."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), terms(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    return settle(rows.groupBy("words").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("cls", F.xxhash64("words", F.element_at("ids", 1))))


def windows_of(classes: DataFrame, width: int) -> DataFrame:
    """window, n (its words), classes: each distinct run of `width` words; of fewer words, all of them."""
    n = F.size("words")
    runs = F.when(n > width, F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.array_join(F.slice("words", i, F.lit(width)), " "))).otherwise(F.array(F.array_join("words", " ")))
    rows = classes.select("cls", F.least(n, F.lit(width)).alias("n"), F.explode(F.array_distinct(runs)).alias("window"))
    return settle(rows.groupBy("window").agg(F.first("n").alias("n"), F.array_sort(F.collect_set("cls")).alias("classes")))


class Windows:
    """The windows of one part and the ids of their classes, as the driver sends them."""

    def __init__(self, rows: list, ids: dict[int, list[str]]):
        self.patterns = [r["window"].encode() for r in rows]
        self.sizes = [r["n"] for r in rows]
        self.classes = [tuple(r["classes"]) for r in rows]
        self.ids = ids


def prepared(items: DataFrame, id_col: str, text_col: str, width: int, most: int) -> list[Broadcast]:
    """A broadcast for each part of the windows; a part has about `most` bytes of patterns and ids."""
    classes = item_classes(items, id_col, text_col)
    windows = windows_of(classes, width)
    held = windows.agg(F.sum(F.octet_length("window") + 8 * F.size("classes"))).first()[0] or 0
    held += classes.agg(F.sum(F.octet_length(F.array_join("ids", ",")))).first()[0] or 0
    parts, out = -(-held // most), []
    for p in range(parts):
        mine = windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == p)
        used = mine.select(F.explode("classes").alias("cls")).distinct()
        ids = {r["cls"]: r["ids"] for r in classes.join(used, "cls", "left_semi").select("cls", "ids").toLocalIterator()}
        out.append(items.sparkSession.sparkContext.broadcast(Windows(mine.collect(), ids)))
    return out


class Scanner:
    """One automaton with the windows it finds."""

    def __init__(self, windows: Windows):
        import ahocorasick

        self.windows, self.machine = windows, ahocorasick.Automaton()
        for i, pattern in enumerate(windows.patterns):
            self.machine.add_word(f" {pattern.decode('latin-1')} ", i)
        self.machine.make_automaton()

    @staticmethod
    def of(known: Broadcast) -> Scanner:
        if _built[0] is not known.value:
            _built[:] = [known.value, Scanner(known.value)]
        return _built[1]

    def find(self, utf8: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """(words of the text, its matches as (first word, word behind the last), the windows that matched)."""
        words = terms_of(utf8)
        if not words or not self.windows.patterns:
            return len(words), [], set()
        plain = b" %b " % b" ".join(words)
        ends, which = [], []
        for end, i in self.machine.iter(plain.decode("latin-1")):
            ends.append(end)
            which.append(i)
        if not ends:
            return len(words), [], set()
        behind = np.searchsorted(np.flatnonzero(np.frombuffer(plain, "u1") == 32), ends)
        return len(words), [(int(b) - self.windows.sizes[i], int(b)) for b, i in zip(behind, which, strict=True)], set(which)

    def ids(self, which: set[int]) -> set[str]:
        w = self.windows
        return set(chain.from_iterable(w.ids[c] for c in set(chain.from_iterable(w.classes[i] for i in which))))


def hit_words(n: int, matches: list[tuple[int, int]]) -> np.ndarray:
    """For each of n words, whether a match covers it."""
    edges = np.zeros(n + 1, "i8")
    at = np.array(matches, "i8").reshape(-1, 2)
    np.add.at(edges, at[:, 0], 1)
    np.add.at(edges, at[:, 1], -1)
    return np.cumsum(edges[:-1]) > 0


def spans_of(text: str, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of hit words begin and end in the original text, in characters."""
    places = np.array([m.span() for m in _ANY_TERM.finditer(text)], "i8").reshape(-1, 2)
    change = np.diff(np.concatenate([[False], hit, [False]]).astype("i1"))
    return places[np.flatnonzero(change == 1), 0], places[np.flatnonzero(change == -1) - 1, 1]


def scan(docs: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text", item_id_col="item_id", item_text_col="text", width: int = WIDTH, most: int = 4_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans for each row of docs.

    n_hit: words inside any occurrence of a window of an item; items: the ids, as sorted strings, of all items with such a
    window; spans: start and end, in characters of the original text, of each run of hit words. A null or empty text has no
    words. Items of fewer than `width` words are one window, items without words none; equal items keep all their ids, a
    null id counts as an empty one. Texts of any length are read whole. Repeated rows are each answered; other columns are
    left out. No items or no documents: nothing is hit, or no rows.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = found.schema["doc_id"].dataType.simpleString()
    windows = prepared(items, item_id_col, item_text_col, width, most) or [docs.sparkSession.sparkContext.broadcast(Windows([], {}))]
    for p, known in enumerate(windows):
        last = p == len(windows) - 1
        kind = f"doc_id {id_type}, {'' if last else 'text string, '}n_words long, n_hit long, items array<string>, spans {_SPANS}"
        found = found.mapInArrow(tidy(_pass(known, p > 0, last)), kind)
        if not last:
            found = settle(found)
    return found


def _pass(known: Broadcast, again: bool, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One automaton's run over the texts; `again`: on top of what earlier ones found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner.of(known)
        for batch in batches:
            for part, texts in parts_of(batch, batch.column(1)):
                rows = []
                before = part.select(["items", "spans"]).to_pylist() if again else [None] * len(part)
                for utf8, old in zip(texts.cast(pa.binary()).to_pylist(), before, strict=True):
                    n, matches, which = scanner.find(utf8 or b"")
                    ids = scanner.ids(which)
                    if not matches and not (old and old["spans"]):
                        rows.append((n, 0, [], []))
                        continue
                    text = utf8.decode()
                    if old and old["spans"]:
                        ids |= set(old["items"])
                        starts = [m.start() for m in _ANY_TERM.finditer(text)]
                        matches += [tuple(int(x) for x in np.searchsorted(starts, (s["start"], s["end"]))) for s in old["spans"]]
                    hit = hit_words(n, matches)
                    rows.append((n, int(hit.sum()), sorted(ids), [{"start": a, "end": b} for a, b in zip(*spans_of(text, hit), strict=True)]))
                n, hits, ids, spans = zip(*rows, strict=True) if rows else ((), (), (), ())
                out = [part.column(0), *([] if last else [part.column(1)]), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, _ARROW_SPANS)]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", *([] if last else ["text"]), "n_words", "n_hit", "items", "spans"])

    return run


def keep_clean(docs: DataFrame, items: DataFrame, *, text_col="text", item_id_col="item_id", item_text_col="text", width: int = WIDTH, most: int = 4_000_000) -> DataFrame:
    """The rows of docs that hold no window of an item, with all their columns, whatever their names. See scan for nulls, ties and short items."""
    for known in prepared(items, item_id_col, item_text_col, width, most):

        def decide(texts: list[str | None], known=known) -> list[bool]:
            scanner = Scanner.of(known)
            return [not scanner.find((text or "").encode())[1] for text in texts]

        docs = keep_rows(docs, text_col, decide)
    return docs


def op13_decontamination(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op13_decontamination": op13_decontamination}

ORACLE = {
    "op13_decontamination": r"""
with iw as (select coalesce(item_id::varchar, '') as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
ip as (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from iw where len(w) > 0),
win as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + 9], ' ') as win from ip),
d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
dp as (select r, w, s.n, unnest(range(1, len(w) - s.n + 2)) as i from d join (select distinct n from win) s on len(w) >= s.n),
m as (select r, i, win.n, item_id from (select r, i, n, array_to_string(w[i : i + n - 1], ' ') as win from dp) x join win on win.win = x.win and win.n = x.n),
h as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from m) group by r),
t as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from m) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (r) left join t using (r)
""",
}
