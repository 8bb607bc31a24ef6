"""Ranked lexical search for a stated set of queries: WAND over document shards.

One pass over the texts keeps, of each document, the terms that any query has, with their counts, and the corpus's own
sums. A shard is some of these documents, in one task: its postings by term, each with the score it adds and the term's
largest. For a query, ids are walked in blocks that double. The threshold is the k-th best score of the shard so far;
terms whose maxima together don't reach it can't bring a document in, so only postings of the others are read, and of
those documents only pivots, whose terms' maxima reach the threshold, are scored. The best k of each shard are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_of, settle, table, terms, terms_of, tidy

K = 50
#: What 1,000 * tf / (tf + 0.02 * m) is counted in.
_UNIT = 1_000_000_000
_LAST = np.iinfo("i8").max


def query_classes(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(item_id, cls for each item with terms; cls, terms). Rows of one id are one item; items of equal terms are one class."""
    words = items.select(F.col(id_col).alias("item_id"), F.explode(terms(F.col(text_col))).alias("term"))
    mine = settle(words.groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms")).withColumn("cls", F.md5(F.array_join("terms", " "))))
    return mine.select("item_id", "cls"), mine.groupBy("cls").agg(F.first("terms").alias("terms"))


class Queries:
    """Some classes of queries, as the driver sends them: a number for each term, and each class's numbers."""

    def __init__(self, rows: list):
        self.numbers: dict[bytes, int] = {}
        self.names = [r["cls"] for r in rows]
        self.terms = [np.array([self.numbers.setdefault(t.encode(), len(self.numbers)) for t in r["terms"]], "i4") for r in rows]


_INDEX = "n_docs long, n_words long, ids array<long>, words array<long>, sizes array<int>, terms array<int>, counts array<int>, seen array<int>, held array<long>"


def index_of(docs: DataFrame, id_col: str, text_col: str, known: Broadcast) -> DataFrame:
    """Rows for some MB of texts each: how many documents have terms, their terms in all; of the documents that have terms of the queries
    (ids, words: terms in all) how many different ones (sizes), which and how often (terms, counts); and for each, in how many documents (seen, held)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.numbers.get
        for batch in batches:
            for part, texts in parts_of(batch, batch.column(1)):
                n_docs, n_words, ids, words, sizes, which, counts = 0, 0, [], [], [], [], []
                for doc_id, utf8 in zip(part.column(0).to_pylist(), texts.cast(pa.binary()).to_pylist(), strict=True):
                    own = terms_of(utf8 or b"")
                    n_docs, n_words = n_docs + bool(own), n_words + len(own)
                    met = np.array([i for i in map(number, own) if i is not None], "i4")
                    if len(met):
                        different, often = np.unique(met, return_counts=True)
                        ids.append(doc_id)
                        words.append(len(own))
                        sizes.append(len(different))
                        which.append(different)
                        counts.append(often.astype("i4"))
                which, counts = (np.concatenate(x) if x else np.zeros(0, "i4") for x in (which, counts))
                seen, held = np.unique(which, return_counts=True)
                lists = [pa.array([x], pa.list_(t)) for x, t in ((ids, pa.int64()), (words, pa.int64()), (sizes, pa.int32()), (which, pa.int32()), (counts, pa.int32()), (seen, pa.int32()), (held, pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_words]), *lists], [c.split()[0] for c in _INDEX.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(run), _INDEX)


def term_weight(n_docs: int, held: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held + 1)))


class Shard:
    """Postings of some documents by term. A document's number is its place in the order of ids (null last), so that of equal scores the first counts."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, sizes: np.ndarray, which: np.ndarray, counts: np.ndarray, weights: np.ndarray, n_docs: int, n_words: int):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), "i4")
        place[order] = np.arange(len(ids), dtype="i4")
        self.ids = ids[order]
        length = 50 + 50 * words * n_docs // n_words
        often = counts.astype("i8")
        adds = weights[which] * (_UNIT * often // (1000 * often + 20 * np.repeat(length, sizes)))
        docs = np.repeat(place, sizes)
        order = np.lexsort((docs, which))
        self.docs, self.adds = docs[order], adds[order]
        self.terms, self.begins = np.unique(which[order], return_index=True)
        self.ends = np.append(self.begins[1:], len(which))
        self.most = np.maximum.reduceat(self.adds, self.begins) if len(which) else np.zeros(0, "i8")

    def postings(self, query: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(documents, what the term adds to each, the largest of it) for each of a query's terms that the shard has, smallest maxima first."""
        at = np.flatnonzero(np.isin(self.terms, query, assume_unique=True) & (self.most > 0))
        return [(self.docs[self.begins[i] : self.ends[i]], self.adds[self.begins[i] : self.ends[i]], int(self.most[i])) for i in at[np.argsort(self.most[at], kind="stable")]]


def wand(postings: list[tuple[np.ndarray, np.ndarray, int]], n: int, k: int, first: int = 512, most: int = 32_768) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, how many were scored): the k best of n documents with a score, best first, ties to the smaller number."""
    reach = np.cumsum([m for _, _, m in postings])
    best, scores, scored = np.zeros(0, "i4"), np.zeros(0, "i8"), 0
    threshold, start, size = 1, 0, first
    while start < n and len(postings):
        stop, size = min(n, start + size), min(2 * size, most)
        # The terms before `free` don't reach the threshold, even together.
        free = int(np.searchsorted(reach, threshold, "left"))
        if free == len(postings):
            break
        bound = np.zeros(stop - start, "i8")
        for docs, _, m in postings[free:]:
            low, high = np.searchsorted(docs, np.array([start, stop], docs.dtype))
            bound[docs[low:high] - start] += m
        pivots = (np.flatnonzero((bound > 0) & (bound + (reach[free - 1] if free else 0) >= threshold)) + start).astype("i4")
        if len(pivots):
            total = np.zeros(len(pivots), "i8")
            for docs, adds, _ in postings:
                at = np.minimum(np.searchsorted(docs, pivots), len(docs) - 1)
                total += np.where(docs[at] == pivots, adds[at], 0)
            scored += len(pivots)
            best, scores = np.concatenate([best, pivots]), np.concatenate([scores, total])
            order = np.lexsort((best, -scores))[:k]
            best, scores = best[order], scores[order]
            # Blocks go by rising numbers: a later document has to score more than the k-th best.
            threshold = max(1, int(scores[-1]) + 1) if len(best) == k else 1
        start = stop
    return best, scores, scored


def search(docs: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text", item_id_col="item_id", item_text_col="text", k: int = K, most_terms: int = 500_000, shard: int = 65_536, postings: int = 3_000_000) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of the highest score above 0, equal scores by ascending doc_id (null last).

    Weights and lengths as in BM25, in whole numbers. Items go in blocks of about `most_terms` terms, `shard` documents or
    `postings` postings bound what a task holds. A null or empty text has no terms; items without terms, or whose terms no
    document has, have no rows; rows of one item_id (or without any) are one item. Repeated documents are ranked each; texts
    of any length are read whole; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    named, classes = query_classes(items, item_id_col, item_text_col)
    classes = settle(classes)
    blocks = -(-(classes.agg(F.sum(F.size("terms"))).first()[0] or 0) // most_terms)
    found = None
    for b in range(blocks):
        asked = spark.sparkContext.broadcast(Queries(classes.where(F.pmod(F.xxhash64("cls"), F.lit(blocks)) == b).collect()))
        index = settle(index_of(docs, id_col, text_col, asked))
        sums = index.agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("words"), F.sum(F.size("ids")).alias("rows")).first()
        if not sums["rows"]:
            continue
        pairs = F.explode(F.arrays_zip("seen", "held"))
        held = index.select(pairs.alias("p")).groupBy("p.seen").agg(F.sum("p.held").alias("held")).collect()
        weights = np.zeros(len(asked.value.numbers), "i8")
        for r in held:
            weights[r["seen"]] = term_weight(sums["n"], r["held"])
        tasks = max(spark.sparkContext.defaultParallelism, -(-sums["rows"] // shard))
        best = settle(index.select("ids", "words", "sizes", "terms", "counts").coalesce(tasks).mapInArrow(tidy(_shards(asked, spark.sparkContext.broadcast(weights), sums["n"], sums["words"], k, shard, postings)), "cls string, doc_id long, score long"))
        found = best if found is None else found.unionAll(best)
    if found is None:
        return spark.createDataFrame([], f"item_id {items.schema[item_id_col].dataType.simpleString()}, rank int, doc_id long, score long")
    order = Window.partitionBy("cls").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    merged = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return named.join(merged, "cls").select("item_id", "rank", "doc_id", "score")


def _shards(asked: Broadcast, weights: Broadcast, n_docs: int, n_words: int, k: int, most_docs: int, most_postings: int):
    def best_of(held: list[tuple]) -> pa.RecordBatch:
        shard = Shard(*[np.concatenate(x) for x in zip(*held, strict=True)], weights.value, n_docs, n_words)
        names, ids, scores = [], [], []
        for name, query in zip(asked.value.names, asked.value.terms, strict=True):
            best, score, _ = wand(shard.postings(query), len(shard.ids), k)
            names += [name] * len(best)
            ids.append(shard.ids[best])
            scores.append(score)
        ids = np.concatenate(ids) if ids else np.zeros(0, "i8")
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ids, pa.int64(), mask=ids == _LAST), pa.array(np.concatenate(scores) if scores else ids, pa.int64())], ["cls", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, postings = [], 0, 0
        for batch in batches:
            for i in range(len(batch)):
                ids, words, sizes, which, counts = (batch.column(c).slice(i, 1).flatten() for c in range(5))
                if not len(ids):
                    continue
                if held and (docs + len(ids) > most_docs or postings + len(which) > most_postings):
                    yield best_of(held)
                    held, docs, postings = [], 0, 0
                held.append((ids.fill_null(_LAST).to_numpy(), words.to_numpy(), sizes.to_numpy(), which.to_numpy(), counts.to_numpy()))
                docs, postings = docs + len(ids), postings + len(which)
        if held:
            yield best_of(held)

    return run


def op12_ranked_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_ranked_search": op12_ranked_search}

ORACLE = {
    "op12_ranked_search": r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
c as (select count(*)::bigint as n, sum(len(w))::bigint as l from d where len(w) > 0),
p as (select r, t, count(*)::bigint as tf from (select r, unnest(w) as t from d) group by r, t),
w as (select t, floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1)::double))::bigint as w from p, c group by t),
m as (select r, doc_id, 50 + (50 * len(w) * n) // l as m from d, c),
i as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as t from benchmark),
s as (select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score from i join p using (t) join w using (t) join m using (r) group by item_id, r, doc_id),
k as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id asc nulls last)::int as rank from s where score > 0)
select item_id, rank, doc_id, score from k where rank <= 50
""",
}
