"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

The trees are complete and flattened into arrays, which a batch of documents walks down level by level with numpy.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, give_back, keep_rows, learnable, settle, table, text_batches, tidy, unit_hash

SEED = 11
_ENDS = re.compile(r"[.!?]+")
NAMES = (
    "chars", "words", "lines", "word_length", "longest_word", "letters", "capitals", "digits", "spaces", "marks", "symbols", "pipes", "beyond_ascii",
    "distinct_words", "top_word", "repeated_next", "distinct_pairs", "marked_words", "capital_words", "short_words", "line_length", "repeated_lines",
    "repeated_line_chars", "sentence_length", "packed", "entropy", "exclamations", "top_pair",
)


def statistics(text: str | None) -> list[float]:
    """The statistics named in NAMES, of the whole text; all 0 for null and empty texts."""
    if not text:
        return [0.0] * len(NAMES)
    data = text.encode("utf-8", "replace")
    by = np.bincount(np.frombuffer(data, "u1"), minlength=256)
    n = len(text)
    words, lines = text.split(), text.split("\n")
    w, counts = max(1, len(words)), Counter(words)
    lengths = np.fromiter(map(len, words), "i8", len(words)) if words else np.zeros(1, "i8")
    pairs = Counter(zip(words, words[1:], strict=False))
    full = [x for x in lines if x]
    often = Counter(full)
    capitals, small = by[65:91].sum(), by[97:123].sum()
    wide = by[192:].sum()  # characters of several bytes
    symbols = by[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126]].sum()
    marks = by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum()
    p = by[by > 0] / len(data)
    again = [(k, v) for k, v in often.items() if v > 1]
    return [float(x) for x in (
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.max(), (capitals + small + wide) / n, capitals / max(1, capitals + small), by[48:58].sum() / n, by[[9, 10, 13, 32]].sum() / n, marks / n, symbols / n, by[124] / n, wide / n,
        len(counts) / w, max(counts.values(), default=0) / w, sum(map(operator.eq, words, words[1:])) / w, len(pairs) / w, sum(1 for x in counts if not x.isalnum()) / max(1, len(counts)), sum(v for x, v in counts.items() if x.isupper()) / w, float((lengths <= 2).mean()), n / len(lines), sum(v - 1 for _, v in again) / max(1, len(full)),
        sum((v - 1) * len(k) for k, v in again) / n, w / max(1, len(_ENDS.findall(text))), len(zlib.compress(data, 1)) / len(data), -(p * np.log2(p)).sum(), by[33] / n, max(pairs.values(), default=0) / w,
    )]


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 5, rate: float = 0.15, bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> dict[str, np.ndarray]:
    """Trees as arrays: feature and threshold [tree, inner node], value [tree, leaf], and the first score. Node i has the children 2i+1 and 2i+2; x > threshold goes right."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) if n else np.zeros(0) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], 1) if n else np.zeros((0, width), int)
    share = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    feature, threshold, value = np.zeros((trees, inner), "i4"), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    score = np.full(n, start)
    offset = np.arange(width) * bins
    for t in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, int)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            key = (((node - first) * width * bins)[:, None] + offset + binned).ravel()
            size = count * width * bins
            gs = np.bincount(key, np.repeat(g, width), size).reshape(count, width, bins).cumsum(2)
            hs = np.bincount(key, np.repeat(h, width), size).reshape(count, width, bins).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(hs < least / 4) | (ht - hs < least / 4)] = -1
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[t, first + k], threshold[t, first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        score += value[t][leaf]
    return {"feature": feature, "threshold": threshold, "value": value, "start": np.float64(start)}


def traverse(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The score from 0 to 1 of each row of x, all trees at once."""
    feature, threshold, value = model["feature"], model["threshold"], model["value"]
    tree, node = np.arange(len(feature))[None], np.zeros((len(x), len(feature)), int)
    while feature.shape[1] and node.size and node[0, 0] < feature.shape[1]:
        node = 2 * node + 1 + (np.take_along_axis(x, feature[tree, node], 1) > threshold[tree, node])
    total = model["start"] + value[tree, node - feature.shape[1]].sum(1)
    return 1 / (1 + np.exp(-total))


def train(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="quality", sample: int = 20_000) -> dict[str, np.ndarray]:
    """A model from about `sample` labelled rows at most, drawn evenly; never from rows whose crc32(id) mod 3 is 1.

    An id labelled twice counts with its larger label; null labels don't count. Without labels every score is 0.5.
    """
    known = labels.where(learnable(F.col(id_col)) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("double").alias("__y"))
    n = known.count()
    known = broadcast_if_small(settle(known.where(unit_hash(F.col("__id"), seed=SEED) < sample / max(n, 1))), 2 * sample)
    rows = docs.join(known, F.col(id_col) == F.col("__id")).select(F.col("__y").alias("y"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_batches(batch, batch.column(1)):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))], ["y", "x"])

    found = rows.mapInArrow(tidy(run), "y double, x array<double>").orderBy("y", "x").toArrow()
    x = np.array(found["x"].to_pylist(), "f8").reshape(-1, len(NAMES))
    model = boost(x, found["y"].to_numpy().astype("f8"))
    del x, found
    give_back()
    return model


def judge(texts: list[str | None], model: dict[str, np.ndarray]) -> np.ndarray:
    return traverse(model, np.array([statistics(t) for t in texts], "f8").reshape(-1, len(NAMES)))


def score(docs: DataFrame, model: dict[str, np.ndarray], *, id_col="doc_id", text_col="text") -> DataFrame:
    """A row for each row of docs: doc_id, score, predicted (1 from 0.5 on). Null texts score as empty ones; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_batches(batch, batch.column(1)):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(judge(texts, model), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(tidy(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: dict[str, np.ndarray], *, text_col="text", least: float = 0.5) -> DataFrame:
    """The rows of docs that score at least `least`, with all their columns."""
    return keep_rows(docs, text_col, lambda texts: (judge(texts, model) >= least).tolist())


def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op4_quality": op4_quality}
ORACLE: dict[str, str] = {}
