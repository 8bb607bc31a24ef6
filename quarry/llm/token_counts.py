"""Token counts by a whole-token shortcut.

Which vocabulary strings encode alone as one token is proved beforehand with the library itself. Texts are split at
spaces and line ends, where no piece of the vocabulary reaches across, so a text's count is the sum over its parts: a
part in the proved set counts 1, any other is merged by the library, once for each worker that keeps it in its bounded
table. Texts with runs of spaces go to the library whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_batches, tidy

MARK = "▁"  # what the library writes for a space


@functools.lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def splits_at_spaces(path: str) -> bool:
    """True if no piece holds a space mark after another character, nor a line end: then no merge crosses a split."""
    model = _model(path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return all(MARK not in p.lstrip(MARK) and "\n" not in p for p in pieces)


def prove_whole_tokens(path: str) -> frozenset[str]:
    """The words w for which the library encodes the space-led word w as exactly one token."""
    model = _model(path)
    words = [p[1:] for i in range(model.get_piece_size()) if (p := model.id_to_piece(i)).startswith(MARK) and len(p) > 1 and p[1] != MARK]
    return frozenset(w for w, ids in zip(words, model.encode(words, num_threads=1), strict=True) if len(ids) == 1)


class Counts(dict):
    """Word -> tokens; words it lacks are merged by the library. Holds at most `most` words of up to 64 characters."""

    def __init__(self, path: str, proved, lead: str, most: int):
        super().__init__(dict.fromkeys(proved, 1))
        self.path, self.lead, self.most, self.proved = path, lead, most, proved
        self.less = len(_model(path).encode(lead)) if lead else 0

    def __missing__(self, word: str) -> int:
        n = len(_model(self.path).encode(self.lead + word)) - self.less
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
                self.update(dict.fromkeys(self.proved, 1))
            self[word] = n
        return n


def count_text(text: str, spaced: Counts, bare: Counts) -> int:
    """spaced: counts of words after a space or at the start, bare: counts of words right after a line end."""
    if not text:
        return 0
    if "  " in text or text[0] == " " or MARK in text:
        return len(_model(spaced.path).encode(text))
    lines = text.split("\n")
    n = len(lines) - 1
    first = lines[0].split(" ")
    n += sum(map(spaced.__getitem__, first))
    for line in lines[1:]:
        words = line.split(" ")
        n += bare[words[0]]
        if len(words) > 1:
            n += sum(map(spaced.__getitem__, words[1:]))
    return n


@functools.lru_cache(maxsize=2)
def _tables(path: str, proved: frozenset, most: int) -> tuple[Counts, Counts]:
    """Kept for the life of a worker, so that later tasks find earlier words."""
    spaced, bare = Counts(path, proved, "", most), Counts(path, (), "\n", most)
    spaced[""] = 1  # a lone space before a line end
    bare[""] = 0
    spaced.proved = spaced.proved | {""}
    bare.proved = ()
    return spaced, bare


def token_counts(docs: DataFrame, model_path: str, *, id_col="doc_id", text_col="text", limit: int = 4096, kept_words: int = 400_000) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_tokens, over_limit. Null texts count as empty: 0 bytes, 0 tokens.

    kept_words bounds each worker's two tables. Repeated rows and ids are counted row by row; other columns are ignored.
    """
    if not splits_at_spaces(model_path):
        raise ValueError("the model has pieces that reach across spaces")
    proved = prove_whole_tokens(model_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaced, bare = _tables(model_path, proved, kept_words)
        for batch in batches:
            for part, texts in text_batches(batch, batch.column(1)):
                n = [count_text(t, spaced, bare) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(tidy(count), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLE: dict[str, str] = {}
