"""Byte-level BPE through a table of distinct words: each word is encoded once, its ids joined back by position.

Texts are split where the tokenizer's own pattern always splits: before a space or line end that follows a character
that isn't white space, and between a letter or digit and a comma or full stop. Each task tells its distinct words, Spark
makes those of several tasks distinct and encodes each once; that table, of bounded size with the words of most tasks
first, is broadcast. A second pass joins the ids back by position; a word that the table lacks (most of them stand in one
task alone) is encoded once by the task that has it and kept in its worker's table, bounded as well. Ids are decoded by a
join with the vocabulary's id-to-piece table. Texts never move.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, parts_of, settle, table, tidy

_PARTS = re.compile(r"\S+|\s+\S*")
#: \0 marks the splits; Python counts the others as white space, the tokenizer's pattern doesn't.
_ODD = ("\0", "\x1c", "\x1d", "\x1e", "\x1f")
_JOINED = 400  # words encoded in one string
_LONG = 256  # words as long are encoded alone and soon forgotten
_LEADS = (" ", "\n")
_PART = 1_000_000  # bytes of text at a time, or one text


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character: Latin-1's printable ones stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTable:
    """Distinct words and their ids, in columns: word i has the ids flat[first[i] : first[i] + size[i]].

    size is -1 for words that end with white space, which have no ids of their own. At most about `most` words stay, those used last.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = {i: token.content for i, token in self.library.get_added_tokens_decoder().items()}
        chars = _byte_of_char()
        self.whole = (*_ODD, *added.values())
        pieces: list[bytes] = [b""] * self.library.get_vocab_size(with_added_tokens=True)
        for piece, i in self.library.get_vocab(with_added_tokens=True).items():
            pieces[i] = added[i].encode() if i in added else bytes(chars[c] for c in piece)
        self.pieces = pa.array(pieces, pa.binary())
        self.decimals = pa.array([b"%d," % i for i in range(len(pieces))], pa.binary())
        self.lengths = np.array([len(p) for p in pieces], "i8")
        self.most, self.batch = most, 0
        self.words, self.flat = pa.array([], pa.string()), np.zeros(0, "<u4")
        self.first, self.size, self.used = np.zeros(0, "i8"), np.zeros(0, "i4"), np.zeros(0, "i4")
        self.given = ""

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, how many of them each word has), each word encoded once, most of them many in one string: there each
        must begin with white space, as words do in a text, and the ids are dealt out by their bytes."""
        blank = pc.not_equal(pc.utf8_rtrim_whitespace(words), words).to_numpy(zero_copy_only=False)
        led = functools.reduce(pc.or_, [pc.starts_with(words, x) for x in _LEADS]).to_numpy(zero_copy_only=False)
        length = pc.binary_length(words).to_numpy()
        joined = led & ~blank & (length < _LONG)
        size = np.where(blank, -1, 0).astype("i4")
        own: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(~joined & ~blank).tolist():
            own[i] = self._whole(words[i].as_py())
            size[i] = len(own[i])
        at = np.flatnonzero(joined)
        groups = [at[i : i + _JOINED] for i in range(0, len(at), _JOINED)]
        texts = ["".join(words.take(pa.array(g)).to_pylist()) for g in groups]
        runs = []
        for g, found in zip(groups, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(length[g])) + 1
            size[g] = np.diff(ends, prepend=0)
            runs.append(ids)
        # Words encoded alone go between the others, at their places.
        flat, n = np.zeros(int(size.clip(0).sum()), "<u4"), size.clip(0)
        starts = np.cumsum(n) - n
        if runs:
            flat[_spread(starts[at], n[at])] = np.concatenate(runs)
        for i, ids in own.items():
            flat[starts[i] : starts[i] + len(ids)] = ids
        return flat, size

    def add(self, words: pa.Array, flat: np.ndarray, size: np.ndarray) -> None:
        """Put in words that the table lacks."""
        n = size.clip(0)
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(n) - n])
        self.words, self.flat, self.size = pa.concat_arrays([self.words, words]), np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        self.used = np.concatenate([self.used, np.full(len(words), self.batch, "i4")])

    def take_over(self, name: str, data: bytes) -> None:
        """Put in the words of a shared table (Arrow: word, ids) once; name tells tables apart."""
        if self.given != name:
            self.given = name
            shared = pa.ipc.open_stream(data).read_all().combine_chunks()
            if len(shared):
                words, ids = shared.column(0).combine_chunks(), shared.column(1).combine_chunks()
                new = pc.is_null(pc.index_in(words, value_set=self.words))
                words, ids = words.filter(new), ids.filter(new)
                self.add(words, np.frombuffer(b"".join(ids.to_pylist()), "<u4"), (pc.binary_length(ids).to_numpy() // 4).astype("i4"))

    def _shrink(self) -> None:
        """Keep the words used last: half of what the table may hold."""
        if len(self.words) > self.most or self.words.nbytes > 64 * self.most:
            short = np.flatnonzero(pc.less(pc.binary_length(self.words), _LONG).to_numpy(zero_copy_only=False))
            keep = np.sort(short[np.argsort(-self.used[short], kind="stable")[: self.most // 2]])
            n = self.size[keep].clip(0)
            self.flat = self.flat[_spread(self.first[keep], n)]
            self.words, self.size, self.used, self.first = self.words.take(pa.array(keep)), self.size[keep], self.used[keep], np.cumsum(n) - n

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids one after another, how many each word has, which words end with white space): distinct words are looked up, those that
        the table lacks encoded once, and the ids joined back by position."""
        coded = words.dictionary_encode()
        self.batch += 1
        at = pc.index_in(coded.dictionary, value_set=self.words)
        lacking = pc.is_null(at)
        place = at.fill_null(0).to_numpy().astype("i8")
        new = coded.dictionary.filter(lacking)
        place[lacking.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
        if len(new):
            self.add(new, *self.learn(new))
        self.used[place] = self.batch
        first, size, word = self.first[place], self.size[place], coded.indices.to_numpy()
        n = size.clip(0)[word]
        out = self.flat[_spread(first[word], n)], n, (size < 0)[word] if (size < 0).any() else None
        self._shrink()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's begin, and the end), as the library gives them with add_special_tokens=False."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, "i8")
        split = split_words(texts)
        flat, n, blank = self._ids(split.flatten())
        borders = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        ends = np.concatenate([[0], np.cumsum(n, dtype="i8")])[borders]
        again = functools.reduce(pc.or_, [pc.match_substring(texts, x) for x in self.whole]).to_numpy(zero_copy_only=False)
        other = {i: self._whole(texts[i].as_py()) for i in np.flatnonzero(again).tolist()}
        if blank is not None:  # texts with longer runs of white space
            some = np.unique(np.searchsorted(borders, np.flatnonzero(blank), side="right") - 1)
            some = some[~again[some]]
            other |= dict(zip(some.tolist(), self._by_runs(texts.take(pa.array(some))), strict=True))
        if other:
            runs = [other[i] if i in other else flat[ends[i] : ends[i + 1]] for i in range(len(texts))]
            flat, ends = np.concatenate(runs), np.cumsum([0, *map(len, runs)])
        return flat, ends

    def _by_runs(self, texts: pa.Array) -> list[np.ndarray]:
        """For texts with longer runs of white space, which the pattern looks at as a whole."""
        parts = [_PARTS.findall(t) for t in texts.to_pylist()]
        tails = [p.pop() if p and p[-1][-1].isspace() else "" for p in parts]
        flat, n, _ = self._ids(pa.array([w for p in parts for w in p], pa.string()))
        ends = np.concatenate([[0], np.cumsum(n, dtype="i8")])[np.cumsum([0, *map(len, parts)])]
        return [np.concatenate([flat[a:b], self._whole(t)]) for a, b, t in zip(ends, ends[1:], tails, strict=False)]

    def decode(self, flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each text: ids joined with the id-to-piece table; what isn't UTF-8 becomes U+FFFD, as in the library."""
        return [x if _is_utf8(x) else x.decode("utf-8", "replace").encode() for x in self._pieces(self.pieces, flat, ends)]

    def listed(self, flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The decimal ids of each text, joined by commas."""
        return [x[:-1] for x in self._pieces(self.decimals, flat, ends)]

    @staticmethod
    def _pieces(of: pa.Array, flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
        taken = of.take(pa.array(flat))  # taken pieces lie one after another, so each text's bytes are one run
        at = np.frombuffer(taken.buffers()[1], "i4")[ends].tolist() if len(flat) else [0] * len(ends)
        data = memoryview(taken.buffers()[2] or b"")
        return [data[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)]


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of runs of n[i] items that begin at first[i], one run after another."""
    ends = np.cumsum(n, dtype="i8")
    return np.repeat((first - (ends - n)).astype("i4"), n) + np.arange(ends[-1] if len(ends) else 0, dtype="i4")


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def split_words(texts: pa.Array) -> pa.Array:
    """Lists of the words of texts, each with the space or line end before it. Words are cut before a comma or full stop that follows a
    letter or digit, too: no token holds both."""
    marked = pc.replace_substring_regex(texts, "([\\pL\\pN])([,.])", "\\1\0\\2")
    marked = pc.replace_substring(pc.replace_substring(marked, " ", "\0 "), "\n", "\0\n")
    return pc.split_pattern(marked, "\0")


@functools.lru_cache(maxsize=1)
def _table_of(path: str) -> WordTable:
    return WordTable(path)


def word_table(path: str, most: int = 400_000) -> WordTable:
    """One for each worker process, whatever its bound: later tasks find earlier words, and no second tokenizer is built beside the first."""
    table = _table_of(path)
    table.most = most
    return table


word_table.cache_clear = _table_of.cache_clear


def shared_words(docs: DataFrame, tokenizer_path: str, *, text_col="text", most: int = 200_000) -> bytes:
    """An Arrow table (word, ids) of words that several tasks hold, or parts of one of 8 MB of words, each encoded once: at most about `most` of them, those of most.

    Words of 256 bytes and more and those that end with white space aren't in it. An empty table of texts gives one without rows.
    """

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = pa.array([], pa.string())
        for batch in batches:
            for _, texts in parts_of(batch, batch.column(0), _PART):
                found = split_words(texts).flatten().unique()
                found = found.filter(pc.and_(pc.less(pc.binary_length(found), _LONG), pc.equal(pc.utf8_rtrim_whitespace(found), found)))
                seen = pa.concat_arrays([seen, found]).unique()
                if seen.nbytes > 8_000_000:
                    yield pa.RecordBatch.from_arrays([seen], ["word"])
                    seen = pa.array([], pa.string())
        yield pa.RecordBatch.from_arrays([seen], ["word"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, size = word_table(tokenizer_path).learn(batch.column(0))
            ends = 4 * np.cumsum([0, *size]).astype("i4")
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["word", "ids"])

    slim = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    told = settle(slim.mapInArrow(tidy(tell), "word string").groupBy("word").agg(F.count(F.lit(1)).alias("tasks")).where("tasks > 1"))
    # The number of tasks down to which the words are few enough, and the part of that step's words that still fits, by hash.
    least, held, part = 2, 0, 1000
    for row in sorted(told.groupBy("tasks").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["tasks"]):
        if held + row["n"] > most:
            least, part = row["tasks"], 1000 * (most - held) // row["n"]
            break
        held += row["n"]
    fits = (F.col("tasks") > least) | ((F.col("tasks") == least) & (F.pmod(F.xxhash64("word"), F.lit(1000)) < part))
    table = told.where(fits).select("word").mapInArrow(tidy(encode), "word string, ids binary").toArrow()
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    data = out.getvalue().to_pybytes()
    del table, out
    give_back()
    return data


def _words_of(docs: DataFrame, tokenizer_path: str, text_col: str, kept_words: int) -> Callable[[], WordTable]:
    """What gives a task its worker's table, with the shared words in it."""
    spark = docs.sparkSession
    name, data = uuid.uuid4().hex, spark.sparkContext.broadcast(shared_words(docs, tokenizer_path, text_col=text_col, most=kept_words // 2))  # bounded: a few MB

    def words() -> WordTable:
        table = word_table(tokenizer_path, kept_words)
        table.take_over(name, data.value)
        return table

    return words


def encode_and_decode(docs: DataFrame, tokenizer_path: str, *, id_col="doc_id", text_col="text", kept_words: int = 400_000) -> DataFrame:
    """A row for each row of docs: doc_id, ids array<int>, decoded. Null texts count as empty: no ids, decoded ''.

    kept_words bounds a worker's table, half of it the shared table. Repeated rows and ids are encoded row by row; other columns are ignored. An
    empty table gives no rows. Texts of any length are encoded whole: memory is a small multiple of 1 MB of text or of the longest text.
    """
    table = _words_of(docs, tokenizer_path, text_col, kept_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = table()
        for batch in batches:
            for part, texts in parts_of(batch, batch.column(1), _PART):
                flat, ends = words.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(flat.astype("i4")))
                decoded = pa.array([x.decode() for x in words.decode(flat, ends)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, decoded], ["doc_id", "ids", "decoded"])

    return _rows(docs, id_col, text_col).mapInArrow(tidy(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded string")


def round_trip_digests(docs: DataFrame, tokenizer_path: str, *, id_col="doc_id", text_col="text", kept_words: int = 400_000) -> DataFrame:
    """encode_and_decode, but of ids and decoded text only the digests leave the task: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    table = _words_of(docs, tokenizer_path, text_col, kept_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = table()
        for batch in batches:
            for part, texts in parts_of(batch, batch.column(1), _PART):
                flat, ends = words.encode(texts)
                told = [[hashlib.sha256(x).hexdigest() for x in made(flat, ends)] for made in (words.listed, words.decode)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends), pa.int64()), *[pa.array(x, pa.string()) for x in told]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs, id_col, text_col).mapInArrow(tidy(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def op10_bpe(spark, sf_dir):
    import public_tokenizers

    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op10_bpe": op10_bpe}
ORACLE: dict[str, str] = {}
