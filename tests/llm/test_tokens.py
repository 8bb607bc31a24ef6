import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import types as T
from tokenizers import Tokenizer

from quarry.llm import bpe, token_counts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "\n", "\n\n", "a\n\n\nb  ", "\t x", "a  b", "a b", "a　 b", "x\x1c y", "x \x1cy", "a\0b c", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>",
    "don't we'll 123abc 4 5", "héllo wörld ñ", "日本語 テスト", "🙂🙂 🙂", "a▁b ▁", "<s> </s> <unk>", "\r\n a\r\n", "x" * 700, "ab" * 400 + " " + "cd" * 300, "é ​ z", "﻿a b", "a\x85 b", "a  b", "tail \n ", " . . .", "a� b",
]


def fuzzed(n=400):
    rng = random.Random(5)
    marks = [" ", "  ", "\n", "\t", "a", "the", "é", "1", ".", "'s", "▁", " ", "<|endoftext|>", "日", "\r", "Z", "-", "\x1d", " "]
    return ["".join(rng.choice(marks) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    texts = [*HARD, None, None, *HARD[:3], *fuzzed()]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.IntegerType()), T.StructField("n_tokens", T.StringType())])
    return texts, spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], schema)


def test_counts_equal_the_library(rows):
    texts, df = rows
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in token_counts.token_counts(df, PIECES, limit=20).collect()}
    for i, t in enumerate(texts):
        want = len(model.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (want, len((t or "").encode()), want > 20), repr(t)


def test_round_trip_equals_the_library(rows):
    texts, df = rows
    library = Tokenizer.from_file(BPE)
    for kept in (500_000, 40):  # the second turns its table over again and again
        bpe.word_table.cache_clear()
        table = bpe.WordTable(BPE, kept)
        flat, ends = table.encode(pa.array([t or "" for t in texts]))
        for i, (t, data) in enumerate(zip(texts, table.decode(flat, ends), strict=True)):
            ids = library.encode(t or "", add_special_tokens=False).ids
            assert flat[ends[i] : ends[i + 1]].tolist() == ids, repr(t)
            assert data.decode() == library.decode(ids, skip_special_tokens=False), repr(t)
    digests = {r.doc_id: r for r in bpe.round_trip_digests(df, BPE).collect()}
    whole = {r.doc_id: r for r in bpe.encode_and_decode(df, BPE).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert digests[i].n_tokens == len(ids) and digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert whole[i].ids == ids and whole[i].decoded == (t or "")


def test_shared_words(spark):
    """Words of several tasks are encoded once; a bound leaves those of most tasks."""
    texts = ["a common, word one. here", "a common word two\n here", "a common word three here  ", None, ""] * 3 + ["a rare"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    library = Tokenizer.from_file(BPE)
    for most, least in ((1000, 7), (4, 1)):
        shared = pa.ipc.open_stream(bpe.shared_words(df, BPE, most=most)).read_all().to_pylist()
        assert least <= len(shared) <= 2 * most and len({r["word"] for r in shared}) == len(shared)
        assert all(np.frombuffer(r["ids"], "<u4").tolist() == library.encode(r["word"], add_special_tokens=False).ids for r in shared)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pa.ipc.open_stream(bpe.shared_words(empty, BPE)).read_all().num_rows == 0


def test_very_long_text(spark):
    rng = random.Random(4)
    text = " ".join(rng.choice(["tree,", "house", "éa", "stone", "x1."]) + str(rng.randrange(99)) for _ in range(300_000))
    want = Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids
    got = bpe.encode_and_decode(spark.createDataFrame([(1, text)], "doc_id long, text string"), BPE).first()
    assert len(text) > 2_000_000 and got.ids == want and got.decoded == text


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(df, PIECES).count() == 0 and bpe.round_trip_digests(df, BPE).count() == 0
