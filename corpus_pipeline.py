"""From raw documents to token digests: language, quality, near duplicates, mixing, encoding.

Each stage takes all that the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, language_id, mixing, ngram_join, quality
from quarry.llm.common import bounded_batches, shared_dir, table


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose two likeliest languages are about as likely, go."""
    bounded_batches(spark)
    return language_id.keep_identified(docs, *language_id.train(docs))


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 go."""
    bounded_batches(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 or more of their 5-grams, the smallest doc_id stays."""
    bounded_batches(spark)
    return ngram_join.keep_one_of_each(docs, n=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0 to 2 times."""
    bounded_batches(spark)
    return mixing.repeat_by_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    bounded_batches(spark)
    import public_tokenizers

    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.json"), kept_words=200_000)


STAGES = [("language_id", by_language), ("quality", by_quality), ("ngram_join", without_copies), ("mixing", mixed), ("bpe", encoded)]

#: Trained models and a tokenizer decide: SQL can't express it. tests/llm holds it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}-{name}")
