"""The pipeline against a plain version of each stage, on a small corpus."""

import hashlib

import public_tokenizers
import pytest
from brute import mix
from pyspark.sql import functions as F
from test_ngram_join import brute as components
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import language_id, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") < 3000)
    odd = spark.createDataFrame([(9001, None, "en", "src1", None), (9002, "", "en", None, 0), (9003, "12 !", None, "src2", 4), (9004, "\n \n", "de", "src2", 3)], docs.schema)
    docs.unionAll(odd).repartition(3).write.parquet(str(out / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(out / "labels.parquet"))
    return str(out)


def test_equals_plain_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    lang, _, margin = language_id.judge([t for _, t, _ in rows], *language_id.train(docs))
    rows = [r for r, k, m in zip(rows, lang, margin, strict=True) if k != "und" and m >= 0.1]
    ids = [r[0] for r in rows]
    kept = docs.where(F.col("doc_id").isin(ids))
    good = quality.judge([t for _, t, _ in rows], quality.train(kept, spark.read.parquet(f"{folder}/labels.parquet")))
    rows = sorted(r for r, p in zip(rows, good, strict=True) if p >= 0.5)
    _, component = components([t for _, t, _ in rows], 5, 80)
    rows = [r for i, r in enumerate(rows) if component[i] == i]
    taken = mix([(d, s, t) for d, t, s in rows])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, t, _ in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        one = (d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        want += [one] * taken[d][3]
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == sorted(want) and 50 < len(rows) < 200


def test_stages_take_odd_tables(spark, folder):
    """Empty tables, and columns of clashing names."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("score", F.lit("x")).withColumn("size", F.lit("y")).withColumn("component_id", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert name == "bpe" or out.columns == docs.columns
        assert out.count() > 0
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_one_of_each_group_with_odd_ids(spark):
    from quarry.llm.ngram_join import keep_one_of_each

    text = "a b c d e f g h i j k l m n"
    rows = [(1, text), (1, text), (None, text), (2, text + " o"), (None, "other words here in this one now"), (3, None), (3, None)]
    got = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == [(-1, "other words here in this one now"), (1, text), (3, ""), (3, "")]
