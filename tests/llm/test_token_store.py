import glob
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from quarry.llm import token_store as S

BPE = public_tokenizers.path("byte_bpe_50k.json")


def cut(ids):
    return S.cuts(ids, np.array([0, len(ids)]))[0]


def test_cuts():
    rng = np.random.default_rng(0)
    for n in (1, 31, 255, 257, 20_000):
        ids = rng.integers(0, 50_000, n).astype("<u4")
        ends = cut(ids)
        assert ends[-1] == n and all(0 < b - a <= S.MOST for a, b in zip([0, *ends], ends, strict=False))
    assert cut(np.zeros(20_000, "<u4"))[-1] == 20_000
    tail = rng.integers(0, 50_000, 30_000).astype("<u4")
    a = {S.digest(x.tobytes()) for x in np.split(tail, cut(tail)[:-1])}
    moved = np.concatenate([tail[:77], tail])
    b = {S.digest(x.tobytes()) for x in np.split(moved, cut(moved)[:-1])}
    assert len(a & b) > len(a) / 2  # a shift leaves most chunks as they were
    # Documents in one array are cut as each alone.
    both = np.concatenate([moved, tail[:3], tail])
    ends = np.array([0, len(moved), len(moved) + 3, len(both)])
    assert S.cuts(both, ends) == [cut(moved), [len(moved) + 3], [len(moved) + 3 + x for x in cut(tail)]]


def test_store(spark, tmp_path):
    rng = random.Random(1)
    long = " ".join(rng.choice(["tree", "house", "stone", "river", "x", "y\n"]) for _ in range(9000))
    texts = ["", None, "a b c", long, long, "start " + long, "tail  end ", "a b c", "<|endoftext|>"]
    ids = [5, 3, None, 9, 1, 12, 7, 7, 2]
    df = spark.createDataFrame(list(zip(ids, texts, ["k"] * 9, strict=True)), "doc_id long, text string, start string")
    S.write(df, folder := str(tmp_path / "store"), BPE)
    library = Tokenizer.from_file(BPE)
    want, at = [], 0
    order = sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    for doc, t in order:
        got = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((doc, at, got))
        at += len(got)
    whole = sorted(S.read_ids(spark, folder).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.ids) for r in whole if r.doc_id != 7] == [(d, g) for d, _, g in want if d != 7]
    assert sorted(r.ids for r in whole if r.doc_id == 7) == sorted(g for d, _, g in want if d == 7)
    assert all(b.start == a.start + len(a.ids) for a, b in zip(whole, whole[1:], strict=False)) and whole[0].start == 0
    found = sorted(S.read_digests(spark, folder).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found] == [(r.doc_id, r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in whole]
    chunks = spark.read.parquet(f"{folder}/encoded").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("digest").distinct().count()
    recipes = spark.read.parquet(f"{folder}/recipes")
    recipes.where("doc_id <> 12 or doc_id is null").write.parquet(str(tmp_path / "store2" / "recipes"))
    spark.read.parquet(f"{folder}/manifest").write.parquet(str(tmp_path / "store2" / "manifest"))
    with pytest.raises(ValueError):
        S.verify(spark, str(tmp_path / "store2"))


def copied(spark, folder, to, keep):
    """A copy of a store without the chunks that keep refuses, in the same buckets."""
    import shutil

    shutil.copytree(folder, to)
    for f in glob.glob(f"{to}/encoded/kind=chunk/*.parquet"):
        rows = pq.read_table(f)
        pq.write_table(rows.filter(pa.array([keep(x) for x in rows.to_pylist()], pa.bool_())), f)
        crc = f"{os.path.dirname(f)}/.{os.path.basename(f)}.crc"
        if os.path.exists(crc):
            os.remove(crc)
    return to


def test_lost_chunks_raise(spark, tmp_path):
    rng = random.Random(2)
    texts = ["a b c", " ".join(f"w{rng.random()}" for _ in range(3000)), "d e f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    S.write(df, folder := str(tmp_path / "store"), BPE, bucket_bytes=20_000)
    assert S.read_digests(spark, folder).count() == 3
    chunks = spark.read.parquet(f"{folder}/encoded/kind=chunk").collect()
    assert len(chunks) > 5
    small, large = min(chunks, key=lambda r: r.size).digest, max(chunks, key=lambda r: r.size).digest
    for i, gone in enumerate((small, large)):  # of a document of one chunk, and of one of several
        store = copied(spark, folder, str(tmp_path / f"lost{i}"), lambda x, gone=gone: x["digest"] != gone)
        for read in (S.read_digests, S.read_ids):
            with pytest.raises(Exception, match="is missing"):
                read(spark, store).collect()


def test_wrong_root_raises(spark, tmp_path):
    S.write(spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string"), folder := str(tmp_path / "store"), BPE)
    recipes = [r.asDict() for r in spark.read.parquet(f"{folder}/recipes").collect()]
    for r, other in zip(recipes, reversed([x["chunks"] for x in recipes]), strict=True):
        r["chunks"] = other
    import shutil

    shutil.copytree(f"{folder}/encoded", f"{tmp_path}/swapped/encoded"), shutil.copytree(f"{folder}/layout", f"{tmp_path}/swapped/layout"), shutil.copytree(f"{folder}/manifest", f"{tmp_path}/swapped/manifest")
    spark.createDataFrame(recipes, spark.read.parquet(f"{folder}/recipes").schema).write.parquet(f"{tmp_path}/swapped/recipes")
    with pytest.raises(Exception, match="doesn't match its root"):
        S.read_ids(spark, f"{tmp_path}/swapped").collect()


def test_very_long_text(spark, tmp_path):
    rng = random.Random(4)
    text = " ".join(rng.choice(["tree", "house", "éa", "stone,", "x1"]) + str(rng.randrange(99)) for _ in range(300_000))
    S.write(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"), folder := str(tmp_path / "store"), BPE)
    want = Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids
    got = {r.doc_id: r.ids for r in S.read_ids(spark, folder).collect()}
    assert len(text) > 2_000_000 and got[1] == [*want, 0]


def test_empty(spark, tmp_path):
    S.write(spark.createDataFrame([], "doc_id long, text string"), folder := str(tmp_path / "none"), BPE)
    assert S.read_digests(spark, folder).count() == 0
