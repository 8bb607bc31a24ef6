import random
import re
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import ngram_join as J
from quarry.llm.common import Held, settle


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def sets(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(texts, n, percent):
    found = [sets(t, n) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for k in range(i):
            both = len(found[i] & found[k])
            if both and 100 * both >= percent * len(found[i] | found[k]):
                a, b = sorted((top(i), top(k)))
                root[b] = a
    return [len(f) for f in found], [top(i) for i in range(len(texts))]


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocab) for _ in range(40)]
    out = [None, "", "  \n", "one", "One", "one two three", "ONE two\tthree", "É a b c d", "é a b c d", "a a a a a a a a", "a a a a"]
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(5, 90))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 2)] = [rng.choice(vocab)] * rng.randint(0, 2)
            out.append(" ".join(w))
    centre = [rng.choice(vocab) for _ in range(120)]
    for _ in range(30):  # a large group of near copies
        w = list(centre)
        w[rng.randrange(120)] = rng.choice(vocab)
        out.append(" ".join(w))
    out += out[20:26]
    rng.shuffle(out)
    return out


def test_equals_all_pairs(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("component_id", T.StringType()), T.StructField("n", T.StringType())])
    for seed, n, percent, most in ((3, 4, 85, 256), (4, 5, 80, 3)):
        texts = corpus(seed)
        df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], schema)
        size, component = brute(texts, n, percent)
        got = {r.doc_id: r for r in J.similar_documents(df, n=n, percent=percent, most=most).collect()}
        assert [got[i].n_shingles for i in range(len(texts))] == size
        assert [got[i].component_id for i in range(len(texts))] == component


def test_trie_equals_pairs():
    rng = np.random.default_rng(1)
    for _ in range(60):
        base = np.unique(rng.integers(0, 400, 60))
        pool = {tuple(np.unique(np.concatenate([np.delete(base, rng.integers(0, len(base), rng.integers(0, 6))), rng.integers(0, 400, rng.integers(0, 6))])).tolist()) for _ in range(rng.integers(1, 14))}
        given = [np.array(s, "u8") for s in pool]
        got = J.link(given, 85)
        root = list(range(len(given)))
        for i in range(len(given)):
            for k in range(i):
                both = len(set(given[i].tolist()) & set(given[k].tolist()))
                if 100 * both >= 85 * (len(given[i]) + len(given[k]) - both):
                    a, b = root[i], root[k]
                    root = [b if r == a else r for r in root]
        assert len({(a, b) for a, b in zip(root, got.tolist(), strict=True)}) == len(set(root)) == len(set(got.tolist()))


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "q r s t u v"), (None, None), (3, "q r s t u v")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in J.similar_documents(df).collect())
    assert got == [(-1, 0, -1), (-1, 2, 7), (3, 2, 3), (7, 2, 3), (7, 2, 7)]
    assert J.similar_documents(df.limit(0)).count() == 0


def left_behind(spark):
    """Bytes of shuffle files on the session's disks."""
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    return {f: f.stat().st_size for d in dirs for f in Path(d).rglob("shuffle_*.data")}


def test_settled_tables_leave_no_shuffle_files(spark):
    before = set(left_behind(spark))
    got = settle(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert set(left_behind(spark)) <= before
    assert got.count() == 7

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(200)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts + texts[:20])), "doc_id long, text string")
    before = set(left_behind(spark))
    out = J.similar_documents(df)
    assert sum(size for f, size in left_behind(spark).items() if f not in before) < 100 * len(texts)  # a set's beginning and sketch alone are 500
    assert out.where("component_id < doc_id").count() == 20


def test_classes_with_and_without_broadcast(spark):
    rows = spark.createDataFrame([(5, 1, 9), (3, 2, 9), (None, 3, 9), (3, 4, 9), (8, 5, 7), (None, 6, 6), (None, 7, 6), (1, 8, None)], "doc_id long, row long, class_id long")
    rows = rows.selectExpr("*", "2L as n", "0L as anchor", "array(class_id) as sketch", "array(row) as head")
    copied = J._copied(rows)
    assert sorted(map(tuple, copied.collect()), key=str) == [(6, 6, None), (9, 2, 3)]
    for most in (500_000, 0):
        with Held() as held:
            got = J._classes(held, rows, copied, most)
            assert sorted((r.class_id, r.head[0], r.rep or -1) for r in got.collect()) == [(6, 6, -1), (7, 5, 8), (9, 2, 3)]
            assert most == 0 or "Exchange hashpartitioning" not in got._jdf.queryExecution().toString()
