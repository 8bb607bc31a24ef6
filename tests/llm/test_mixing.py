import random

import pytest
from brute import mix as slow
from pyspark.sql import types as T

from quarry.llm import mixing as M

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("text", T.StringType()), T.StructField("size", T.StringType()), T.StructField("taken", T.IntegerType())])


def corpus():
    rng = random.Random(4)
    rows = []
    for i in range(300):
        source = "big" if i < 150 else rng.choice(["a", "b", "Z", None, "é", "empty"])
        text = None if source == "empty" or i % 37 == 0 else " ".join(rng.choice(["alpha", "b7", "***", "ñandú"]) for _ in range(rng.choice([0, 1, 3, 10, 200])))
        rows.append((i, source, text))
    return rows


def test_equals_plain_version(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    for bins in (1024, 1):
        want, got = slow(rows), {r.doc_id: r for r in M.mix(df, bins=bins).collect()}
        assert len(got) == len(rows)
        for d, (size, total, target, times) in want.items():
            r = got[d]
            assert (r["size"], r.source_size, r.taken) == (size, total, times * size), d
            assert r.target == pytest.approx(target, abs=1e-6)
    taken, target = {}, {}
    for r in got.values():
        taken[r.source], target[r.source] = taken.get(r.source, 0) + r.taken, r.target
    assert all(abs(taken[s] - target[s]) <= 100 for s in taken)  # half of the longest text


def test_repeats_and_odd_tables(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    times = {d: t for d, (s, _, _, t) in slow(rows).items() if s}
    out = [r.doc_id for r in M.repeat_by_mix(df).collect()]
    assert {d: out.count(d) for d in times if times[d]} == {d: t for d, t in times.items() if t}
    assert M.repeat_by_mix(df).columns == df.columns
    assert M.mix(df.limit(0)).count() == 0 and M.repeat_by_mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("row", [(None, "s", "one two three four five six seven eight nine ten"), (7, "s", "a b c d e f g h i j"), (None, None, "k l m n o p q r s t")])
def test_tied_rows_fill_the_target(spark, tmp_path, row):
    """100 equal rows of 10 words, with or without an id: the budget ends among them."""
    df = spark.createDataFrame([row] * 100, "doc_id long, source string, text string").repartition(7)
    df.write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    got = M.mix(df).collect()
    assert len(got) == 100 and {(r.source_size, r.target) for r in got} == {(1000, 1500.0)} and sum(r.taken for r in got) == 1500
    assert M.repeat_by_mix(df).count() == 150


def test_ties_among_others(spark, tmp_path):
    """Ties at the cut and away from it, in several sources: each source's words come within one document of its target."""
    rng = random.Random(9)
    rows = [(i, rng.choice("ab"), "word " * rng.randint(1, 30)) for i in range(200)]
    rows += [(None, rng.choice("abc"), "x y z") for _ in range(300)] + rows[:40] + [(None, "a", None)] * 9 + [(None, "d", "")] * 5
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    taken, target, again = {}, {}, {}
    for r in M.mix(df).collect():
        taken[r.source], target[r.source] = taken.get(r.source, 0) + r.taken, r.target
    assert set(taken) == set("abcd") and all(abs(taken[s] - target[s]) <= 15 for s in taken)
    for r in M.repeat_by_mix(df).collect():
        again[r.source] = again.get(r.source, 0) + len((r.text or "").split())
    assert {s: n for s, n in again.items() if n} == {s: n for s, n in taken.items() if n}


def test_no_bin_is_large(spark):
    """Numeric texts have the least weight: their keys lie far out, but in bins as small as those of prose."""
    rows = [(i, "numbers" if i % 2 else "prose", f"{i} {i * 7} 12" if i % 2 else "some words here") for i in range(20_000)]
    slim, _ = M.mix_plan(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert slim.groupBy("source", "bin").count().agg({"count": "max"}).first()[0] < 40


def test_names_like_working_columns(spark):
    df = spark.createDataFrame([(i, "s", "a b c", 1, 2, 3, 4) for i in range(20)], "doc_id long, source string, text string, __pick int, bin int, p_cut int, times int")
    out = M.repeat_by_mix(df)
    assert out.columns == df.columns and out.count() == 30
    long = spark.createDataFrame([(1, "s", "word " * 400_000), (2, "s", "a")], "doc_id long, source string, text string")  # 2 MB
    assert {r.doc_id: r["size"] for r in M.mix(long).collect()} == {1: 400_000, 2: 1}
