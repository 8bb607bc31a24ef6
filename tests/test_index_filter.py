"""The index's filters against a plain reading of their rules, over random requests and chunks."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import index_filter as I
from quarry.operators import retrieval

Q = "qid int, jurisdiction_id string, parent string, state string, source_id string, source_type string, source_version string, district string, use string, effective_on_or_before string"
C = "chunk_id string, jurisdiction_id string, state string, states array<string>, source_id string, source_type string, source_version string, districts array<string>, uses array<string>, effective_date string, key string, q string"


def given(rng, n_requests=40, n_chunks=150):
    some = lambda *xs: rng.choice(xs)
    tags = lambda *xs: some(None, [], [None], rng.sample(xs, 1), rng.sample(xs, 2))
    places = ("a", "b", "A", "*", "", None)
    q = [(i, some("a", "b", "a", *places), some("p", "a", "*", "", None), some("PA", "pa", "", None), *(some(None, "", "", "x", "y") for _ in range(3)), some("d1", "d2", "unknown", "*", "", None), some("u1", "general", "*", "", None), some("2024-02-01", "", None)) for i in range(n_requests)]
    c = [(f"c{i}", some("a", "b", "p", *places), some("PA", "pa", " pa", "", None), tags(" pa ", "NJ"), *(some("x", "y", "", None) for _ in range(3)), tags("d1", "d2", "unknown", "*"), tags("u1", "u2", "general", "principal_uses"), some("2024-01-01", "2024-02-01", "2024-03-01", "", None), "k", "k") for i in range(n_chunks)]
    return q, c


def plain(q, c):
    out = []
    for qid, j, parent, state, *exact, district, use, limit in q:
        for cid, cj, cstate, states, *own, districts, uses, date, _, _ in c:
            has = lambda held, *wanted: any(w in (held or []) for w in wanted)
            if j and not (cj == j or (parent and cj == parent) or (state and cj == "*" and cstate == state)):
                continue
            if any(a and a != b for a, b in zip(exact, own, strict=True)):
                continue
            if district not in ("unknown", "*", "", None) and not has(districts, district, "unknown"):
                continue
            if use not in ("general", "*", "", None) and not has(uses, use, "general", "principal_uses"):
                continue
            ok = True
            if j:
                covers = {s.strip().upper() for s in [*(states or []), cstate] if s and s.strip()}
                ok = bool(cj) and (cj == j or (cj == parent) or (cj == "*" and bool(state) and state.upper() in covers))
            ok = ok and (district in ("unknown", "", None) or has(districts, district, "*", "unknown"))
            ok = ok and (use in ("", None) or has(uses, use, "general", "principal_uses")) and not (limit and date and date > limit)
            out.append((qid, cid, ok))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("text", [(), ("districts",), ("districts", "uses")])
def test_matches_equal_the_plain_reading(spark, monkeypatch, seed, text):
    q, c = given(random.Random(seed))
    chunks = spark.createDataFrame(c, C)
    for name in text:
        tags = F.array_compact(name)
        chunks = chunks.withColumn(name, F.when(F.size(tags) > 0, F.concat(F.lit("|"), F.array_join(tags, "|"), F.lit("|"))))
    monkeypatch.setattr(retrieval, "SMALL", 10_000 if seed else 5)
    got = sorted(map(tuple, I.matches(spark.createDataFrame(q, Q), chunks).collect()))
    assert got == plain(q, c)
    assert {ok for *_, ok in got} == {True, False}


def test_no_rows_and_repeated_rows(spark):
    q, c = given(random.Random(7), 5, 20)
    none = spark.createDataFrame([], Q)
    assert I.matches(none, spark.createDataFrame(c, C)).collect() == []
    assert I.matches(spark.createDataFrame(q, Q), spark.createDataFrame([], C)).collect() == []
    twice = sorted(map(tuple, I.matches(spark.createDataFrame(q, Q), spark.createDataFrame(c * 2, C)).collect()))
    assert twice == sorted(plain(q, c) * 2)


def test_text_tags_need_both_bars(spark):
    tags = spark.createDataFrame([("|a|b|",), ("a|b",), ("|ab|",), ("",), (None,)], "t string")
    assert [r[0] for r in tags.select(I.holds(F.col("t"), F.lit("a"), text=True)).collect()] == [True, False, False, False, False]
    assert [r[0] for r in tags.select(I.holds(F.col("t"), F.lit(None).cast("string"), F.lit("b"), text=True)).collect()] == [True, False, False, False, False]
