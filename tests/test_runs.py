"""Constraints, replies, look-ups and resumable batches."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import replies as R
from quarry.operators import constraints as C
from quarry.operators import ledger as G
from quarry.sources import lookups as K
from quarry.sources.versions import Versions


def test_every_kind_of_constraint(spark):
    rules = (
        C.Constraint("a", "required"), C.Constraint("a", "min_length", 2), C.Constraint("a", "max_length", 4), C.Constraint("n", "at_least", 0.0), C.Constraint("n", "at_most", 1.0),
        C.Constraint("a", "one_of", ("xx", "yyy", "zzzzz")), C.Constraint("a", "matches", "^[x-z]+$"),
    )
    data = [(1, "xx", 0.5), (2, None, None), (3, "x", -1.0), (4, "zzzzz", 2.0), (5, "ab", float("nan")), (6, "xx", 0.5)]
    df = spark.createDataFrame(data, "id long, a string, n double")
    kept, rejected, counters = C.split(df, rules)
    assert sorted(r.id for r in kept.collect()) == [1, 6] and kept.columns == df.columns
    assert {r.id: r.reasons for r in rejected.collect()} == {
        2: ["a: required"], 3: ["a: min_length 2", "n: at_least 0.0", "a: one_of xx|yyy|zzzzz"], 4: ["a: max_length 4", "n: at_most 1.0"],
        5: ["n: at_least 0.0", "n: at_most 1.0", "a: one_of xx|yyy|zzzzz", "a: matches ^[x-z]+$"],
    }
    reasons = [x for r in rejected.collect() for x in r.reasons]
    assert counters == {"rows": 6, "kept": 2, "rejected": 4} | {c.name: reasons.count(c.name) for c in rules}
    assert C.split(df.limit(0), rules)[2]["rows"] == 0


def test_a_right_chunk_and_a_wrong_one(spark):
    right = {"chunk_id": "c1", "source_id": "s1", "title": "Title", "chunk_text": "ten letters", "chunk_index": 0, "source_text_hash": "0" * 64, "section_ref": "1", "jurisdiction_id": None, "url": None, "effective_date": None, "source_type": "guide", "token_count": 2}
    kind = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in right.items())
    df = spark.createDataFrame([tuple(right.values()), tuple((right | {"chunk_index": -1, "chunk_text": "short", "source_text_hash": "0"}).values())], kind)
    assert sorted([r.reasons for r in C.judged(df, C.CHUNK).collect()]) == [[], ["chunk_text: min_length 10", "chunk_index: at_least 0", "source_text_hash: min_length 64"]]


FLAT = {"feasibility": "feasible", "confidence": 0.9, "summary": "s", "citation_chunk_ids": ["a", "b", "zz", "zz"], "warnings": [1, "w"], "required_permits": ["p"], "permit_path": "by right", "unresolved_questions": ["q"]}


@pytest.mark.parametrize(
    ("reply", "allowed", "want"),
    [
        (FLAT, ["a", "b"], {"decision": "likely_allowed", "confidence": 0.9, "citation_ids": ["a", "b"], "warnings": ["1", "w", "Invalid citation IDs were removed: zz"], "required_permits": ["p"], "permit_path": "by right", "unresolved_questions": ["q"], "error": None}),
        ({"decision": "restricted", "follow_up_questions": ["x", 3], "required_permits": ["outer"], "compliance": {"feasibility": "maybe", "confidence": "0.2"}}, ["a"], {"decision": "restricted", "feasibility": "unknown", "confidence": 0.2, "follow_up_questions": ["x", "3"], "required_permits": ["outer"], "warnings": [], "summary": R.NO_SUMMARY}),
        (FLAT | {"citation_chunk_ids": ["zz"]}, ["a"], {"confidence": 0.3, "citation_ids": [], "warnings": ["1", "w", "Invalid citation IDs were removed: zz", R.CAPPED]}),
        (FLAT, [], {"citation_ids": ["a", "b", "zz", "zz"], "confidence": 0.9}),
        (FLAT | {"confidence": 7}, None, {"confidence": 1.0}),
        (FLAT | {"confidence": [1]}, None, {"confidence": 0.3}),
        (FLAT | {"decision": "surely", "compliance": [1]}, None, {"decision": "unknown", "feasibility": "feasible"}),
        ({"findings": [{"category": "", "status": "compliant", "summary": 5, "citation_ids": ["a", "zz"]}, "odd", {"status": "?", "confidence": "high"}]}, ["a"], {"decision": "unknown", "findings": [("general", "compliant", "5", ["a"], 0.3), ("general", "unknown", "", [], 0.3)]}),
        ({"warnings": {"a": 1}, "findings": "none", "required_permits": []}, None, {"warnings": [], "findings": [], "required_permits": []}),
        ({}, None, {"decision": "unknown", "confidence": 0.3, "error": None}),
        ("[1]", None, {"error": "no object", "decision": "unknown", "confidence": 0.0, "findings": []}),
        ("sorry", None, {"error": "no JSON", "citation_ids": [], "summary": R.NO_SUMMARY}),
        ("", ["a"], {"error": "no JSON"}),
        (None, ["a"], {"error": "no reply", "warnings": []}),
        ('```json\n{"feasibility": "infeasible"}\n```', None, {"decision": "restricted", "error": None}),
    ],
)
def test_replies(spark, reply, allowed, want):
    df = spark.createDataFrame([(json.dumps(reply) if isinstance(reply, dict) else reply, allowed, "old")], "reply string, allowed array<string>, error string")
    got = R.normalised(df).first().asDict()
    got["findings"] = [tuple(f) for f in got["findings"]]
    assert {k: got[k] for k in want} == want


def scanned(df):
    """Rows that the scan of a collected frame gave."""
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value(), leaf.metrics().apply("numFiles").value()


def test_look_ups_read_little(spark, tmp_path):
    rows = spark.range(200_000).select((F.col("id") * 3).alias("k"), F.md5(F.col("id").cast("string")).alias("v"), F.lit(None).cast("string").alias("__x"))
    K.write_keyed(rows.union(rows.where("k = 30")).union(rows.limit(1).withColumn("k", F.lit(None).cast("long"))), f"{tmp_path}/t", "k", buckets=16, group_bytes=20_000)
    keys = spark.createDataFrame([(30,), (30,), (31,), (299_997,), (None,), (10**12,)], "k long")
    found = K.look_up(spark, f"{tmp_path}/t", "k", keys, buckets=16)
    assert sorted((r.k, r.v) for r in found.collect()) == sorted([(r.k, r.v) for r in rows.where("k in (30, 299997)").collect()] + [(30, rows.where("k = 30").first().v)])
    n, files = scanned(found)
    assert n < 20_000 and files <= 8 and found.columns == rows.columns  # of 200,000 rows in 16 folders and more
    many = rows.where("k % 1000 = 0").select("k")
    more = K.look_up(spark, f"{tmp_path}/t", "k", many, buckets=16, few=100)
    assert more.count() == rows.where("k % 1000 = 0").count()
    assert K.look_up(spark, f"{tmp_path}/t", "k", keys.where("k is null"), buckets=16).count() == 0
    text = rows.select(F.concat(F.lit("id-"), "k").alias("k"), "v")
    K.write_keyed(text, f"{tmp_path}/u", "k", buckets=4)
    assert K.look_up(spark, f"{tmp_path}/u", "k", spark.createDataFrame([("id-9",), ("id-10",)], "k string"), buckets=4).count() == 1


def test_a_resumed_batch_equals_one_without_a_stop(spark, tmp_path):
    def work(row):
        if row["n"] % 7 == 3:
            raise G.Blocked("refused")
        if row["n"] % 5 == 1:
            raise ValueError(f"bad {row['n']}")
        return f"done {row['n']}"

    units = spark.createDataFrame([(f"u{i}", i, "x") for i in range(60)] + [(None, 1, "x"), ("u0", 0, "x")], "unit string, n int, state string")
    whole = Versions(spark, f"{tmp_path}/whole")
    counts = {r.state: r.n for r in G.run_batch(units, work, whole, "r1").collect()}
    assert counts == {"ok": 40, "blocked": 9, "failed": 11} and sum(counts.values()) == 60
    part = Versions(spark, f"{tmp_path}/part")
    real = Versions._publish
    try:
        Versions._publish = lambda *a: (_ for _ in ()).throw(RuntimeError("stopped"))
        with pytest.raises(RuntimeError):
            G.run_batch(units, work, part, "r1")
    finally:
        Versions._publish = real
    G.run_batch(units.where("n < 25"), work, part, "r1")
    assert {r.state: r.n for r in G.run_batch(units, work, part, "r2").collect()}["skipped"] == 20  # those that ended well, and those blocked
    plain = lambda t: sorted((r.unit, r.state, r.reason or "", r.result or "") for r in G.latest(t.read()).collect())
    assert plain(part) == plain(whole)
    n = len(part.log())
    G.run_batch(units, work, part, "r2")
    assert len(part.log()) == n
    for run in ("r3", "r4"):
        G.run_batch(units, work, part, run)
    assert max(r.attempt for r in part.read().where("state = 'failed'").collect()) == 3  # and no more
    assert {r.state: r.n for r in G.run_batch(units, lambda row: "ok now", part, "r5", retry_blocked=True).collect()} == {"ok": 9, "skipped": 51}
