"""Cases that the tables don't hold."""

import json
import re
import time

import pytest
from pyspark.sql import functions as F

from quarry.functions import numbers as N
from quarry.functions import text as X
from quarry.operators import chunking, html, relational, retrieval, sequences
from quarry.sources import packs
from quarry.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_white_space_and_refs(spark):
    assert one(spark, X.collapse(F.lit(" a\xa0 b\t\nc　"))) == "a b c"
    for given, want in (("Sec. 10-24.", "10-24"), ("Section  3  A", "3 a"), ("§ 7.1", "7.1")):
        assert one(spark, X.section_ref(F.lit(given))) == want
    assert one(spark, X.stem_title(F.lit("my-file_name"))) == "My File Name"
    assert one(spark, N.lenient_date(F.lit("2024-02-31"))) is None
    assert str(one(spark, N.lenient_date(F.lit("2024-02-03T10:00:00Z")))) == "2024-02-03"


@pytest.mark.parametrize("query,want", [("How tall may it be?", True), ("minimum lot size", True), ("retail store", False), ("backyard shed", False), ("the FAR here", True), ("how far is it", False), ("graveyard business", False), ("F.A.R. limit", True), ("front yard", True)])
def test_dimensional_requests(spark, query, want):
    assert one(spark, retrieval.is_dimensional(F.lit(query))) is want


@pytest.mark.parametrize("text,want", [("Twelve (12,345) square feet", True), ("35 feet.", True), ("chapter 12 fee 300", False), ("20 ft. high", True), ("2 acres", True), ("section 5", False)])
def test_measures(spark, text, want):
    assert one(spark, retrieval.has_measure(F.lit(text))) is want


def test_chunks_repeat_the_header():
    rows = ["Use | R-1 | R-2"] + [f"row {i} | P | C" for i in range(200)]
    chunks = chunking.pack("intro\n" + "\n".join(rows))
    assert len(chunks) > 2 and all(len(c) <= 900 for c in chunks)
    assert all(c.startswith("Use | R-1 | R-2\nrow") for c in chunks[1:])
    wide = "h" * 895 + " | a | b"
    assert all(not c.startswith("hhh") for c in chunking.pack("\n".join([wide, *rows[1:150]]))[1:])
    assert chunking.pack("") == [] and chunking.pack(None) == [] and chunking.pack(" \n ") == []
    assert chunking.pack("x" * 2000) == ["x" * 2000]
    band = chunking.pack("\n".join(["A | B | C", *rows[1:100], "between", "D | E | F", *rows[1:100]]))
    assert band[-1].startswith("D | E | F")


def test_chunk_building(spark):
    md = "# Top\npre\n## One\n" + "alpha " * 30 + "\n### Two\n" + "beta " * 30 + "\n#### not a split\nx"
    rows = [("s1", "T", "en", ["d"], ["u"], "ref", md, True), ("s2", "T", "en", ["d"], ["u"], "ref", "tiny", False), ("s3", "T", "en", ["d"], ["u"], "ref", None, False)]
    df = spark.createDataFrame(rows, "source_id string, title string, jurisdiction_id string, districts array<string>, uses array<string>, section_ref string, full_text string, is_markdown boolean")
    got = chunking.build_chunks(df).orderBy("source_id", "chunk_index").collect()
    assert [(r.source_id, r.chunk_index, r.section_ref) for r in got] == [("s1", 0, "One"), ("s1", 1, "Two"), ("s2", 0, "ref")]
    assert got[0].chunk_text.startswith("[T] alpha") and got[2].chunk_text == "[T] tiny"
    assert got[0].chunk_id.startswith(f"s1:chunk:0:{got[0].source_text_hash[:12]}:")


@pytest.mark.parametrize("page,want", [
    ("<p>a</p><p>b</p>", "a\n\nb"), ("<nav>x<p>y</p></nav>z", "z"), ("<table><tr><td>A</td><td></td><td><p>P</p></td></tr></table>", "A | | P |"), ("<td>x<br/>y</td>", "x y |"),
    ("<img src='/a/np.png'> <img alt='a long name'>", "np"), ("a&nbsp;&amp;\n b", "a & b"), ("<script>1<2</script>ok", "ok"), ("", ""), (None, ""), ("<ul><li>1<li>2</ul>", "1\n2"),
])
def test_page_text(page, want):
    assert html.page_text(page) == want


def slow_throttle(times, limit, seconds):
    held, out = [], []
    for t in times:
        held = [x for x in held if t - x <= seconds]
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out


def test_throttle_and_quota(spark):
    import random

    rng = random.Random(2)
    at, rows = {}, []
    for i in range(400):
        k = rng.choice("ab")
        at[k] = at.get(k, 0) + rng.choice((0, 10, 30, 60, 61))
        rows.append((k, i, at[k]))
    df = spark.createDataFrame(rows, "key string, event_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r.admitted for r in sequences.throttle(df, 3, 60).collect()}
    for k in "ab":
        mine = [(s, i) for kk, i, s in rows if kk == k]
        assert [got[i] for _, i in sorted(mine)] == slow_throttle([s for s, _ in sorted(mine)], 3, 60)
    e = spark.sql("select 1L user_id, 'a' event_type, id event_id, timestamp_seconds(id) ts from range(5)")
    for limit, n in ((0, 0), (-1, 5), (2, 2)):
        assert sequences.daily_quota(e, limit).where("admitted").count() == n


def test_streams(spark, tmp_path):
    e = spark.sql("select id % 2 user_id, 'a' event_type, id event_id, timestamp_seconds(id * 20) ts, 1.0 value from range(40)")
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    for name, df, want in (("quota", events.daily_admission(stream, 3), 6), ("throttle", events.throttled(stream, 1, 60), 20)):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).where("admitted").count() == want, name
    for _ in range(2):  # a second run over the same rows adds nothing
        q = events.index_new(spark.readStream.schema("event_id long").parquet(str(tmp_path / "in")), str(tmp_path / "index"), str(tmp_path / f"c{_}"), "event_id")
        q.awaitTermination()
        assert spark.read.parquet(str(tmp_path / "index")).count() == 40
    assert events.window_counts(e, "5 minutes").count() == 3


def test_packs(spark, tmp_path):
    folder = tmp_path / "va" / "x"
    folder.mkdir(parents=True)
    source = {"source_id": "a", "title": "T", "districts": ["R-1"], "metadata": {"k": "v"}}
    (folder / "manifest.json").write_text(json.dumps({"schema_version": "1", "jurisdiction": {"jurisdiction_id": "x-va"}, "sources": [source, {"source_id": "b"}]}))
    (tmp_path / "va" / "broken").mkdir()
    (tmp_path / "va" / "broken" / "manifest.json").write_text("{")
    (folder / "classification_rules.json").write_text(json.dumps({"rules": [{"title_contains": "t", "districts": ["d"]}]}))
    got = packs.read_packs(spark, str(tmp_path)).collect()
    assert sorted((r.source_id or "", r.jurisdiction_id or "") for r in got) == [("", ""), ("a", "x-va"), ("b", "x-va")]
    assert packs.read_rules(spark, str(tmp_path)).count() == 1
    (folder / "a-doc.md").write_text("source_id: q\ntitle: One: two\nnote\n# Head\nbody")
    (folder / "b-doc.txt").write_text("source_id: q\n\n# Head\nbody")
    (folder / "c-doc.txt").write_text("plain")
    docs = {r.source_id: r for r in packs.read_text_documents(spark, str(tmp_path)).collect()}
    assert docs["q"].title == "Head" and not docs["q"].is_markdown and docs["c-doc"].title == "C Doc"
    lines = spark.createDataFrame([('{"key":"a","response":{"embedding":{"values":[1]}}}',), ('{"key":"b","values":[2.5]}',), ("{",)], "value string")
    assert sorted((r.key or "", (r["values"] or [0])[0]) for r in packs.result_lines(lines).collect()) == [("", 0), ("a", 1), ("b", 2.5)]


def test_upsert_and_fingerprints(spark):
    held = spark.createDataFrame([(1, "a", "t0"), (2, None, "t0")], "id long, v string, created_at string")
    new = spark.createDataFrame([(2, "b", "t1"), (3, None, "t1")], "id long, v string, created_at string")
    assert sorted(map(tuple, relational.upsert(held, new, "id").collect())) == [(1, "a", "t0"), (2, "b", "t0"), (3, None, "t1")]
    a = relational.fingerprint(held, "id", "v").first()["fingerprint"]
    assert a == relational.fingerprint(held.orderBy(F.desc("id")), "id", "v").first()["fingerprint"] != relational.fingerprint(new, "id", "v").first()["fingerprint"]
    assert relational.fingerprint(held.limit(0), "id").first()["fingerprint"] == "" == relational.ordered_fingerprint(held.limit(0), "id").first()["fingerprint"]


def plain_pick(met, hits, marked, measures, top=8, per_section=2):
    """met: (score, chunk, section, uses, measure, named) of one request; hits: (chunk, score) in order."""
    ranked = sorted((x for x in met if x[0] > 0), key=lambda x: (-round(x[0], 9), x[1]))
    count, out = {}, []
    for x in ranked:
        key = x[2] or x[1]
        if count.get(key, 0) < per_section and len(out) < top:
            out.append((x[1], x[0]))
            count[key] = count.get(key, 0) + 1
    uses = {x[1]: x[3] for x in met}
    out += [h for h in hits if h[0] not in [c for c, _ in out]][:2]
    for marker, n in marked:
        lack = n - sum(marker in uses.get(c, hit_uses.get(c, [])) for c, _ in out)
        out += [(x[1], x[0]) for x in ranked if marker in x[3] and x[1] not in [c for c, _ in out]][: max(0, lack)]
    some = [x for x in ranked if x[4] and x[1] not in [c for c, _ in out]]
    return out + [(x[1], x[0]) for x in sorted(some, key=lambda x: not x[5])][:measures]


hit_uses = {}


def test_hybrid_retrieve_equals_plain_picks(spark):
    from quarry.plans.retrieval import _given

    q, c = _given(spark, "/root/testdata/sf0.001")
    q = q.withColumn("description", F.when(F.col("qid") % 2 == 0, F.concat("description", F.lit(" What is the smallest permitted lot? Lot area, sq ft"))).otherwise(F.col("description")))
    n = F.substring("chunk_id", 5, 20).cast("long")
    c = c.withColumn("text", F.when(n % 5 == 0, F.concat("text", F.lit(" Lot area 12,000 sq ft"))).when(n % 5 == 1, F.concat("text", F.lit(" Height 35 feet."))).otherwise(F.col("text")))
    c = c.withColumn("uses", F.when(n % 10 == 3, F.concat("uses", F.array(F.lit("use_standards")))).otherwise(F.col("uses")))
    by = {}
    for r in retrieval.vector_hits(q, c).collect():
        by.setdefault(r.qid, []).append(r)
    got = {}
    for r in retrieval.hybrid_retrieve(q, c).orderBy("qid", "slot").collect():
        got.setdefault(r.qid, []).append((r.chunk_id, round(r.score, 9)))
    assert len(by) > 10
    for qid, rows in by.items():
        near = {}
        for r in rows:
            near[r.chunk_id] = max(near.get(r.chunk_id, -9), r.score)
            hit_uses[r.chunk_id] = r.uses
        one = {r.chunk_id: r for r in rows}
        met = [(near[k] + r.keywords, k, r.section_ref, r.uses, r.measure, r.named) for k, r in one.items() if r.keywords > 0]
        hits = [(r.chunk_id, near[r.chunk_id]) for r in sorted((r for r in rows if r.kind == 2), key=lambda r: r["rank"])]
        assert got[qid] == [(k, round(s, 9)) for k, s in plain_pick(met, hits, retrieval.MARKED, 2)]


@pytest.mark.parametrize("bounds", [{"SMALL": 1}, {"MOST_TOKENS": 3}, {"SMALL": 1, "MOST_TOKENS": 3}])
def test_candidates_beyond_their_bounds(spark, monkeypatch, bounds):
    """More requests than are broadcast, and more tokens than are looked up as one set, give the same pairs and scores."""
    from quarry.plans.retrieval import _given

    q, c = _given(spark, "/root/testdata/sf0.001")
    q = q.withColumn("description", F.concat("description", F.lit(" Minimum LOT  AREA, or F.A.R.?")))
    c = c.withColumn("text", F.concat("text", F.when(F.substring("chunk_id", -1, 1) < "5", " lot area 12 acres").otherwise(" 35 feet")))
    want = sorted(map(tuple, retrieval.candidates(q, c).select("qid", "chunk_id", "score", "measure", "named").collect()))
    assert {(m, n) for *_, m, n in want} == {(True, True), (True, False)}
    for name, value in bounds.items():
        monkeypatch.setattr(retrieval, name, value)
    assert sorted(map(tuple, retrieval.candidates(q, c).select("qid", "chunk_id", "score", "measure", "named").collect())) == want


def test_no_tokens_and_null_texts(spark):
    """Requests without a token, and chunks without text: no error; a chunk without text has no score."""
    q = spark.createDataFrame([(1, "en", "unknown", "", "?")], "qid int, jurisdiction_id string, district string, use string, description string").withColumn("district", F.lit("§"))
    c = spark.createDataFrame([("a", "en", "", ["*"], ["general"], None), ("b", "*", "", ["*"], ["general"], "some text")], "chunk_id string, jurisdiction_id string, section_ref string, districts array<string>, uses array<string>, text string")
    assert sorted(map(tuple, retrieval.candidates(q, c).select("chunk_id", "score", "measure").collect())) == [("a", None, False), ("b", 4.0, False)]


def test_hash_embedding(spark):
    import hashlib

    text = "The lot, the LOT area 12 x"
    want = [0.0] * 64
    for t in re.findall("[a-z0-9]+", text.lower()):
        d = hashlib.sha256(t.encode()).digest()
        want[int.from_bytes(d[:2], "big") % 64] += 1 if d[2] % 2 == 0 else -1
    size = sum(x * x for x in want) ** 0.5
    assert one(spark, N.hash_embedding(F.lit(text))) == pytest.approx([x / size for x in want])
    assert one(spark, N.hash_embedding(F.lit(" "))) == [0.0] * 64


@pytest.mark.parametrize("query", ["size of my lot", "What is the smallest permitted lot?", "sq ft needed", "F.A.R. limits", "how many storeys"])
def test_whole_measure_patterns(spark, query):
    assert one(spark, retrieval.is_dimensional(F.lit(query)))


def test_hash_embedding_of_long_and_odd_texts(spark):
    """Tokens as Spark lower-cases them, nulls as texts without tokens, and a long text in one pass: its cells were gone through 128 times before."""
    import hashlib
    import re

    texts = [None, "", "\u0130X \u212a9 Stra\u00dfe A1", "it's a-b_c", " ".join(f"w{i % 5000}" for i in range(300_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    began = time.monotonic()
    got = {r.i: r.v for r in df.select("i", N.hash_embedding(F.col("t")).alias("v")).collect()}
    assert time.monotonic() - began < 20
    for i, text in enumerate(texts):
        want = [0] * 64
        for token in re.findall("[a-z0-9]+", (text or "").lower()):
            h = hashlib.sha256(token.encode()).digest()
            want[(h[0] * 256 + h[1]) % 64] += 1 - h[2] % 2 * 2
        size = sum(x * x for x in want) ** 0.5 or 1
        assert got[i] == [x / size for x in want]


def test_embedding_is_made_once(spark, tmp_path):
    from quarry.plans.scalar import x47_hash_vector

    spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = x47_hash_vector(spark, str(tmp_path))
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1 and {r.doc_id for r in made.collect()} == {1}


def test_runners_equal_the_two_passes(spark):
    from quarry.operators import validation as V

    met = spark.createDataFrame([(q, f"c{i:02}", f"s{i % 3}" if i % 4 else "", ["u"], float((i * 7 % 11) - 1), False, False) for q in (1, 2) for i in range(40 if q == 1 else 3)], "qid int, chunk_id string, section_ref string, uses array<string>, score double, measure boolean, named boolean")
    top = retrieval.pick(met).select("qid", "slot", "chunk_id")
    want = V.reserve_hits(top, retrieval.rank(met).where("rank between 5 and 30").select("qid", F.col("rank").alias("place"), "chunk_id"), 2)
    assert sorted(retrieval.pick(met, runners=(5, 30, 2)).select("qid", "slot", "chunk_id").collect()) == sorted(want.collect())


def test_pages_cross_to_python_in_bounded_batches(spark):
    from quarry.operators import fragments

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    pages = spark.createDataFrame([(i, "<p>" + "word " * 40_000 + f"{i}</p>") for i in range(30)] + [(99, None)], "page_id int, html string").coalesce(1)
    for change in (html.clean_pages, lambda p: fragments.stripped_pages(p, (fragments.Rule("nav"),))):
        spark.conf.set(key, "256000000")
        made = change(pages)
        assert int(spark.conf.get(key).rstrip("b")) <= 2_000_000
        got = {r.page_id: r[1] for r in made.collect()}
        assert len(got) == 31 and got[99] == "" and all(f"word {i}" in got[i] for i in range(30))


def test_resolve_keeps_an_address_one_row(spark):
    from quarry.operators import validation as V

    rules = spark.createDataFrame([(2, "locality", "A", None, "S", "two"), (1, "county", None, "C", "s", "one"), (3, "locality_and_county", "a", "c", "S", "three"), (4, "locality", "a", None, None, "none")], "pos int, strategy string, locality string, county string, state string, jurisdiction_id string")
    rows = spark.createDataFrame([(1, "a", "c", "s"), (2, "b", "C", "S"), (3, "b", None, "S"), (4, "a", "c", None), (5, "x", "y", "S"), (5, "A", "y", "S")], "k int, locality string, county string, state string")
    made = V.resolve(rows, rules, "k")
    assert {r.k: r.jurisdiction_id for r in made.collect()} == {1: "two", 2: "one", 3: None, 4: None, 5: "two"}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and plan.count("FileScan") == 0
