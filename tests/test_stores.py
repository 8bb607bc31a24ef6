"""Readers, merges and writers on files, and functions on titles and names."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from quarry.functions import pages as G
from quarry.sources import stores as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("host,title,want", [
    ("municode", "Sec 4211. - Use", "Sec. 4211"), ("municode", "§ 6-100. - Intent.", "§ 6-100"), ("municode", "R-12 A", "R-12"), ("municode", "Intent", None), ("amlegal", "1141.01 ZONING", "1141.01"), ("amlegal", "1141 ZONING", None), ("ecode360", "SECTION 72-72 Of", "72-72"), ("ecode360", "§ 380-1: T", "§ 380-1"),
    ("encodeplus", "Appendix C: x", "Appendix C"), ("encodeplus", "Purpose: y", "Purpose"), ("encodeplus", "", None), ("madcapflare", "1.2.1. General", "1.2.1"), ("madcapflare", "1.2.1", None), ("municipalcodeonline", "Secs 10-9 R", "Secs. 10-9"), ("municipalcodeonline", "Sec. 10-24 R", "Sec. 10-24"), ("generic_html", "Article  IV Uses", "Article IV"), ("amlegal", None, None),
])
def test_section_numbers(spark, host, title, want):
    assert one(spark, G.section_number(F.lit(title).cast("string"), host)) == want


def test_names_and_logs(spark):
    assert one(spark, G.camel_title(F.lit("FranklinZoningOrdinance_2020"))) == "Franklin Zoning Ordinance 2020"
    assert one(spark, G.page_count(F.lit('<a rel="last" href="../437/">'))) == 437 and one(spark, G.page_count(F.lit('<div class="nav-links">9 12 310</div>'))) == 310 and one(spark, G.page_count(F.lit(""))) == 0
    assert one(spark, G.without_state(F.lit("A, B, VA"))) == "A, B" and one(spark, G.without_state(F.lit("Roanoke"))) == "Roanoke"
    names = lambda k, n, c: one(spark, G.county_names(F.lit(k), F.lit(n), F.lit(c).cast("string")))
    assert names("independent_city", "Roanoke, VA", None) == ["Roanoke City", "City of Roanoke"] and names("county", "Kent, MD", "") == ["Kent"] and names("municipality", "X, VA", "Mont") == ["Mont"] and names("municipality", "X, VA", None) == []
    assert [one(spark, G.clean_fips(F.lit(x))) for x in (" 51 ", "TODO", "12345678901", "")] == ["51", None, None, None]
    assert one(spark, G.failure_reason(F.lit("a\nfetch failed: x\nbye\n"), "f")) == "fetch failed: x" and one(spark, G.failure_reason(F.lit("a\n b "), "f")) == "b" and one(spark, G.failure_reason(F.lit(None).cast("string"), "f")) == "f"
    assert one(spark, G.point_id(F.lit("añ:chunk:1"))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "añ:chunk:1"))
    assert one(spark, G.not_after(F.lit("2024-02-01"), F.lit("2024-01-31"))) is False and one(spark, G.not_after(F.lit(""), F.lit("2024"))) is True
    assert one(spark, G.string_list(F.array(F.lit(" a "), F.lit(" ")))) == ["a"] and one(spark, G.payload(F.lit("[1]"))) == {} and one(spark, G.payload(F.lit('{"a": 1}'))) == {"a": "1"}
    keys = {one(spark, G.request_key(F.lit("d"), F.lit("u"), j, F.lit("q"), F.lit("1"))) for j in (F.lit("j"), F.lit(None).cast("string"), F.lit("k"))}
    assert len(keys) == 3
    r = one(spark, G.source_record(F.lit(" "), F.lit("1-2"), F.lit("a  b\n\n c"), F.lit(""), F.lit("2024")))
    assert (r.title, r.full_text, r.effective_date, r.date_source) == ("1-2", "a b\nc", "2024", "unknown")
    assert one(spark, G.code_url(F.lit("https://h/"), F.lit("San José"), F.lit("n1"))) == "https://h/san-jos/n1"


def test_tables(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("u", 1)], "user string, n int")
    S.append(rows, log), S.append(rows, log)
    assert spark.read.parquet(log).count() == 2
    S.reset(spark, log)
    assert spark.read.schema("user string, n int").parquet(log).count() == 0
    held = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "id string, n int, created_at string")
    held.write.parquet(str(tmp_path / "v1"))
    S.merge(spark, str(tmp_path / "v1"), str(tmp_path / "v2"), spark.createDataFrame([("b", 9, "new"), ("c", 3, "new")], held.schema), "id")
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "v2")).collect()) == [("a", 1, "old"), ("b", 9, "old"), ("c", 3, "new")]
    empty = spark.createDataFrame([], "kind string, version string")
    told = spark.createDataFrame([("source.seed.completed", "7")], empty.schema)
    seed = spark.createDataFrame([("a", 5, "s"), ("", 6, "s"), (None, 7, "s")], held.schema)
    assert S.seeded(held, seed, "id", "7", told).count() == 2 and S.seeded(held.limit(0), seed, "id", "7", told).count() == 1 and {r.n for r in S.seeded(held, seed, "id", "8", told).collect()} == {5, 2}
    chunks, vectors = spark.createDataFrame([("c1",), ("c2",)], "chunk_id string"), spark.createDataFrame([("c1", [1.0, 2.0]), ("c2", [1.0])], "chunk_id string, vector array<double>")
    with pytest.raises(ValueError):
        S.points(chunks, vectors, 2)
    assert S.points(chunks.where("chunk_id = 'c1'"), vectors, 2).count() == 1


def test_users_and_analyses(spark):
    users = spark.createDataFrame([("u", "e", "pro", True, 1)], "user string, email string, tier string, disabled boolean, created int")
    new = spark.createDataFrame([("u", "n", None, False, 9), ("v", "m", None, None, 9)], users.schema)
    assert sorted(tuple(r) for r in S.upsert_users(users, new).collect()) == [("u", "n", "pro", True, 1), ("v", "m", "free", False, 9)]
    projects = spark.createDataFrame([(1, "u", "draft"), (2, "v", "draft")], "project int, user string, status string")
    analyses, flipped = S.saved_analysis(spark.createDataFrame([(1, "x")], "project int, decision string"), projects, spark.createDataFrame([(1, "y")], "project int, decision string"))
    assert [tuple(r) for r in analyses.collect()] == [(1, "y")] and {r.project: r.status for r in flipped.collect()} == {1: "analyzed", 2: "draft"}
    log = spark.createDataFrame([("u", "login"), ("v", "login")], "user string, kind string")
    kept, told = S.forget_users(users, projects, log, log)
    assert [r.project for r in kept.collect()] == [2] and sorted((r.user or "") for r in told.collect()) == ["", "", "v", "v"]


def test_files(spark, tmp_path):
    for name, value in (("list.json", [{"id": "a", "n": 1}, {"id": "b"}]), ("object.json", {"id": "c"})):
        (tmp_path / name).write_text(json.dumps(value, indent=1))
    (tmp_path / "broken.json").write_text("[{")
    assert sorted(r.id for r in S.read_json_rows(spark, str(tmp_path / "*.json"), "id:string,n:int").collect() if r.id) == ["a", "b"]
    assert S.read_json_rows(spark, str(tmp_path / "none" / "x.json"), "id:string,n:int").count() == 0
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "1.json").write_text(json.dumps({"source_id": "a", "full_text": "x" * 900}))
    (tmp_path / "docs" / "2.json").write_text(json.dumps([{"source_id": "b", "excerpt": "e"}]))
    assert {r.source_id: len(r.excerpt) for r in S.read_json_documents(spark, str(tmp_path / "docs")).collect()} == {"a": 500, "b": 1}
    rows = spark.createDataFrame([("a", "t", ""), ("b", "t", "u")], "id string, title string, url string")
    assert [tuple(r) for r in S.lacking(rows, "id", "title", "url").collect()] == [("a", ["url"])]
    sources = spark.createDataFrame([("j", "s2", "long enough text"), ("j", "s1", "long enough text"), ("j", "s3", "short"), ("k", "s4", "long enough text")], "jurisdiction_id string, source_id string, full_text string")
    S.write_manifests(sources, str(tmp_path / "m"), "source_id", "full_text")
    got = {json.loads(r.value)["jurisdiction_id"]: [s["source_id"] for s in json.loads(r.value)["sources"]] for r in spark.read.text(str(tmp_path / "m")).collect()}
    assert got == {"j": ["s1", "s2"], "k": ["s4"]}
    S.write_checklists(spark.createDataFrame([("a", "T", ["x", "y"], [], ["w"])], "id string, title string, steps array<string>, documents array<string>, warnings array<string>"), str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c"), wholetext=True).first().value == "T\n\nSteps\n- x\n- y\n\nWarnings\n- w\n"
    registry, rest = S.enriched_registry(spark.createDataFrame([("1", None), ("2", "own")], "section_ref string, full_text string"), spark.createDataFrame([("1", "b", 2), ("1", "a", 1), ("9", "z", 3)], "section_ref string, full_text string, position int"))
    assert {r.section_ref: r.full_text for r in registry.collect()} == {"1": "a", "2": "own"} and [r.section_ref for r in rest.collect()] == ["9"]
    m = lambda **x: F.create_map(*[F.lit(v) for kv in x.items() for v in kv])
    assert one(spark, S.enriched(m(a="1"), m(a="2", b="2"), m(b="3", c="3"))) == {"a": "1", "b": "2", "c": "3"}
    assert one(spark, S.flat_payload({"url": F.lit(None).cast("string"), "n": F.lit(3)}, m(n="9", k="v"))) == {"url": "", "n": "3", "k": "v"}
