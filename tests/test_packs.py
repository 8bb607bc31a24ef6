"""Packs with one fault each."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import pack_check as P
from quarry.operators import relational, validation

TEXT = "minimum lot area; front yard; setback of ten feet; building height; permitted uses; district regulations; minimum lot width; units per acre"


def source(i, **change):
    s = {"source_id": f"s{i}", "title": "T", "section_ref": "1", "jurisdiction_id": "a-va", "url": "https://city.gov/1", "effective_date": "2024-01-01", "source_type": "zoning_ordinance", "districts": ["r1"], "uses": ["general"], "excerpt": TEXT}
    return {**s, **change}


def pack(path, sources, **change):
    j = {"jurisdiction_id": "a-va", "name": "A", "coverage_status": "qa_ready", "state": "VA", "state_fips": "51", "county_fips": "1", "place_fips": "2", "jurisdiction_type": "municipality", "parent_jurisdiction_id": "county-va", "official_source_urls": ["https://city.gov"], "zoning_map_url": "", "planning_contact": {"phone": "1"}}
    return {"path": path, "schema_version": "1.0", "verification_notes": "ok", "jurisdiction": {**j, **change}, "sources": sources}


def checked(spark, packs):
    rows = spark.createDataFrame([(json.dumps(p),) for p in packs], "v string").select(F.from_json("v", P.PACK).alias("p")).select("p.*")
    return rows, P.pack_issues(rows)


def test_issues(spark):
    faults = [
        ("source_id: repeated", source(0)), ("title: required", source(1, title=None)), ("section_ref: empty", source(2, section_ref=" ")), ("source_type: not allowed", source(3, source_type="poem")), ("url: scheme", source(4, url="local://x")), ("url: todo", source(5, url="https://todo.gov")), ("url: placeholder", source(6, url="https://www.example.org/x")),
        ("districts: none", source(7, districts=[""])), ("districts: only unknown", source(8, districts=["Unknown"])), ("uses: none", source(9, uses=[])), ("jurisdiction_id: another's", source(10, jurisdiction_id="b-va")), ("jurisdiction_id: '*' is for laws", source(11, jurisdiction_id="*", metadata={"applies_to_states": ["va"]})),
        ("metadata.applies_to_states: not the pack's", source(12, jurisdiction_id="*", source_type="state_law", metadata={"applies_to_states": ["MD"]})), ("excerpt or full_text: required", source(13, excerpt="")), ("metadata.fallback_reason: required", source(14, url="file:///x", metadata={"curated_local_fallback": True})),
    ]
    good = [source(0), source(15, jurisdiction_id="county-va"), source(16, url="local://x", metadata={"curated_local_fallback": True, "fallback_reason": "r"}), source(17, jurisdiction_id="*", source_type="fire_code", metadata={"applies_to_states": [" va "]})]
    rows, issues = checked(spark, [pack("p1", good), pack("p2", [s for _, s in faults])])
    got = sorted((r.path, r.place, r.issue) for r in issues.collect())
    assert got == sorted(("p2", i, t) for i, (t, _) in enumerate(faults))
    assert [tuple(r) for r in P.pack_summary(rows, issues).orderBy("path").collect()] == [("p1", "a-va", 4, 0, 0), ("p2", "a-va", 15, 14, 1)]
    assert [r.jurisdiction.coverage_status for r in P.promoted(rows, issues).collect()] == ["source_indexed"]


def test_pack_issues(spark):
    thin = [source(i, excerpt="front yard, setback", full_text=None) for i in range(3)]
    warned = [source(10 + i, excerpt="front yard, setback, maximum height, uses permitted, lot width of, units per acre") for i in range(3)]
    packs = [pack("a", thin), pack("b", warned), pack("c", thin[:2] and [source(20), source(21)], coverage_status="", jurisdiction_type="x", official_source_urls=["ftp://x"], planning_contact={"url": "https://example.com"}), {**pack("d", []), "schema_version": "2", "verification_notes": "", "jurisdiction": None}]
    _, issues = checked(spark, packs)
    got = {}
    for r in issues.collect():
        got.setdefault(r.path, []).append((r.severity, r.issue))
    assert got["a"] == [("error", "topics missing: density, district regulations, height limits, lot area, lot width, permitted uses")]
    assert got["b"] == [("warning", "topics missing: district regulations, lot area")]
    assert sorted(x for _, x in got["c"]) == ["jurisdiction.coverage_status: empty", "jurisdiction.jurisdiction_type: not allowed", "jurisdiction.official_source_urls: scheme", "jurisdiction.planning_contact.url: placeholder"]
    assert {"schema_version", "verification_notes", "jurisdiction: no object", "sources: none"} <= {x for _, x in got["d"]}


@pytest.mark.parametrize("url,local,want", [("", False, "missing"), ("https://a.gov", False, None), ("HTTPS://u@a.gov:80/x", False, None), ("/path", True, "scheme"), ("/path", False, "scheme"), ("local://x", True, None), ("file:///x", True, None), ("local://x", False, "scheme"), ("https://example.net", False, "placeholder"), ("https://x.example.gov/a", True, "placeholder"), ("https://x.example.org", False, None), ("https://a.gov/ToDo", False, "todo")])
def test_urls(spark, url, local, want):
    assert spark.range(1).select(validation.url_problem(F.lit(url), local).alias("x")).first().x == want


def test_citations_of_other_places(spark):
    cited = spark.createDataFrame([(1, "s1"), (1, "s2"), (2, "s3"), (3, ""), (4, "s9"), (5, None), (6, "s1")], "analysis long, source string")
    known = spark.createDataFrame([("s1", True, "a", None), ("s2", False, "*", ["va"]), ("s3", True, "b", None)], "source string, dated boolean, jurisdiction string, states array<string>")
    targets = spark.createDataFrame([(i, "a", "p", "VA") for i in range(1, 7)], "analysis long, target string, parent string, state string")
    got = {r.analysis: r for r in relational.citation_check(cited, known, targets).collect()}
    assert [got[i].valid for i in range(1, 7)] == [True, False, False, False, False, True]
    assert (got[2].foreign, got[3].invalid_ids, got[4].unknown, got[1].undated) == (1, ["<missing>"], 1, 1)
    assert relational.citation_check(cited, known.limit(0)).where("analysis = 4").first().unknown == 0
