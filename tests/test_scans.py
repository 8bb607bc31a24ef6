"""Files of several kinds read as one table."""

import json

import pytest

from quarry.sources import scans as S


def put(folder, name, value):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_documents_of_all_suffixes(spark, tmp_path):
    put(tmp_path, "a/one.md", "source_id: s1\ndistricts: r1, r2\n# Head\nbody one")
    put(tmp_path, "b/list.json", [{"source_id": "s2", "full_text": "x" * 600, "districts": ["d"], "uses": "u, v"}, {"source_id": "s3", "title": "first"}, {"source_id": "s3", "title": "last"}, {"title": "no id"}])
    put(tmp_path, "c/single.JSON", {"source_id": "s1", "title": "later", "excerpt": "e"})
    put(tmp_path, "d/broken.json", "{no")
    put(tmp_path, "d/number.json", "7")
    put(tmp_path, "d/other.csv", "source_id\ns9")
    put(tmp_path, "z.txt", "plain words")
    rows = {r.source_id: r for r in S.read_sources(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["s1", "s2", "s3", "z"]
    assert rows["s1"].title == "later" and rows["s1"].excerpt == "e" and rows["s3"].title == "last"
    assert len(rows["s2"].excerpt) == 500 and rows["s2"].districts == ["d"] and rows["s2"].uses == ["u", "v"]
    assert rows["z"].full_text == "plain words"
    assert sorted(r.path.rsplit("/", 1)[1] for r in S.unreadable(spark, str(tmp_path)).collect()) == ["broken.json", "number.json"]


def test_registry_and_packs(spark, tmp_path):
    web = "https://a.gov/x"
    registry = put(tmp_path, "registry.json", [
        {"source_id": "a", "url": web, "retrieved_at": "2024-06-01T10:00:00Z", "coverage_status": S.PUBLIC}, {"source_id": "a", "url": "first counts"}, {"source_id": "b", "url": web, "metadata": {"retrieved_at": "20230101", "coverage_status": S.PUBLIC}},
        {"source_id": "c", "url": "local://x", "retrieved_at": "2024-06-01"}, {"url": web, "retrieved_at": "soon"}, {"source_id": "d", "url": web, "retrieved_at": "2024-13-45"},
    ])
    put(tmp_path, "packs/va/x/manifest.json", {"jurisdiction": {"coverage_status": S.PUBLIC}, "sources": [{"source_id": "a", "url": web, "retrieved_at": " ", "coverage_status": "draft"}]})
    put(tmp_path, "packs/va/y/manifest.json", {"jurisdiction": None, "sources": [{"source_id": "e", "url": "http://b", "retrieved_at": "2024-05-30"}]})
    put(tmp_path, "packs/va/z/manifest.json", "[broken")
    refs = S.source_refs(spark, registry, str(tmp_path / "packs"))
    assert refs.count() == 8
    got = sorted((r.origin.rsplit("/", 2)[1:], r.source_id, r.issue, r.age, r.level) for r in S.stale_refs(refs, "2024-06-30", 30).collect())
    at = [tmp_path.name, "registry.json"]
    assert got == sorted([(at, "<missing>", "undated", None, "warning"), (at, "b", "old", 546, "error"), (at, "c", "url", None, "warning"), (at, "d", "undated", None, "warning"), (["x", "manifest.json"], "a", "undated", None, "error"), (["y", "manifest.json"], "e", "old", 31, "warning")])
    assert S.source_refs(spark, str(tmp_path / "none.json"), str(tmp_path / "nothing")).count() == 0


@pytest.mark.parametrize("text,defaults,rules", [
    (None, {"default": "unknown"}, []), ("{broken", {"default": "unknown"}, []), ("[1]", {"default": "unknown"}, []), ("{}", {}, []), ('{"city_defaults": 3, "component_rules": {}}', {"default": "unknown"}, []),
    ('{"city_defaults": {"x": "r1"}, "component_rules": [{"a": 1}, 2]}', {"x": "r1"}, [{"a": 1}, 2]),
])
def test_district_rules(spark, tmp_path, text, defaults, rules):
    path = put(tmp_path, "rules.json", text) if text is not None else str(tmp_path / "none.json")
    (row,) = S.read_district_rules(spark, path).collect()
    assert row.city_defaults == defaults and [json.loads(x) for x in row.component_rules] == rules


def test_map_services(spark, tmp_path):
    path = put(tmp_path, "gis.json", {"jurisdictions": {"a-va": {"url": "u", "n": 1}, "b-va": {}}})
    assert {r.jurisdiction_id: json.loads(r.config) for r in S.read_map_services(spark, path).collect()} == {"a-va": {"url": "u", "n": 1}, "b-va": {}}
    for other in (put(tmp_path, "broken.json", "{"), put(tmp_path, "list.json", "[]"), str(tmp_path / "none.json")):
        assert S.read_map_services(spark, other).collect() == []
