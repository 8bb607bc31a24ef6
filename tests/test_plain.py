"""Names made unique, rules with conditions, counts of requests."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import filter_csv
from quarry.operators import relational as R
from quarry.operators import sequences as S


def plain_names(names):
    used, out = set(), []
    for x in names:
        y, k = x, 2
        while y in used:
            y, k = f"{x}-{k}", k + 1
        used.add(y)
        out.append(y)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_unique_names_equal_the_plain_loop(spark, seed):
    rng = random.Random(seed)
    names = ["a", "a", "a-2", *[rng.choice(["a", "a-2", "a-3", "a-2-2", "b", "b-02", "b-1", "c-9-9", "c", "", "-2", "d"]) for _ in range(120)]]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(names)] + [(999, None, "x")], "i long, name string, __n string").repartition(4)
    got = {r.i: r.unique for r in S.unique_names(df, "name", "i").collect()}
    assert got.pop(999) is None
    assert [got[i] for i in range(len(names))] == plain_names(names)
    assert plain_names(["a", "a", "a-2"]) == ["a", "a-2", "a-2-2"]
    assert S.unique_names(df.limit(0), "name", "i").count() == 0


def test_unique_names_where_a_join_turns_into_a_broadcast(spark):
    """Families stay whole where the join with them, planned as a shuffle, becomes a broadcast with a local read at run time."""
    names = [("a", "a-2", "b", "b-3")[i * 7 % 4] for i in range(4000)]
    df = spark.createDataFrame(list(enumerate(names)), "i long, name string").repartition(8)
    made = S.unique_names(df, "name", "i")
    got = {r.i: r.unique for r in made.collect()}
    assert [got[i] for i in range(len(names))] == plain_names(names)
    assert "REPARTITION_BY_COL" in made._jdf.queryExecution().executedPlan().toString()  # not left out for the join's own partitioning



def test_rules_with_all_conditions(spark):
    rules = [(2, None, None, "PARK", None, ["P"], []), (0, "", None, "", "", None, None), (1, "Art. II", "uses", "", "", ["R-1", " ", "R-2 "], ["dwelling"]), (3, "", "", "", "xii", None, ["shops"])]
    rows = [("a", "Parking", ["Code", "ART. II", "Div. 1 Uses"]), ("b", "Park rules", ["Code", "Art. V", None]), ("c", None, ["Code", "Chapter XII"]), ("d", "Nothing", None), ("e", "None", [])]
    q = spark.createDataFrame(rules, "pos int, article_contains string, division_contains string, title_contains string, contains string, districts array<string>, uses array<string>")
    got = R.classify(spark.createDataFrame(rows, "k string, title string, breadcrumb array<string>"), q, "k")
    assert {r.k: (r.districts, r.uses) for r in got.collect()} == {"a": (["R-1", "R-2"], ["dwelling"]), "b": (["P"], ["general"]), "c": (["unknown"], ["shops"]), "d": (["unknown"], ["general"]), "e": (["unknown"], ["general"])}
    assert {r.districts[0] for r in R.classify(spark.createDataFrame(rows, "k string, title string, breadcrumb array<string>"), q.limit(0), "k").collect()} == {"unknown"}
    with pytest.raises(ValueError):
        R.classify(spark.createDataFrame(rows, "k string, title string, breadcrumb array<string>"), q, "k", most=3)


def test_request_counts(spark):
    rows = [(1, "x", "n"), (2, "x", "m"), (3, None, "n"), (4, "", "n"), (5, None, None), (6, None, "")]
    got = R.request_counts(spark.createDataFrame(rows, "id long, place string, name string"), "id", "place", "name")
    assert {r.id: r.n for r in got.collect()} == {1: 2, 2: 2, 3: 3, 4: 3, 5: 6, 6: 6}


def test_filter_csv(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],), (None,), (["x"],)], "v array<string>")
    assert [r[0] for r in df.select(filter_csv(F.col("v"))).collect()] == [",a,b,", "", "", ",x,"]


def test_index_status(spark):
    s = spark.createDataFrame([("a", "h", "en"), ("b", "h2", None)], "source string, hash string, lang string")
    c = spark.createDataFrame([("a", "h"), ("a", "h"), ("b", "h2")], "source string, hash string")
    log = spark.createDataFrame([("source.import.completed", "2"), ("source.import.completed", "10"), ("other", "99")], "kind string, at string")
    v = spark.createDataFrame([(1,)], "id long")
    assert tuple(R.index_status(s, c, log, v).first()) == (2, 3, True, "2", None, 1, 1, True)
    assert R.index_status(s, c.where("source = 'a'"), log, v).first().index_ready is False
    assert tuple(R.index_status(s.limit(0), c.limit(0), log.limit(0), v.limit(0)).first()) == (0, 0, False, None, None, 0, 0, False)
