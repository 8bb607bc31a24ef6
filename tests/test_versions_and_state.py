"""Versioned tables, the exactly-once log, index sync, and state that ends."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from quarry.operators.index_sync import sync_index
from quarry.sources.versions import Conflict, Versions
from quarry.streaming import event_log as L
from quarry.streaming import state as S


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k string, v long, created_at string")


def held(table, version=None):
    return sorted(tuple(r) for r in table.read(version).collect())


def test_merges_are_versions(spark, tmp_path):
    t = Versions(spark, f"{tmp_path}/t", buckets=4)
    with pytest.raises(ValueError):
        t.read()
    t.merge(rows(spark, *[(f"k{i}", i, "old") for i in range(40)], (None, 1, "old")), "k", batch="a")
    t.merge(rows(spark, ("k3", 300, "new"), ("x", 7, "new")), "k", keep=("created_at",), batch="b")
    first = sorted((f"k{i}", i, "old") for i in range(40))
    second = sorted([x for x in first if x[0] != "k3"] + [("k3", 300, "old"), ("x", 7, "new")])
    assert held(t, 0) == first and held(t) == second
    # A batch that runs again changes nothing, whatever it holds.
    assert t.merge(rows(spark, ("k3", -1, "again")), "k", batch="b") == 1 and held(t) == second
    t.remove(rows(spark, ("k3", 0, ""), ("nowhere", 0, "")), "k")
    assert held(t) == [x for x in second if x[0] != "k3"] and held(t, 1) == second
    last = t.log()[-1]
    assert len(last["add"]) <= 2 and len(last["drop"]) <= 2  # only the buckets of the two keys were written
    t.remove(t.read(), "k")
    assert held(t) == [] and t.read().columns == ["k", "v", "created_at"]
    assert [(r.version, r.parent) for r in t.history().orderBy("version").collect()] == [(0, None), (1, 0), (2, 1), (3, 2)]


def test_a_stop_between_files_and_entry_is_invisible(spark, tmp_path, monkeypatch):
    t = Versions(spark, f"{tmp_path}/t")
    t.append(rows(spark, ("a", 1, "x")), batch="1")

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(Versions, "_publish", stop)
        for write in (lambda: t.append(rows(spark, ("b", 2, "x")), batch="2"), lambda: t.replace(rows(spark))):
            with pytest.raises(RuntimeError):
                write()
    assert held(t) == [("a", 1, "x")]
    assert t.append(rows(spark, ("b", 2, "x")), batch="2") == 1 and held(t) == [("a", 1, "x"), ("b", 2, "x")]
    t.replace(rows(spark, ("c", 3, "y")))
    assert held(t) == [("c", 3, "y")] and held(t, 1) == [("a", 1, "x"), ("b", 2, "x")]


def test_of_two_writers_one_reads_again(spark, tmp_path):
    t = Versions(spark, f"{tmp_path}/t")
    t.merge(rows(spark, ("a", 1, "x")), "k")
    before = t.log()
    t.merge(rows(spark, ("b", 1, "x")), "k")
    other = Versions(spark, f"{tmp_path}/t")
    other.log = lambda: before  # has not seen the second version
    with pytest.raises(Conflict):
        other.merge(rows(spark, ("c", 1, "x")), "k")
    assert held(t) == [("a", 1, "x"), ("b", 1, "x")]
    with pytest.raises(ValueError):
        t.append(rows(spark, ("d", 1, "x")))  # a keyed table
    u = Versions(spark, f"{tmp_path}/u")
    u.append(rows(spark, ("a", 1, "x")))
    seen, real = [[]], u.log
    u.log = lambda: seen.pop() if seen else real()
    assert u.append(rows(spark, ("d", 1, "x"))) == 1  # appends go on behind the other's version
    assert {k for k, _, _ in held(u)} == {"a", "d"}


def event(i, day, hour=12, user=1, kind="view"):
    return (i, dt.datetime(2024, 1, day, hour), user, kind)


_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def feed(spark, folder, *batches):
    for b in batches:
        spark.createDataFrame(list(b), _EVENTS).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(_EVENTS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)


def test_log_holds_each_row_once(spark, tmp_path):
    source, log = f"{tmp_path}/in", Versions(spark, f"{tmp_path}/log")
    stream = feed(spark, source, [event(1, 1), event(2, 2)], [event(3, 5)])

    def stop(number):
        if number == 1:
            raise RuntimeError("killed behind the write")

    with pytest.raises(Exception, match="killed"):
        L.log_events(stream, log, f"{tmp_path}/c", then=stop).awaitTermination()
    assert sorted(r.event_id for r in log.read().collect()) == [1, 2, 3]
    real = Versions._publish
    try:
        Versions._publish = lambda *a: (_ for _ in ()).throw(RuntimeError("killed before the entry"))
        feed(spark, source, [event(4, 1), event(5, 5), (6, None, 1, "view")])
        with pytest.raises(Exception, match="killed"):
            L.log_events(stream, log, f"{tmp_path}/c").awaitTermination()
    finally:
        Versions._publish = real
    assert sorted(r.event_id for r in log.read().collect()) == [1, 2, 3]
    L.log_events(stream, log, f"{tmp_path}/c").awaitTermination()
    got = {r.event_id: r for r in log.read().collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and len(log.log()) == 3
    assert {i for i, r in got.items() if r.late} == {4}  # four days behind what earlier batches held
    assert got[4].day == dt.date(2024, 1, 1) and got[6].day is None
    assert [("late=true" in r[0]) for r in log.read().where("late").select(F.input_file_name()).collect()] == [True]


def embedded(chunks):
    return chunks.select("chunk_id", F.array(F.length("text_hash").cast("double"), F.lit(1.0)).alias("vector"))


def test_index_sync(spark, tmp_path):
    index = Versions(spark, f"{tmp_path}/points", buckets=4)
    chunks = spark.createDataFrame([(f"c{i}", f"h{i}", i) for i in range(30)], "chunk_id string, text_hash string, place long")
    one = sync_index(index, chunks, embedded, 2, "r1", batches=3).first()
    assert (one.embedded, one.pruned, one.held, one.missing, one.ready) == (30, 0, 30, 0, True)
    changed = chunks.where("place >= 5").withColumn("text_hash", F.when(F.col("place") == 9, "new").otherwise(F.col("text_hash")))
    calls = []

    def failing(due):
        calls.append(due.count())
        if len(calls) == 2:
            raise RuntimeError("no more")
        return embedded(due)

    with pytest.raises(RuntimeError):
        sync_index(index, changed, failing, 2, "r2", batches=3)
    two = sync_index(index, changed, embedded, 2, "r2", batches=3).first()
    assert (two.embedded, two.pruned, two.held, two.ready) == (1, 5, 25, True)
    n = len(index.log())
    again = sync_index(index, changed, lambda due: embedded(due), 2, "r2", batches=3).first()
    assert again == two and len(index.log()) == n
    with pytest.raises(ValueError):
        sync_index(index, changed.withColumn("text_hash", F.lit("z")), embedded, 3, "r3")
    assert index.read().where("text_hash = 'z'").count() == 0


def run(spark, frame, tmp_path):
    name = f"q{uuid.uuid4().hex}"
    S.use_rocksdb(spark)
    q = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return {r.event_id: r.admitted for r in spark.table(name).collect()}, [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def test_daily_state_ends(spark, tmp_path):
    days = [[event(10 * d + i, d, 1 + i, user=u, kind=k) for i, (u, k) in enumerate([(1, "view"), (1, "view"), (1, "view"), (2, "view"), (2, "click")])] for d in range(1, 6)]
    stream = feed(spark, f"{tmp_path}/in", *days)
    got, state = run(spark, S.daily_admission(stream, 2), tmp_path)
    assert got == {10 * d + i: i != 2 for d in range(1, 6) for i in range(5)}
    assert max(state[:2]) >= 3 and state[-1] <= state[0] * 2 + 1  # days that are over are gone, not five days' keys
    over = feed(spark, f"{tmp_path}/in", [event(999, 20, user=9)])
    got, state = run(spark, S.daily_admission(over, 2), tmp_path)
    assert got[999] and state[-1] <= 2  # one count and its timer


def test_throttle_state_ends(spark, tmp_path):
    at = lambda i, s, u: (i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), u, "x")
    first, second = [at(1, 0, 1), at(2, 30, 1), at(3, 60, 1), at(4, 0, 2)], [at(5, 61, 1), at(6, 91, 1), at(7, 120, 1)]
    stream = feed(spark, f"{tmp_path}/in", first, second, [at(8, 90_000, 3)])
    got, state = run(spark, S.throttled(stream, 2, 60), tmp_path)
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: False, 8: True}
    assert state[-1] <= 2  # the last user's time and timer alone


def test_admission_reads_its_state_once_a_part(spark, tmp_path):
    """400 keys of a day in two micro-batches, with and without a user: their state is a few values, not one a key, and every key counts on."""
    ids = iter(range(10_000))
    made = [[event(next(ids), 1, 1 + i % 3 + 4 * b, user=u if u else None, kind=k) for u in range(200) for k in ("view", "click") for i in range(2)] for b in range(2)]
    got, state = run(spark, S.daily_admission(feed(spark, f"{tmp_path}/in", *made), 3, parts=8), tmp_path)
    seen, want = {}, {}
    for e in sorted((e for batch in made for e in batch), key=lambda e: (e[1], e[0])):
        seen[e[2], e[3]] = seen.get((e[2], e[3]), 0) + 1
        want[e[0]] = seen[e[2], e[3]] <= 3
    assert got == want and max(state) <= 2 * 8
