import numpy as np
import pytest

from quarry.llm import hamming, nearest


def table(spark, seed=0, d=20, n=600):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype("f4")
    x[50:80] = x[0]  # copies
    x[81] = -x[82]
    rows = [(i, x[i].tolist(), "c") for i in range(n)]
    odd = [(n, None), (n + 1, [0.0] * d), (n + 2, [float("nan")] + [1.0] * (d - 1)), (n + 3, [None] + [1.0] * (d - 1)), (n + 4, [1.0] * (d + 1)), (n + 5, [float("inf")] * d), (None, [1.0] * d)]
    rows += [(i, v, "c") for i, v in odd] + [rows[10], rows[100]]  # repeated rows
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)


def compare(got, queries, order):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(by) == set(queries)
    return {q: [v for _, v in sorted(by[q])] for q in by}


def test_hamming_equals_brute(spark):
    for d in (20, 70):
        x, df = table(spark, d=d)
        b = x > 0
        got = hamming.search(df, k=7, every=50).collect()
        queries = list(range(0, 600, 50))
        mine = compare(got, queries, "hamming")
        for q in queries:
            apart = (b != b[q]).sum(1)
            want = [i for i in np.lexsort((np.arange(600), apart)) if i != q][:7]
            assert mine[q] == want
        assert all(r.hamming == int((b[r.query_id] != b[r.vec_id]).sum()) for r in got)


def test_segments_cover_every_bit():
    for d in (1, 20, 64, 70, 200):
        for n in (1, 600, 10_000, 10**9):
            cut = hamming.segments(d, n)
            assert [b for a, size in cut for b in range(a, a + size)] == list(range(d))
            assert all(1 <= size <= 20 and a // 64 == (a + size - 1) // 64 for a, size in cut)


def test_clusters_end_early(spark, monkeypatch):
    """Where neighbours are near, few values are looked up before the k-th distance is covered."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 64))
    x = (base[np.arange(1200) % 60] * np.where(rng.random((1200, 64)) < 0.03, -1, 1)).astype("f4")
    rounds = []
    real = hamming._ring
    monkeypatch.setattr(hamming, "_ring", lambda bits, r: rounds.append(r) or real(bits, r))
    got = hamming.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), k=5, every=100).collect()
    b = x > 0
    for q in range(0, 1200, 100):
        apart = (b != b[q]).sum(1)
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [i for i in np.lexsort((np.arange(1200), apart)) if i != q][:5]
    assert max(rounds) <= 2


def test_nearest_finds_brute(spark):
    x, df = table(spark)
    x = x.astype("f8")
    got = nearest.search(df, k=7, every=50, shard=200, block=5).collect()
    queries, hit = list(range(0, 600, 50)), 0
    mine = compare(got, queries, "score")
    for q in queries:
        apart = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(600), apart)) if i != q][:7]
        hit += len(set(want) & set(mine[q]))
    assert hit / (7 * len(queries)) >= 0.97
    assert all(r.score == pytest.approx(np.sqrt(((x[r.query_id] - x[r.vec_id]) ** 2).sum()), abs=1e-12) for r in got)
    assert mine[0][:5] == [50, 51, 52, 53, 54]


def test_bounds_hold():
    """Packed codes and rounded queries: estimates lie near the true distances, bounds hold for nearly all pairs."""
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((3000, 64)), rng.standard_normal((20, 64))
    mean, turn = x.mean(0), nearest.rotation(64, 256)
    packed, length, own = nearest.encode(x, mean, turn)
    codes = packed.view("u8")
    told = nearest.rounded(q, mean, turn)
    inside = []
    for i in range(20):
        low, high = nearest.bounds(codes, np.bitwise_count(codes).sum(1), length, own, tuple(t[i] for t in told), 256, 2.3)
        true = ((x - q[i]) ** 2).sum(1)
        inside.append(((low <= true) & (true <= high)).mean())
        assert np.corrcoef((low + high) / 2, true)[0, 1] > 0.9
    assert np.mean(inside) > 0.97


def test_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, -2.0]), (100, [0.5, 0.1])], "vec_id long, embedding array<double>")
    for search in (hamming.search, nearest.search):
        assert sorted((r.query_id, r["rank"]) for r in search(df).collect()) == [(0, 1), (0, 2), (100, 1), (100, 2)]
        assert search(df.limit(0)).count() == 0
