import hashlib

import numpy as np

from quarry.llm import vector_codes as vc


def brute(vectors, entries=256, rounds=4):
    """Every entry is measured, in Python's own whole numbers. vectors: (vec_id, floats) sorted by id -> ([(code, error)], entries)."""
    parts = [[[int(np.floor(1024 * float(c))) for c in v[p * (len(v) // 4) : (p + 1) * (len(v) // 4)]] for p in range(4)] for _, v in vectors]
    books = [[x[p] for x in parts[:entries]] for p in range(4)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((apart(x[p], e), i) for i, e in enumerate(books[p])) for p in range(4)] for x in parts]
    for _ in range(rounds):
        found = assign()
        for p in range(4):
            for i in range(len(books[p])):
                mine = [x[p] for x, f in zip(parts, found, strict=True) if f[p][1] == i]
                if mine:
                    books[p][i] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return [("".join(f"{f[p][1]:02x}" for p in range(4)), sum(f[p][0] for p in range(4))) for f in assign()], books


def rows(n=90, d=8, seed=0, scale=0.3):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, d)) * scale).astype("f4")
    x[20:40] = x[3]  # copies, and so ties between entries
    return [(i, x[i].tolist(), None if i % 7 == 0 else i % 3) for i in range(n)]


def check(spark, data, entries=16, extra=()):
    df = spark.createDataFrame([(i, v, c, "x") for i, v, c in [*data, *extra]], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    got = {r.vec_id: r for r in vc.compress(df, entries=entries).collect()}
    want, books = brute([(i, v) for i, v, _ in data], entries)
    assert {i: (r.code, r.error) for i, r in got.items()} == {i: w for (i, _, _), w in zip(data, want, strict=True)}
    sums = {}
    for (_, _, label), (_, error) in zip(data, want, strict=True):
        sums[label] = sums.get(label, 0) + error
    assert all(got[i].label_error == sums[label] for i, _, label in data)
    flat = ",".join(str(c) for b in books for e in b for c in e)
    assert {r.codebooks_sha256 for r in got.values()} == {hashlib.sha256(flat.encode()).hexdigest()}
    return books


def test_equals_brute(spark):
    odd = [(1000, None, 1), (1001, [float("nan")] + [0.0] * 7, 1), (1002, [None] + [0.0] * 7, 1), (1003, [float("inf")] * 8, 1), (1004, [1.0] * 9, 1)]
    check(spark, rows(), extra=odd)
    check(spark, rows(n=10), entries=16)  # fewer rows than entries
    check(spark, rows(scale=0.0))  # zero vectors take part, all entries tie


def test_large_components(spark):
    """Beyond what doubles tell apart whole numbers are used; beyond the limit components are held to it."""
    data = rows(scale=4000.0)
    check(spark, data)
    df = spark.createDataFrame([(i, [3e38, -3e38, 1.0, 1.0], 1) for i in range(50)], "vec_id long, embedding array<float>, label int")
    got = vc.compress(df).collect()
    assert len(got) == 50 and {(r.error, r.label_error) for r in got} == {(0, 0)}


def test_only_the_annulus_is_measured():
    """Entries of very different norms: few are measured, and the nearest are found, ties to the lower index."""
    rng = np.random.default_rng(5)
    entries = (rng.standard_normal((256, 16)) * np.exp(rng.uniform(0, 6, (256, 1))) * 50).astype("i8")
    entries[200] = entries[7]
    x = (entries[rng.integers(0, 256, 2000)] + rng.integers(-9, 10, (2000, 16))).astype("i8")
    book = vc.Codebook(entries)
    index, apart = book.nearest(x)
    every = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (index == every.argmin(1)).all() and (apart == every.min(1)).all()
    assert book.measured < 0.6 * x.shape[0] * 256


def test_round_trip_and_odd_tables(spark):
    data = rows(n=60)
    df = spark.createDataFrame([(i, v) for i, v, _ in data], "vec_id long, embedding array<float>")
    kept, width = vc.usable(df, "vec_id", "embedding", None)
    books = vc.train(kept, width, entries=64)
    codes = vc.encode(kept, books, width)
    near = {r.vec_id: np.array(r.decoded) for r in vc.decode(codes, books).collect()}
    error = {r.vec_id: r.error for r in codes.collect()}
    for i, v, _ in data:
        whole = np.floor(np.array(v, "f4").astype("f8") * 1024)
        assert error[i] == int(((whole - near[i] * 1024) ** 2).sum())
    assert vc.compress(df.limit(0), label_col=None).count() == 0
    twice = vc.compress(df.unionAll(df), label_col=None)
    assert twice.count() == 120 and twice.distinct().count() == 60
    five = spark.createDataFrame([(None, [1.0, 2.0, 3.0, 4.0, 5.0]), (1, [0.0] * 5)], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id or 0, r.code, r.error) for r in vc.compress(five, label_col=None).collect()) == [(0, "01010100", 0), (1, "00000000", 0)]
