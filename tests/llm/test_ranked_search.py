import math
import random
import re

import numpy as np

from quarry.llm import ranked_search as rs


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    own = [(i, words(t)) for i, t in docs]
    n, total = sum(bool(w) for _, w in own), sum(len(w) for _, w in own)
    held = {}
    for _, w in own:
        for t in set(w):
            held[t] = held.get(t, 0) + 1
    asked, out = {}, []
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    for i, ask in asked.items():
        scored = []
        for d, w in own:
            m = 100 - 50 + 50 * len(w) * n // total if w else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * (1000000000 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in ask if t in w)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(n=400, seed=1):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Straße", "été", "x9"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda most: rnd.choice([" ", ", ", "-"]).join(rnd.choices(vocabulary, weights, k=rnd.randint(1, most)))
    docs = [(i, text(80)) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(60)]  # copies: more than k ties
    docs += [(None, docs[6][1]), (9000, None), (9001, ""), (9002, " ,.- "), docs[7], (9003, "W1 " * 50_000 + "été")]
    items = [(i, text(20)) for i in range(30)] + [(100, docs[5][1]), (101, docs[5][1]), (102, None), (103, "?!"), (104, "nowhere else"), (None, "w1 w2"), (7, "w3 x9")]
    return docs, items


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(5)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    return sorted([tuple(r) for r in rs.search(d, q, **options).collect()], key=str)


def test_equals_brute(spark):
    docs, items = corpus()
    want = brute(docs, items, 50)
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, shard=40, postings=500, most_terms=60) == want
    assert run(spark, docs, items, k=3) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = corpus(20)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, docs, [(1, None), (2, "nowhere")]) == []


def test_documents_are_skipped():
    """Where a few rare terms decide, most documents with common terms are never scored, and the result is whole."""
    rng = np.random.default_rng(2)
    n, lists = 50_000, []
    for share, most in ((0.9, 40), (0.7, 60), (0.01, 4000), (0.005, 5000), (0.004, 6000)):
        docs = np.flatnonzero(rng.random(n) < share).astype("i4")
        adds = rng.integers(1, most, len(docs))
        lists.append((docs, adds, int(adds.max())))
    best, scores, scored = rs.wand(lists, n, 50)
    total = np.zeros(n, "i8")
    for docs, adds, _ in lists:
        total[docs] += adds
    order = np.lexsort((np.arange(n), -total))[:50]
    assert (best == order).all() and (scores == total[order]).all()
    assert scored < 0.1 * n
