import random
import re

import pytest

from quarry.llm import decontamination as dc

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for a in range(max(len(w) - width, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + width]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    ids |= windows[tuple(w[a : a + n])]
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def corpus(seed=3):
    rnd = random.Random(seed)
    vocabulary = ["aa", "ab", "aab", "b", "Été", "x1", "ß", "日本", "a" * 40]
    text = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", ", ", "\n", "—x ", " . "]) for _ in range(n))
    items = [(i, text(rnd.randint(8, 30))) for i in range(40)] + [(50, "Two words"), (51, None), (52, "..."), (None, text(12)), (53, "z " * 30)]
    items += [(100 + i, items[0][1]) for i in range(20)]
    docs = []
    for i in range(150):
        piece = rnd.choice(items)[1] or ""
        at = rnd.randint(0, 10)
        docs.append((i, rnd.choice([text(rnd.randint(0, 60)), text(9) + piece.upper() + text(5), piece[at:], (piece + " ") * 3])))
    docs += [(900, None), (901, ""), (902, " .. "), docs[3], (None, items[0][1]), (903, "q " * 100_000 + items[1][1] + " q" * 100_000), (904, "z " * 31), (905, "two   WORDS; two")]
    return docs, items


@pytest.fixture(scope="module")
def both(spark):
    docs, items = corpus()
    return docs, items, spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_words int").repartition(4), spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("most", [4_000_000, 3_000])
def test_equals_brute(both, most):
    docs, items, d, b = both
    got = dc.scan(d, b, most=most).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got], key=str) == brute(docs, items)
    by_id = dict(docs)
    for r in got:
        # Offsets of the original: the spans' words are the words that are hit.
        spans = [by_id[r.doc_id][s.start : s.end] for s in r.spans]
        assert sum(len(words(s)) for s in spans) == r.n_hit
        assert all(re.fullmatch(WORD + r"(?s:.*)", s[0].lower()) and re.fullmatch(WORD, s[-1].lower()) for s in spans)


def test_spans_are_the_passages(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda."
    text = "Vorspann — é! ALPHA  Beta gamma\ndelta (epsilon) zeta eta theta iota kappa LAMBDA; und Schluss"
    got = dc.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).first()
    assert (got.n_hit, got["items"], [text[s.start : s.end] for s in got.spans]) == (11, ["5"], ["ALPHA  Beta gamma\ndelta (epsilon) zeta eta theta iota kappa LAMBDA"])


def test_keep_clean(both):
    docs, items, d, b = both
    dirty = {r[0] for r in brute(docs, items) if r[2]}
    for most in (4_000_000, 3_000):
        kept = dc.keep_clean(d, b, most=most)
        assert kept.columns == d.columns
        assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _ in docs if i not in dirty), key=str)


def test_empty_tables(both):
    docs, items, d, b = both
    assert dc.scan(d.limit(0), b).count() == 0
    assert {(r.n_hit, len(r["items"]), len(r.spans)) for r in dc.scan(d, b.limit(0)).collect()} == {(0, 0, 0)}
    assert dc.keep_clean(d, b.limit(0)).count() == len(docs)
