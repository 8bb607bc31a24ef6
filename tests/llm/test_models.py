import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from quarry.llm import language_id as L
from quarry.llm import license_scan as C
from quarry.llm import quality as Q

SYLLABLES = {"en": ["the", "ing", "er", "and", "th"], "fr": ["é", "eau", "le", "ment", "oi"], "de": ["sch", "ung", "ein", "ü", "der"]}
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.StringType()), T.StructField("lang_pred", T.IntegerType())])


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for i in range(400):
        lang = rng.choice(list(SYLLABLES))
        junk = i % 4 == 0
        text = " ".join([prose(rng, lang, 1)] * 40) + " ***" if junk else prose(rng, lang, rng.randint(20, 80))
        out.append((i, text, None if i % 50 == 3 else lang, "x", 0))
    return [*out, (900, None, "en", "x", 0), (901, "", "en", "x", 0), (902, "12 34 !", "fr", "x", 0), (902, "12 34 !", "fr", "x", 0), (None, "the ing", "en", "x", 0)]


def test_language(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    names, model = L.train(df)
    assert names == ["de", "en", "fr"]
    got = L.identify(df, names, model).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows if r[2] and r[0] is not None and r[0] < 900}
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 80 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(r.lang_pred == "und" and r.score == 0 and r.ambiguous for r in got if r.doc_id in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got)
    kept = L.keep_identified(df, names, model)
    assert kept.columns == df.columns and {900, 901, 902}.isdisjoint(r.doc_id for r in kept.collect()) and kept.count() >= 395
    none = L.train(df.where("lang is null"))
    assert none == ([], None) and {r.lang_pred for r in L.identify(df, *none).collect()} == {"und"}
    one, single = L.train(df.where("lang = 'fr'"))
    assert one == ["fr"] and {r.lang_pred for r in L.identify(df.where("doc_id < 9"), one, single).collect()} == {"fr"}
    assert L.identify(df.limit(0), names, model).count() == 0


def test_every_language_is_learned(spark):
    """More than 128 languages, the rarest with few rows, most of them without letters."""
    rows = [(i * 12 + j, chr(0x4E00 + i * 20) * 3 + chr(0x4E00 + i * 20 + j % 4) + " " + chr(0x4E01 + i * 20) * 2, f"l{i:03}") for i in range(150) for j in range(12 if i < 140 else 6)]
    rows += [(10000 + j, "12 34", "l149") for j in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, model = L.train(df)
    assert names == [f"l{i:03}" for i in range(150)]
    rare = [r for r in rows if r[2] >= "l140" and r[0] < 10000]
    assert sum(k == r[2] for k, r in zip(L.judge([r[1] for r in rare], names, model)[0], rare, strict=True)) / len(rare) > 0.95


def test_decode():
    rng = np.random.default_rng(0)
    model = {"code": L.codewords(20), "w": np.eye(44, dtype="f4"), "b": np.zeros(44, "f4"), "trust": rng.random(44).astype("f4")}
    x = rng.normal(size=(30, 44)).astype("f4")
    loss = (np.log1p(np.exp(-x[:, None, :] * model["code"][None])) * model["trust"]).sum(2)
    assert (L.decode(model, x)[0] == loss.argmin(1)).all()


def test_codewords():
    for n in (2, 3, 5, 6, 20):
        code = L.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2
        assert code.shape[0] == n and apart[~np.eye(n, dtype=bool)].min() >= max(1, code.shape[1] // 4)


def test_quality(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)] + [(1, 0, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(df, labels)
    got = Q.score(df, model).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in held) / len(held) > 0.97
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert Q.keep_good(df, model).columns == df.columns
    blank = Q.train(df, labels.limit(0))
    assert {r.score for r in Q.score(df, blank).collect()} == {0.5}
    assert Q.score(df.limit(0), model).count() == 0


def test_trees():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype("f8")
    model = Q.boost(np.concatenate([x, np.zeros((800, 1))], 1), y, trees=30, depth=3)
    p = Q.traverse(model, np.concatenate([x, np.zeros((800, 1))], 1))
    assert ((p >= 0.5) == y).mean() > 0.97
    for row, want in zip(x[:20], p[:20], strict=True):  # node by node
        total = model["start"]
        for t in range(30):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int([*row, 0][model["feature"][t, node]] > model["threshold"][t, node])
            total += model["value"][t, node - 7]
        assert 1 / (1 + np.exp(-total)) == pytest.approx(want)


@pytest.fixture(scope="module")
def licences(spark):
    rng = random.Random(3)
    return C.train(spark.createDataFrame([(i, prose(rng, rng.choice(list(SYLLABLES)), 30) + "\nmit dans le under the une") for i in range(200)], "doc_id long, text string"))


def scanned(spark, licences, texts, **options):
    df = spark.createDataFrame([(i, t, "z", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, license string, score int, parts int")
    return {r.doc_id: r for r in C.scan(df, *licences, **options).collect()}


def test_licenses(spark, licences):
    rng = random.Random(3)
    texts = [prose(rng, "en", 30) for _ in range(40)]
    texts[3] += "\nReleased under the MIT License."
    texts[5] = "x\n\nPermission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the \"Software\"),\nto deal in the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software\n\ny"
    texts[7] += "\nThis work is licensed under the GNU General Public License, version 3."
    texts[8] = texts[9] = None
    texts[10] = ""
    texts[11] = " ".join([prose(rng, "en", 5000)] * 40) + "\nAll rights reserved.\n" + prose(rng, "de", 5000)  # over 1 MB
    assert len(texts[11]) > 1_000_000
    found = scanned(spark, licences, texts)
    assert len(found) == 40
    assert [found[i].license for i in (3, 5, 7, 11)] == ["MIT", "MIT", "GPL", "reserved"] and found[3].score >= licences[1]
    assert {found[i].license for i in (0, 8, 9, 10)} == {"none"} and found[10].n_paragraphs == 0 == found[10].score
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert C.scan(empty, *licences).count() == 0
    assert C.scan(spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string"), *C.train(empty)).first().license == "MIT"


#: Notices that are training rows or names as they stand: no measure of anything but that they are found.
def test_keys_leave_out_what_lifts_no_family():
    """Words whose n-grams, all together, bring no family up to none are no keys; MIT is one only as it stands."""
    from collections import Counter
    from types import SimpleNamespace as Of

    vocabulary = ["is", "what is", "MIT", "is free"]
    weights = np.array([[0.0, 0.0, 0.0, 0.0], [1.0, 1.5, 5.0, 0.0], [-1.0, 0.0, 0.0, 4.5]])
    last = Of(coefficientMatrix=Of(toArray=lambda: weights), interceptVector=Of(toArray=lambda: np.array([4.0, 0.0, 0.5])))
    model = Of(stages=[Of(labels=["none", "MIT", "GPL"]), Of(vocabulary=vocabulary), last])
    assert C.keys_of(model, Counter({"is": 50, "what": 20})) == ["MIT", "free"]
    weights[1, 1] = 3.0  # "is" and "what is" together now lift MIT
    assert C.keys_of(model, Counter({"is": 50, "what": 20})) == ["MIT", "free", "what"]


def test_keys_in_texts(spark):
    df = spark.createDataFrame([("Er kam mit dem Auto",), ("Under MIT.",), ("Is FREE here",), ("is",)], "text string")
    assert [r[0] for r in df.select(C.has_key(df.text, ["MIT", "free"])).collect()] == [False, True, True, False]


TRAINED = [("GPL", "GPLv2+"), ("MIT", "Dieses Werk steht unter einer MIT-Lizenz."), ("GPL", "Este trabajo usa la licencia GPL"), ("MIT", "SPDX-License-Identifier: MIT"), ("BSD", "SPDX-License-Identifier: BSD-3-Clause"), ("Zlib", "zlib license")]
#: Notices in words of their own: test_notices_are_not_trained holds them against the training rows.
NOTICES = [
    ("GPL", "Distributed under GPL-3.0"), ("GPL", "GPL version 3 or any later version applies to this program"), ("MIT", "Ce dépôt est publié sous MIT"), ("GPL", "Diese Bibliothek ist GPL-lizenziert"), ("MIT", "Copyright 2019, MIT licensed"), ("BSD", "Uses the 3-clause BSD licence"),
    ("Zlib", "Covered by the zlib/libpng licence"), ("Apache", "Use of this source code is governed by the Apache 2 terms."), ("EPL", "Made available under the Eclipse Public License"),
    ("MIT", "This project is licensed under the terms of the MIT license."), ("MIT", "Project code may be reused under an MIT-style licence"), ("MIT", "Der Quelltext ist unter der MIT-Lizenz verfügbar."), ("Apache", "Everything in this repository is Apache-2.0 licensed"), ("Apache", "Le code est couvert par la licence Apache 2.0"), ("Apache", "All files are covered by the Apache License, Version 2.0"),
    ("GPL", "You can use it under the GNU General Public License, either version 2 or later."), ("GPL", "El programa se publica con la GNU General Public License"), ("LGPL", "The library is covered by the GNU Lesser General Public License"), ("LGPL", "Bibliothek unter LGPL-2.1"), ("AGPL", "The server is free software under the GNU Affero General Public License"), ("AGPL", "AGPL-3.0 applies"),
    ("BSD", "Use is governed by a BSD 3-Clause License that can be found in the LICENSE file."), ("BSD", "This is BSD licensed code"), ("MPL", "Subject to the Mozilla Public License"), ("MPL", "Files here are under MPL-2.0"), ("ISC", "Offered under the ISC license"), ("BSL", "Boost Software License applies"), ("EUPL", "Veröffentlicht gemäß EUPL-1.2"),
    ("CC-BY", "Texte disponible sous licence CC BY 4.0"), ("CC-BY-SA", "available under CC BY-SA 3.0 unported"), ("CC-BY-NC", "Fotos: CC BY-NC 4.0"), ("CC-BY-ND", "Images are CC BY-ND 4.0"), ("CC0", "dedicated under CC0 1.0 Universal"), ("reserved", "© 2020 ACME. All rights reserved."), ("reserved", "ACME GmbH 2019. Alle Rechte vorbehalten."), ("public-domain", "This file is in the public domain."),
]
PLAIN = ["Er kam mit dem Auto.", "MIT researchers were denied permission to enter.", "The isc meeting discussed licence fees.", "The licensed apache helicopter pilot slept.", "The public domain of the town is large.", "Cafe tables and chairs", "A boost for the union", "Die Lizenz zum Fischen ist teuer.", "Il marche sous la pluie", "Bajo el puente", "She has the right to reply.", "An eclipse of the moon"]


def test_notices_are_not_trained():
    plain = lambda t: re.sub(r"[^a-z0-9+]+", " ", t.lower().replace("licence", "license")).strip()
    trained = {plain(t) for _, t in C.templates()} | {plain(n) for names in C.NAMES.values() for n in names}
    assert [t for _, t in NOTICES if plain(t) in trained] == []
    assert all(plain(t) in trained for _, t in TRAINED)


def test_trained_notices(spark, licences):
    got = scanned(spark, licences, [t for _, t in TRAINED], contained=C.bound(spark))
    assert [got[i].license for i in range(len(TRAINED))] == [k for k, _ in TRAINED]


def test_notices_in_other_words(spark, licences):
    got = scanned(spark, licences, [t for _, t in NOTICES] + PLAIN, contained=C.bound(spark))
    right = sum(got[i].license == k for i, (k, _) in enumerate(NOTICES))
    told = sum(r.license not in ("none", "unknown") for r in got.values())
    assert right / len(NOTICES) >= 0.9 and right / told >= 0.95, [(k, t, got[i].license) for i, (k, t) in enumerate(NOTICES) if got[i].license != k]
    assert all(got[len(NOTICES) + i].license in ("none", "unknown") for i in range(len(PLAIN)))


def test_keys_equal_scoring_every_paragraph(spark, licences):
    model, threshold, keys = licences
    assert keys
    rng = random.Random(8)
    words = sorted({w for g in model.stages[1].vocabulary for w in g.split(" ")})
    texts = [t for _, t in NOTICES] + ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    assert scanned(spark, licences, texts) == scanned(spark, (model, threshold, None), texts)
