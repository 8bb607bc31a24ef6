"""Licence scans: a trained paragraph classifier, confirmed against templates.

Lines and blocks between blank lines are paragraphs. A sparse (L1) logistic regression over word 1- to 3-grams, trained
on licence notices in four languages and on other text, names a family for each, or none; it is in question if the
guess isn't none. A family holds if its probability is above a threshold calibrated on notices kept from training, and
if the paragraph holds one of the family's names where a licence is named, or enough of the 3-grams of one of its
passages. Other paragraphs in question are unknown. All of it is DataFrame and ML-pipeline work inside the JVM.

Paragraphs that the model can't guess a family for aren't scored one by one: one without any of the model's keys (a
word of each n-gram that speaks for a family, but those common words whose n-grams all together can't make any family
likelier than none) stays none.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, settle, table, unit_hash

# Names and passages of licence families, as their publishers word them.
NAMES = {
    "MIT": ("MIT License", "MIT licence", "MIT", "Expat License"),
    "Apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache Software License"),
    "BSD": ("BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "BSD License", "New BSD License"),
    "GPL": ("GNU General Public License, version 3", "GNU General Public License version 2", "GNU GPL v3", "GPL-3.0-or-later", "GPL-2.0", "GPLv2+", "GPLv3", "GPL"),
    "LGPL": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License version 2.1", "LGPL-2.1", "LGPL-3.0", "LGPLv3", "LGPL"),
    "AGPL": ("GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3", "AGPL"),
    "MPL": ("Mozilla Public License, version 2.0", "MPL-2.0", "MPL"),
    "EPL": ("Eclipse Public License, version 2.0", "EPL-2.0", "EPL-1.0"),
    "EUPL": ("European Union Public Licence 1.2", "EUPL-1.2", "EUPL"),
    "ISC": ("ISC License", "ISC"),
    "Zlib": ("zlib License", "Zlib"),
    "BSL": ("Boost Software License, Version 1.0", "BSL-1.0"),
    "WTFPL": ("Do What The Fuck You Want To Public License", "WTFPL"),
    "ODbL": ("Open Database License", "ODbL-1.0", "ODbL"),
    "CC-BY": ("CC BY 4.0", "CC BY 3.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA": ("CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC": ("CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND": ("CC BY-ND 4.0", "CC BY-ND 3.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC0": ("CC0 1.0", "CC0-1.0", "CC0", "CC0 1.0 Universal Public Domain Dedication"),
}
PASSAGES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "EPL": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License which is available at",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    "BSL": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",),
    "CC0": ("The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.", "This work is in the public domain.", "Released into the public domain.", "This code has been placed in the public domain.", "Dedicated to the public domain by its authors.", "Cette œuvre est dans le domaine public.", "Dieses Werk ist gemeinfrei.", "Esta obra es de dominio público.",
    ),
    "reserved": (
        "All rights reserved.", "Copyright (c) the authors. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.", "Tous droits réservés.", "Alle Rechte vorbehalten.", "Todos los derechos reservados.",
    ),
}
# Own wordings around the names.
FRAMES = (
    "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This software is distributed under the terms of the {}.", "SPDX-License-Identifier: {}", "Code is available under the {} license.", "License: {}", "Dual licensed: {}",
    "Ce logiciel est distribué sous licence {}.", "Sous licence {}.", "Publié sous les termes de la licence {}.", "Lizenziert unter der {}.", "Dieses Werk steht unter einer {}-Lizenz.", "Veröffentlicht unter {}.", "Lizenz: {}", "Publicado bajo la licencia {}.", "Este trabajo usa la licencia {}.", "Se distribuye con licencia {}.",
)
#: Own text with words of licences that licenses nothing.
OTHER = (
    "You need permission from the owner to enter the garden.", "He renewed his driving license last week.", "The licensed electrician checked the wiring.", "A fishing licence costs ten pounds.", "Copyright law is a difficult subject.",
    "The warranty covers parts and labour for two years.", "The court discussed the rights of the public.", "Her licence was suspended by the police.", "They were released under a general amnesty.", "The bar lost its license to sell beer.",
    "Redistribution of wealth was the topic of the debate.", "A warrant was issued on Monday.", "The apache helicopter landed.", "Permission was denied by the council.", "The public domain of the town is clean.", "Licence fees rose again this year.",
    "The museum reserved all seats.", "Terms of the contract were agreed.", "We distributed the software on disks.", "The mozilla browser opened the page.", "MIT students built a robot.", "The eclipse was seen in Europe.", "A boost in sales followed.", "The union signed the treaty.",
    "Er kam mit der Lizenz zum Angeln.", "Die Lizenz wurde ihm entzogen.", "Sie sprach mit dem Gericht über Rechte.", "Il a perdu sa licence de pêche.", "Le permis de conduire est sous la table.", "Les droits de douane ont été relevés.", "La licencia de conducir caducó.", "Estudió bajo la dirección de un maestro.", "Los derechos humanos son de todos.",
)
#: Lines of documents with these words are not taken as examples of other text.
TELLING = r"licen[cs]|lizenz|released under|distributed under|copyright|permission|public domain|domaine public|dominio público|gemeinfrei|redistribut|warrant|rights reserved|all rights|droits|rechte|derechos|cc0|cc by|creative commons|unauthorized|spdx|gpl|apache"
#: Between words, before a version's number, and at full stops that no digit follows.
_BETWEEN = r"[^\p{L}\p{N}.]+|\.+(?![0-9])|(?<=\p{L}\p{L})(?=v?[0-9])"
#: Words that stand before a licence's name, and articles between.
_BEFORE = "under|of|in|licen[cs]e[ds]?|licensing|lizenz|lizenziert|licencia|identifier|sous|unter|bajo|con|or|and|ou|oder|y"
_ARTICLES = "the|an?|la|le|les|der|die|das|dem|einer|einem|el|los|las|terms|either"


def _literal(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """A small table (family, text) as literals."""
    items = F.array(*[F.struct(F.lit(a).alias("family"), F.lit(b).alias("text")) for a, b in rows])
    return spark.range(1).select(F.inline(items))


def templates() -> list[tuple[str, str]]:
    return [*((k, f.format(n)) for k, names in NAMES.items() for n in names for f in FRAMES), *((k, p) for k, ps in PASSAGES.items() for p in ps)]


def name_words(name: str) -> list[str]:
    """A name in the words that _words makes, on the driver."""
    parts = re.split(r"[^\w.]+|\.+(?![0-9])|(?<=[^\W\d_]{2})(?=v?[0-9])", name)
    return [w if w == "MIT" else w.lower() for w in parts if w not in ("", "v")]


def name_pattern(family: str) -> str:
    """A pattern of a family's names in words joined by spaces, up to their version and without a last "license". A name of one word (MIT,
    GPL) must stand where a licence is named: behind such a word as "under" or SPDX's key, or before "license" or a version."""
    single, whole = set(), set()
    for name in NAMES.get(family, ()):
        words = name_words(name)
        at = next((i for i, w in enumerate(words) if i and re.fullmatch("version|[1-9][0-9.]*", w)), len(words))
        core = words[:at]
        while len(core) > 1 and core[-1] in ("license", "licence"):
            core.pop()
        (single if len(core) == 1 else whole).add(re.escape(" ".join(core)).replace(r"\ ", " "))
    more = "(?!(?:sa|nc|nd|sharealike|noncommercial|noderivatives) )" if family == "CC-BY" else ""
    some = [rf" (?:{'|'.join(sorted(whole))}) {more}"] if whole else []
    if single:
        one = f"(?:{'|'.join(sorted(single))})"
        some += [rf" (?:{_BEFORE})(?: (?:{_ARTICLES}))* {one} ", rf" {one}(?: (?:version|v|[0-9.]+|software|public|open|source|style))* (?:licen[cs]e[ds]?|lizenz|licencia) ", rf" {one} (?:version )?[1-9][0-9.]* "]
    return "|".join(some)


def _words(text: Column) -> Column:
    """Words in lower case, but MIT, which is a word of its own in German otherwise."""
    found = F.filter(F.split(text, _BETWEEN), lambda w: (w != "") & (w != "v"))
    return F.transform(found, lambda w: F.when(w == "MIT", w).otherwise(F.lower(w)))


def _grams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _featured(rows: DataFrame) -> DataFrame:
    """rows(text, ...) with words and grams. The words leave a generator, so that grams don't split the text again for each gram."""
    made = F.explode(F.array(F.struct(_words(F.col("text")).alias("words"))))
    w = rows.withColumn("__w", made).withColumn("words", F.col("__w.words")).drop("__w")
    return w.withColumn("grams", F.concat("words", _grams(F.col("words"), 2), _grams(F.col("words"), 3)))


def _variants(known: DataFrame) -> DataFrame:
    """known(family, text) with variant: 0 the whole text, others with words left out (not those in capitals, which names have)."""
    w = F.split("text", " ")
    gone = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.array_join(F.filter(w, lambda x, i: (k == 0) | ~x.rlike("^[a-z]") | (F.pmod(F.xxhash64(x, i, k), F.lit(7)) != 0)), " "))
    return known.select("family", F.posexplode(F.array_distinct(gone)).alias("variant", "text"))


def _kept() -> Column:
    return F.pmod(F.xxhash64("text"), F.lit(5)) == 0


def _passages(spark: SparkSession) -> DataFrame:
    """(family, wants): the 3-grams of each passage of a family; families without passages have none."""
    grams = F.array_distinct(_grams(_words(F.col("text")), 3))
    rows = [(k, p) for k in sorted({*NAMES, *PASSAGES}) for p in PASSAGES.get(k, ("",))]
    return _literal(spark, rows).select("family", F.when(F.size(grams) > 0, grams).alias("want")).groupBy("family").agg(F.collect_set("want").alias("wants"))


def _share() -> Column:
    """The largest share of a passage's 3-grams (wants) that a paragraph has (words)."""
    has = _grams(F.col("words"), 3)
    return F.coalesce(F.array_max(F.transform("wants", lambda t: F.size(F.array_intersect(has, t)) / F.size(t))), F.lit(0.0))


def bound(spark: SparkSession, *, kept: float = 0.95) -> float:
    """The share of a passage's 3-grams that at least `kept` of the altered passages kept from training have, but more than any text of OTHER has."""
    wants = _passages(spark)
    rows = _featured(_variants(_literal(spark, [(k, p) for k, ps in PASSAGES.items() for p in ps])).where(_kept() & (F.col("variant") > 0)))
    mine = sorted((r["s"] for r in rows.join(wants, "family").select(_share().alias("s")).collect()), reverse=True)
    least = mine[max(0, math.ceil(kept * len(mine)) - 1)] if mine else 0.8
    other = _featured(_literal(spark, [("none", x) for x in OTHER])).drop("family").crossJoin(wants).select(F.max(_share())).first()[0]  # both are small
    return max(least, other + 0.05)


def train(docs: DataFrame, *, text_col="text", others: int = 1000, precision: float = 0.95) -> tuple[PipelineModel, float, list[str] | None]:
    """(model, threshold, keys) from the templates whole and with words left out, from OTHER, and from a line each of about `others`
    documents, without words that tell of a licence. One variant in five is kept from training; the threshold is the least probability
    from which on at least `precision` of the kept rows have their own family. The features are n-grams of two training rows and of
    0.2% of the documents' lines at most. keys: see keys_of. An empty table gives a model from the written texts alone."""
    spark = docs.sparkSession
    known = _variants(_literal(spark, [*templates(), *(("none", x) for x in OTHER)]))
    n = max(1, docs.count())
    lines = F.split(text_col, "\n")
    prose = docs.where(F.col(text_col).isNotNull() & (unit_hash(F.xxhash64(text_col), seed=5) < others / n))
    prose = prose.select(F.lit("none").alias("family"), F.lit(-1).alias("variant"), F.element_at(lines, (F.pmod(F.xxhash64(text_col), F.size(lines)) + 1).cast("int")).alias("text"))
    prose = settle(prose.where(~F.lower("text").rlike(TELLING)))  # before the rows come together in one part
    rows = settle(_featured(known.unionAll(prose)).withColumn("kept", _kept()).repartition(1))  # a few thousand rows whatever the corpus
    fit = rows.where(~F.col("kept") | (F.col("variant") <= 0))
    counts = fit.select("variant", F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("variant") < 0).alias("other")).collect()
    most = 0.002 * max(500, fit.where("variant < 0").count())
    vocabulary = sorted(r["gram"] for r in counts if r["all"] > 1 and r["other"] <= most)
    features = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    features.setBinary(True)
    model = Pipeline(stages=[
        StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc"), features,
        LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=0.0005, maxIter=40),
    ]).fit(fit)
    test = predict(model, rows.where("kept and variant > 0")).select("family", "guess", "p").where("guess <> 'none'").collect()
    test.sort(key=lambda r: -r["p"])
    right, threshold = 0, 0.5
    for i, r in enumerate(test, 1):
        right += r["family"] == r["guess"]
        if right / i >= precision:
            threshold = r["p"]
    common = Counter({r["gram"]: r["other"] for r in counts if " " not in r["gram"]})
    return model, float(min(max(threshold, 0.3), 0.9)), keys_of(model, common)


def keys_of(model: PipelineModel, common: Counter) -> list[str] | None:
    """Words of which every paragraph has one that the model guesses a family for: of each n-gram with more weight for some family than
    for none, the word that is least common in other text. Words are left out, the most common first, as long as all n-grams of those
    left out, at once in a paragraph, bring no family up to none. None (every paragraph is to be scored) if other text isn't the
    likeliest without any n-gram."""
    labels, last = list(model.stages[0].labels), model.stages[-1]
    weights, start, none = last.coefficientMatrix.toArray(), last.interceptVector.toArray(), labels.index("none")
    others = [i for i in range(len(labels)) if i != none]
    ahead = start[none] - start[others]
    if not (ahead > 0).all():
        return None
    more = np.maximum(weights[others] - weights[none], 0.0)  # an n-gram counts once in a paragraph
    lift: dict[str, np.ndarray] = {}
    for i in np.flatnonzero(more.any(0)).tolist():
        word = min(model.stages[1].vocabulary[i].split(" "), key=lambda w: (common[w], w))
        lift[word] = lift.get(word, 0.0) + more[:, i]
    keys, left_out = [], np.zeros(len(others))
    for word in sorted(lift, key=lambda w: (-common[w], w)):
        if (left_out + lift[word] < ahead - 1e-6).all():
            left_out += lift[word]
        else:
            keys.append(word)
    return sorted(keys)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows(text, words, grams) with guess, the likeliest family, and p, its probability."""
    labels = model.stages[0].labels
    scored = PipelineModel(model.stages[1:]).transform(rows)
    p = vector_to_array("probability")
    best = F.array_max(F.transform(p, lambda x, i: F.struct(x.alias("p"), (-i).alias("i"))))
    names = F.array(*[F.lit(x) for x in labels])
    return scored.withColumn("__b", best).withColumn("guess", F.get(names, -F.col("__b.i"))).withColumn("p", F.col("__b.p")).drop("__b")


def paragraphs(text: Column) -> Column:
    """Lines, and blocks between blank lines, each once."""
    return F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, "\n[ \\t\\r]*\n")))


def has_key(text: Column, keys: list[str]) -> Column:
    """Whether a text has one of the keys as a word, in whatever case, or MIT as it stands, if that is a key."""
    low = [F.lit(k) for k in keys if k != "MIT"]
    found = F.arrays_overlap(F.split(F.lower(text), _BETWEEN), F.array(*low)) if low else F.lit(False)
    return text.contains("MIT") | found if "MIT" in keys else found


def scan(docs: DataFrame, model: PipelineModel, threshold: float, keys: list[str] | None = None, *, id_col="doc_id", text_col="text", contained: float = 0.8) -> DataFrame:
    """A row for each row of docs: doc_id, license, score, n_paragraphs, n_licensed.

    license: the family of the surest confirmed paragraph (ties: first by name); 'unknown' if there are paragraphs in question (guessed to
    be of some family) but none is confirmed; 'none' without any, as for null and empty texts. score: the probability of the confirmed
    family, else 0. n_paragraphs counts paragraphs in question, n_licensed the confirmed. Equal paragraphs of a text count once. Repeated
    rows and ids are scanned row by row; other columns, whatever their names, are ignored; an empty table gives no rows. Texts of any
    length are scanned whole: a row's lines and blocks are held at once, about twice its text. keys only spare work: see keys_of.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    parts, told = paragraphs(F.col("t")), F.col("t") != ""
    if keys is not None:
        parts, told = F.filter(parts, lambda x: has_key(x, keys)), has_key(F.col("t"), keys)
    rows = settle(rows.select("doc_id", F.when(told, parts).alias("parts"), F.monotonically_increasing_id().alias("row")))
    guessed = predict(model, _featured(rows.where(F.size("parts") > 0).select("row", F.explode("parts").alias("text")))).where("guess <> 'none'").select("row", "guess", "p", "words")
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    named = F.lit(False)
    for family in NAMES:
        named = named | ((F.col("guess") == family) & joined.rlike(name_pattern(family)))
    # A few passages for each family, all written down above.
    met = guessed.join(F.broadcast(_passages(spark)), F.col("guess") == F.col("family"), "left")
    met = met.withColumn("held", (F.col("p") >= threshold) & (named | (_share() >= contained)))
    best = met.groupBy("row").agg(F.count(F.lit(1)).alias("n_paragraphs"), F.count_if("held").alias("n_licensed"), F.min(F.when(F.col("held"), F.struct((-F.col("p")).alias("p"), "guess"))).alias("b"))
    out = rows.select("doc_id", "row").join(broadcast_if_small(settle(best)), "row", "left")
    found = F.coalesce(F.col("b.guess"), F.when(F.col("n_paragraphs") > 0, "unknown").otherwise("none"))
    zero = F.lit(0).cast("long")
    return out.select("doc_id", found.alias("license"), F.coalesce(-F.col("b.p"), F.lit(0.0)).alias("score"), F.coalesce("n_paragraphs", zero).alias("n_paragraphs"), F.coalesce("n_licensed", zero).alias("n_licensed"))


def op5_license_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scan(docs, *train(docs), contained=bound(spark))


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLE: dict[str, str] = {}
