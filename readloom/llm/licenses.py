"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a run of lines that hold a letter or digit; comment marks at the ends of its lines do not count. Its
lines, and the sentences and two sentences in a row that reach over a line's end, are classified if they have a licence
cue; cues are derived so that no text that a template could confirm lacks one. The classifier is a multinomial
logistic regression on the presence of one to three words in a row, made sparse by an L1 penalty. It knows one
class for each licence family and the class `unknown` for cues that name none. It is trained on the driver on
labelled paragraphs (a bounded set; by default generated from the templates below). The temperature is fitted on
predictions of wordings that training did not see: whole templates are held out in turn. The least confidence
is chosen on other paragraphs held out; less confident predictions are `unknown`. A family counts as confirmed when one of its templates is contained in the paragraph, by the share
of its word bigrams. Everything over the corpus is Spark SQL on arrays within a row: no shuffle.

Defined cases: null and empty texts have no paragraph; very long texts are scanned whole; a null doc_id passes through; repeated rows are each
reported; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UNKNOWN, SEED, CONTAINED, PRECISION, FOLDS = "unknown", 11, 0.6, 0.99, 5
CUE = r"(?i)licen[cs]|copyright|copyleft|creative commons|public domain|all rights reserved|spdx|unlicense|warrant(y|ies)|redistribut|\(c\)\s*[0-9]{4}|©|\bcc[ -](by|0|zero)|\b(a|l)?gpl|gnu "
MARK, BREAK = "\x01", r"[\s*#/;-]+"
EDGES = r"^(?i:[^\p{L}\p{N}(©]|(rem|dnl)\b)+|[\s*#/|;-]+$"
# The names and usual notices of each family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl-3.0": [
        "licensed under the GNU General Public License, version 3",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0",
    ],
    "gpl-2.0": [
        "licensed under the GNU General Public License, version 2",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0",
    ],
    "lgpl": [
        "licensed under the GNU Lesser General Public License",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1",
    ],
    "agpl-3.0": [
        "licensed under the GNU Affero General Public License",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0",
    ],
    "bsd": [
        "Licensed under the BSD License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "isc": [
        "Licensed under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ],
    "cc-by": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc0": ["Released under CC0 1.0 Universal", "the author has waived all copyright and related rights and dedicated the work to the public domain", "SPDX-License-Identifier: CC0-1.0"],
    "proprietary": ["All rights reserved", "This software is proprietary and confidential. Unauthorized copying is strictly prohibited"],
}
# Sentences with a cue that name no family, and words to put around notices.
NO_FAMILY = [
    "She renewed her driver's license last week", "The license plate was found near the road", "a licensed electrician must do this work",
    "The warranty covers parts for two years", "copyright law is taught in the second term", "see the license agreement for details",
    "Licensed under the {} License", "Released under the {} License, version 3", "SPDX-License-Identifier: {}", "Licensed under the {} Public License, Version 2.0",
    "This work is licensed under the terms of {}", "the show was licensed in Canada", "goods are redistributed to the poor", "a gnu grazes on the plain",
    "Copyright (c) 2019 {}", "the book fell into the public domain in 1950", "ask the vendor for a license key", "fishing license fees rose again",
]
CARRIERS = ["{}", "{}.", "This work is {}.", "The code in this repository is {}", "{} by the authors", "# {}", "* {} *", "Note: {}. See the file LICENSE.", "Copyright (c) 2020 {name}. {}", "{}, unless stated otherwise"]
NAMES = "Orbit Lumen Harbor Quartz Meadow Falcon Nimbus Cedar Willow Aspen Granite Summit Juniper Coral".split()


def terms(text: Column) -> Column:
    """Words of a paragraph: small letters and digits, with points inside (2.0)."""
    low = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.]+", " ")
    return F.array_remove(F.split(F.regexp_replace(low, r"\.(?=\s|$)|(?<=\s|^)\.", ""), " "), "")


def cue(paragraphs: list[str]) -> str:
    """CUE, and of each notice so many pairs of words that a text with CONTAINED of its pairs has a cue."""
    gap, pairs = r"[^\p{L}\p{N}.]+", []

    def words(text: str) -> list[str]:
        return [w for w in (x.strip(".") for x in re.split(r"[^\w.]+|_", text.lower())) if w]

    def needed(text: str) -> None:
        own = words(text)
        grams = list(dict.fromkeys(zip(own, own[1:], strict=False)))
        plain = sorted((g for g in grams if not re.search(CUE, " ".join(g) + " ") and g not in pairs), key=lambda g: (-len(g[0]) - len(g[1]), g))
        spare = math.ceil(CONTAINED * len(grams)) - 1  # so many pairs without a cue confirm nothing
        pairs.extend(plain[: max(0, len(plain) - spare)])

    for templates in TEMPLATES.values():
        for text in templates:
            needed(text)
    for text in paragraphs:  # of other training sets
        own = words(text)
        if not re.search(CUE, text) and not set(zip(own, own[1:], strict=False)) & set(pairs):
            needed(text)
    after: dict[str, list[str]] = {}
    for one, two in pairs:
        after.setdefault(re.escape(one), []).append(re.escape(two))
    known = "|".join(f"{one}{gap}(?:{'|'.join(others)})" for one, others in after.items())
    return re.sub(r"\[ -\]| ", lambda _: BREAK, CUE) + rf"|\b(?:{known})\b"


def _grams(words: Column, n: int) -> Column:
    size = F.size(words)
    spans = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))
    return F.when(size >= n, spans).otherwise(F.array().cast("array<string>"))


def grams(words: Column) -> Column:
    return F.array_distinct(F.concat(words, _grams(words, 2), _grams(words, 3)))


def labelled_paragraphs(seed: int = SEED) -> list[tuple[str, str, int]]:
    """Generated paragraphs with their family and the number of their wording: the default training set."""
    rng = np.random.default_rng(seed)
    pick = lambda items: items[int(rng.integers(len(items)))]
    out, wording = [], 0
    for family, templates in TEMPLATES.items():
        for template in templates:
            wording += 1
            for carrier in CARRIERS:
                words = template.split()
                if len(words) > 8 and rng.random() < 0.5:  # a longer notice may lose a word
                    words.pop(int(rng.integers(len(words))))
                out.append((carrier.replace("{name}", pick(NAMES)).replace("{}", " ".join(words)), family, wording))
    for text in NO_FAMILY:
        wording += 1
        out += [(carrier.replace("{name}", pick(NAMES)).replace("{}", text.replace("{}", pick(NAMES))), UNKNOWN, wording) for carrier in CARRIERS for _ in range(2)]
    return out


@dataclass
class Model:
    families: list[str]
    weights: dict[str, list[float]]  # of the n-grams with any weight
    bias: list[float]
    temperature: float
    least: float
    cue: str = ""


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _regression(x: np.ndarray, y: np.ndarray, classes: int, l1: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by proximal gradient descent."""
    used = np.flatnonzero(x.any(axis=0))
    part, truth = x[:, used], np.eye(classes, dtype=np.float32)[y]
    w, b, rate = np.zeros((len(used), classes), dtype=np.float32), np.zeros(classes, dtype=np.float32), np.float32(0.5)
    for _ in range(steps):
        error = (_softmax(part @ w + b) - truth) / np.float32(len(part))
        w -= rate * (part.T @ error)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * np.float32(l1), 0)
        b -= rate * error.sum(axis=0)
    out = np.zeros((x.shape[1], classes))
    out[used] = w.astype(np.float64).round(6)
    return out, b.astype(np.float64).round(6)


def fit(examples: list[tuple[list[str], str, int]], seed: int = SEED, l1: float = 2e-4, steps: int = 400) -> Model:
    """Of (n-grams, family, wording): the temperature from wordings held out in turn, the least confidence from
    every fourth example, the weights from the others."""
    rng = np.random.default_rng(seed)
    families = sorted({y for _, y, _ in examples})
    vocabulary = {g: i for i, g in enumerate(sorted({g for x, *_ in examples for g in x}))}
    x, y = np.zeros((len(examples), len(vocabulary)), dtype=np.float32), np.array([families.index(f) for _, f, _ in examples])
    for i, (gs, *_rest) in enumerate(examples):
        x[i, [vocabulary[g] for g in gs]] = 1
    wordings, number = np.unique([k for *_, k in examples], return_inverse=True)
    fold, s = rng.permutation(len(wordings))[number] % FOLDS, np.zeros((len(y), len(families)))
    for k in range(FOLDS):
        if (fold == k).any() and (fold != k).any():
            w, b = _regression(x[fold != k], y[fold != k], len(families), l1, steps)
            s[fold == k] = x[fold == k] @ w + b
    heats = np.exp(np.linspace(-2, 2, 81))
    heat = float(min(heats, key=lambda t: -np.log(_softmax(s / t)[np.arange(len(y)), y] + 1e-12).mean()))
    held = np.zeros(len(y), dtype=bool)
    held[rng.permutation(len(y))[::4]] = True
    w, b = _regression(x[~held], y[~held], len(families), l1, steps)
    p = _softmax((x[held] @ w + b) / heat)
    best, unknown = p.argmax(axis=1), families.index(UNKNOWN)
    for cut in np.linspace(0.25, 0.95, 71):
        taken = (best != unknown) & (p.max(axis=1) >= cut)
        least = float(round(cut, 4))
        if not taken.any() or (best[taken] == y[held][taken]).mean() >= PRECISION:
            break
    kept = {g: w[i].tolist() for g, i in vocabulary.items() if w[i].any()}
    return Model(families, kept, b.tolist(), round(heat, 6), least)


@cache
def _model(app: str, paragraphs: tuple) -> Model:
    spark = SparkSession.active()
    data = spark.createDataFrame([(i, *row) for i, row in enumerate(paragraphs)], "i int, text string, family string, wording int")
    rows = data.select("i", "family", "wording", grams(terms(F.col("text"))).alias("g")).orderBy("i").collect()
    m = fit([(list(r.g), r.family, r.wording) for r in rows])
    m.cue = cue([t for t, y, _ in paragraphs if y != UNKNOWN])
    return m


def model(spark: SparkSession, paragraphs: list[tuple[str, str, int]] | None = None) -> Model:
    """paragraphs: (text, family, number of the wording; equal for those that differ in what is around it alone)."""
    return _model(spark.sparkContext.applicationId, tuple(paragraphs or labelled_paragraphs()))


def _constant(value: object, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), schema)


def _bind(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _judge(m: Model):
    """A function from the column of a paragraph to struct<family, probability, similarity, confirmed>."""
    weights = _constant(m.weights, "map<string,array<double>>")
    templates = _constant([{"family": f, "text": t} for f, ts in TEMPLATES.items() for t in ts], "array<struct<family:string,text:string>>")
    own = F.transform(templates, lambda t: F.struct(t.family.alias("family"), F.array_distinct(_grams(terms(t.text), 2)).alias("g")))

    def logits(known: Column) -> Column:
        total = F.aggregate(known, F.array(*[F.lit(x) for x in m.bias]), lambda a, g: F.zip_with(a, F.element_at(weights, g), lambda u, v: u + v))
        return F.transform(total, lambda x: x / m.temperature)

    def probabilities(s: Column) -> Column:
        return _bind(F.transform(s, lambda x: F.exp(x - F.array_max(s))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))

    def best(p: Column) -> Column:
        top = F.array_max(p)
        family = F.get(F.array(*[F.lit(f) for f in m.families]), F.array_position(p, top).cast("int") - 1)
        return F.struct(F.when(top >= m.least, family).otherwise(F.lit(UNKNOWN)).alias("family"), top.alias("probability"))

    def likeness(words: Column, family: Column) -> Column:
        similar = _bind(F.array_distinct(_grams(words, 2)), lambda g: F.array_max(F.transform(F.filter(own, lambda t: t.family == family), lambda t: F.size(F.array_intersect(t.g, g)) / F.size(t.g))))
        return F.round(F.coalesce(similar, F.lit(0.0)), 6)

    def described(words: Column) -> Column:
        found = _bind(_bind(logits(F.array_intersect(grams(words), F.map_keys(weights))), probabilities), best)
        return _bind(found, lambda b: _bind(likeness(words, b.family), lambda like: F.struct(
            b.family.alias("family"), F.round(b.probability, 6).alias("probability"), like.alias("similarity"),
            ((b.family != UNKNOWN) & (like >= CONTAINED)).alias("confirmed"))))

    return lambda paragraph: _bind(terms(paragraph), described)


def classify(paragraphs: DataFrame, m: Model) -> DataFrame:
    """Adds family, probability, similarity and confirmed to rows with a column paragraph."""
    rows = paragraphs.withColumn("_best", _judge(m)(F.col("paragraph")))
    return rows.withColumns({k: F.col(f"_best.{k}") for k in ("family", "probability", "similarity", "confirmed")}).drop("_best")


def _paragraphs(text: Column) -> Column:
    """array<string>: paragraphs as lines `number`, MARK, line; comment marks at the ends of lines are left out."""
    bare = lambda x: F.regexp_replace(x, EDGES, "")
    lines = F.transform(F.split(text, "\r?\n|\r"), lambda x, i: F.when(x.rlike(r"[\p{L}\p{N}]"), F.concat(i.cast("string"), F.lit(MARK), bare(x))).otherwise(F.lit("")))
    return F.split(F.array_join(lines, "\n"), "\n\n+")


def _units(paragraph: Column, cues: str) -> Column:
    """array<struct<no, wide, text>> of the cued lines of a paragraph and, of the joined lines, of the cued sentences
    and two sentences in a row that reach over a line's end."""
    lines = F.filter(F.split(paragraph, "\n"), lambda x: x != "")
    unit = lambda no, wide, text: F.struct(no.cast("int").alias("no"), F.lit(wide).alias("wide"), text.alias("text"))
    text = lambda x: F.regexp_replace(x, f"^[0-9]+{MARK}", "")

    def units(own: Column) -> Column:
        first = F.substring_index(F.get(own, F.lit(0)), MARK, 1)
        single = F.transform(own, lambda x: unit(F.substring_index(x, MARK, 1), False, text(x)))
        sentences = F.split(F.array_join(F.transform(own, text), "\n"), r"(?<=[.!?])(?=\s+\p{Lu})")
        joined = _bind(sentences, lambda s: F.concat(s, F.transform(F.slice(s, 2, F.size(s)), lambda x, i: F.concat(F.get(s, i), x))))
        across = F.filter(F.transform(joined, lambda x: F.regexp_replace(x, r"^\s+", "")), lambda x: F.contains(x, F.lit("\n")))
        wide = F.transform(across, lambda x: unit(first, True, F.translate(x, "\n", " ")))
        return F.filter(F.when(F.size(own) > 1, F.concat(single, wide)).otherwise(single), lambda u: u.text.rlike(cues))

    return _bind(lines, units)


def _told(found: Column) -> Column:
    """What a paragraph says: its cued lines, but for those that a longer text around them confirms better as another
    family, and each family that only its joined lines confirm; else one unknown with a cue of its own."""

    def told(own: Column) -> Column:
        sure = F.filter(own, lambda u: u.confirmed)
        wide = F.array_distinct(F.transform(F.filter(sure, lambda u: u.wide), lambda u: F.struct(u.text.alias("text"), u.family.alias("family"), u.similarity.alias("similarity"))))
        return _bind(F.struct(sure.alias("sure"), wide.alias("wide")), lambda w: kept(own, w))

    def kept(own: Column, w: Column) -> Column:
        overruled = lambda u: F.exists(w.wide, lambda x: (x.family != u.family) & (x.similarity > u.similarity) & F.contains(x.text, u.text))
        lines = F.filter(own, lambda u: ~u.wide & (u.cued | (u.family != UNKNOWN)) & ~(u.confirmed & overruled(u)))
        left = F.filter(w.sure, lambda u: ~overruled(u))
        return _bind(left, lambda s: _bind(F.transform(s, lambda u: u.family), lambda names: F.concat(lines, F.filter(s, lambda u, i: u.wide & (F.array_position(names, u.family) == i + 1)))))

    return _bind(_bind(found, told), lambda rows: F.when(F.size(rows) > 0, rows).otherwise(F.slice(F.filter(found, lambda u: u.cued), 1, 1)))


def scan(docs: DataFrame, m: Model | None = None) -> DataFrame:
    """One row a line with a licence cue, and one for each family that only the joined lines of a paragraph confirm:
    doc_id, paragraph_no (number of the line, or of the paragraph's first), family, probability, similarity,
    confirmed, and license: the family if confirmed, else `unknown`."""
    m = m or model(docs.sparkSession)
    cues, judge = m.cue or cue([]), _judge(m)
    rows = docs.select("doc_id", "text").where(F.col("text").rlike(cues.replace(BREAK, r"[\s\p{P}\p{S}]+")))
    units = rows.select("doc_id", F.explode(_paragraphs(F.col("text"))).alias("_p")).select("doc_id", _units(F.col("_p"), cues).alias("_u")).where(F.size("_u") > 0)
    judged = F.transform("_u", lambda u: _bind(judge(u.text), lambda b: F.struct(
        u.no.alias("paragraph_no"), u.wide.alias("wide"), u.text.alias("text"), u.text.rlike(CUE).alias("cued"), b.family.alias("family"), b.probability.alias("probability"), b.similarity.alias("similarity"), b.confirmed.alias("confirmed"))))
    found = units.select("doc_id", F.explode(_told(judged)).alias("_x")).select("doc_id", *[f"_x.{k}" for k in ("paragraph_no", "family", "probability", "similarity", "confirmed")])
    return found.withColumn("license", F.when(F.col("confirmed"), F.col("family")).otherwise(F.lit(UNKNOWN)))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "paragraph_no", "license", "family", "probability", "similarity", "confirmed")
