"""Operator 6: licence families of paragraphs, by a trained sparse n-gram logistic regression.

A paragraph ends at a blank line or at a line that ends a sentence, so a notice that is wrapped over lines is one.
Scoring is DataFrame functions only: a paragraph's distinct word 2- and 3-grams meet the model's (a bounded table
that is broadcast) and their weights are summed. A temperature and a floor fitted on held-out paragraphs make the
unknown class; a predicted family must also be confirmed by its closest template, of whose n-grams the paragraph
must hold half.
"""

from __future__ import annotations

import json
import math
import random
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices of the licence families that are told apart: sentences, headings and identifiers (fixed values).
TEMPLATES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "Licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "See the License for the specific language governing permissions and limitations under the License.", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Licensed under the BSD 3-Clause License.", "Released under the 2-Clause BSD License.", "BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released into the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU General Public License along with this program.", "Licensed under the GNU General Public License, version 2 or later.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "Licensed under the MIT License.", "The MIT License (MIT)", "MIT License", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "reserved": ["All rights reserved.", "Copyright by the author. All rights reserved. No part of this publication may be reproduced without permission."],
}
OTHER = "other"
NEGATIVES = 2000  # paragraphs of the corpus, drawn by hash, that the fit sees at most
VARIANTS = 24
STEPS = 300
CONFIRM = 0.5
LEAST_ROWS = 3  # training rows that an n-gram beyond the templates' own is in
WORDS = r"[^a-z0-9.-]+"
#: Where a paragraph ends: a line end after the end of a sentence, or a line without a letter or digit.
BREAK = r"(?<=[.!?:;][\"')\]]?)[ \t\r]*\n|\n[^\p{L}\p{N}\n]*(?=\n)"


def _words(text: str) -> list[str]:
    out = "".join(c if c.isascii() and (c.isalnum() or c in ".-") else " " for c in text.lower()).split()
    return [w.strip(".-") for w in out if w.strip(".-")]


def _grams(words: list[str]) -> list[str]:
    padded = ["^", *words, "$"]
    return sorted({" ".join(padded[i : i + n]) for n in (2, 3) for i in range(len(padded) - n + 1)})


class LicenceModel:
    """Weights, temperature, floor and templates; trained on variants of TEMPLATES against corpus paragraphs."""

    def __init__(self, negatives: list[str]):
        rng = random.Random(7)
        self.classes = [*TEMPLATES, OTHER]
        rows: list[tuple[list[str], int]] = []
        filler = [w for t in negatives[:200] for w in _words(t)] or ["text"]
        for k, family in enumerate(TEMPLATES):
            for template in TEMPLATES[family]:
                words = _words(template)
                for _ in range(VARIANTS):
                    some = [w for w in words if rng.random() > 0.06] or words
                    around = [rng.choice(filler) for _ in range(rng.randint(0, 12))] if rng.random() < 0.4 else []
                    rows.append((_grams(around + some if rng.random() < 0.5 else some + around), k))
        rows += [(_grams(_words(t)), len(self.classes) - 1) for t in negatives]
        for _ in range(400):  # licence words in prose, out of their order
            words = [w for f in TEMPLATES.values() for t in f for w in _words(t)]
            rows.append((_grams([rng.choice(words if rng.random() < 0.3 else filler) for _ in range(rng.randint(4, 30))]), len(self.classes) - 1))
        seen = Counter(g for gs, k in rows if k < len(TEMPLATES) for g in gs)
        own = {g for f in TEMPLATES.values() for t in f for g in _grams(_words(t))} | {g for g, n in seen.items() if n >= LEAST_ROWS}
        self.vocabulary = {g: i for i, g in enumerate(sorted(own))}
        rng.shuffle(rows)
        x = np.zeros((len(rows), len(self.vocabulary)), np.float32)
        for r, (gs, _) in enumerate(rows):
            x[r, [self.vocabulary[g] for g in gs if g in self.vocabulary]] = 1
        y = np.array([k for _, k in rows])
        cut = len(rows) * 3 // 4
        self.weights, self.bias = self._fit(x[:cut], y[:cut])
        self.temperature, self.floor = self._calibrate(x[cut:] @ self.weights + self.bias, y[cut:])
        self.templates = [(k, t) for k, f in enumerate(TEMPLATES) for t in TEMPLATES[f]]

    def _fit(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = len(self.classes)
        w, b, gw, gb = np.zeros((x.shape[1], k)), np.zeros(k), np.full((x.shape[1], k), 1e-3), np.full(k, 1e-3)
        target = np.eye(k)[y]
        for _ in range(STEPS):
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - target) / len(x)
            dw, db = x.T @ d + 2e-5 * w, d.sum(0)
            gw += dw * dw
            gb += db * db
            w -= 0.3 * dw / np.sqrt(gw)
            b -= 0.3 * db / np.sqrt(gb)
        return w, b

    def _calibrate(self, z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """The temperature of least log loss, and the probability below which one held-out family in a hundred falls."""
        best = (math.inf, 1.0)
        for t in np.geomspace(0.25, 8, 21):
            s = z / t
            s = s - s.max(1, keepdims=True)
            best = min(best, (float(-(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(1))).mean()), float(t)))
        s = np.exp(z / best[1] - (z / best[1]).max(1, keepdims=True))
        p = (s / s.sum(1, keepdims=True))[np.arange(len(y)), y]
        real = p[y < len(self.classes) - 1]
        return best[1], float(np.clip(np.quantile(real, 0.01) if len(real) else 0.5, 0.3, 0.9))


@lru_cache(maxsize=4)
def _trained(negatives: tuple[str, ...]) -> LicenceModel:
    return LicenceModel(list(negatives))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, paragraph, words) of the paragraphs of whole texts that have words; words are 64-bit hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.posexplode(F.split(text, BREAK)).alias("paragraph", "_part"))
    words = F.transform(F.split(F.lower("_part"), WORDS), lambda w: F.xxhash64(F.btrim(w, F.lit(".-"))))
    return parts.select("_row", "doc_id", "paragraph", F.array_remove(words, F.xxhash64(F.lit(""))).alias("words")).where(F.size("words") > 0)


def train(docs: DataFrame, negatives: int = NEGATIVES) -> LicenceModel:
    """Fits against at most `negatives` corpus paragraphs that name no licence: the least hashes of the whole texts of
    documents that a hash draws, an expected four for each paragraph wanted."""
    text = F.coalesce(F.col("text"), F.lit(""))
    share = F.pmod(F.xxhash64("doc_id", text, F.lit("licence")), F.lit(1 << 30))
    drawn = docs.select(text.alias("text"), share.alias("h")).where(F.col("h") <= (1 << 30) * min(1.0, 4 * negatives / max(docs.count(), 1)))
    rows = drawn.select(F.explode(F.split("text", BREAK)).alias("line"), "h")
    rows = rows.where(F.length("line").between(20, 600) & ~F.lower("line").rlike("licen[cs]e|licensed|copyright|rights reserved|permission|redistribut|public domain|creative commons"))
    found = rows.groupBy("line").agg(F.min("h").alias("h")).orderBy("h", "line").limit(negatives).collect()
    return _trained(tuple(r["line"] for r in found))


def licence_paragraphs(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """(doc_id, paragraph, family, probability, predicted) of the paragraphs the model takes for a licence notice.

    predicted: the likeliest family; family is it where the calibrated probability reaches the floor and the closest
    template of the family confirms it, else `unknown`. Paragraphs are numbered from 0 in their text, blank ones
    included; null and empty texts have none. Repeated rows are judged each; other columns are not read.
    """
    spark = docs.sparkSession
    n_classes = len(model.classes)
    holds = [set(_grams(_words(t))) for _, t in model.templates]
    table = [{"g": g.split(" "), "w": [float(v) for v in model.weights[i]], "t": [n for n, h in enumerate(holds) if g in h]} for g, i in model.vocabulary.items()]
    weights = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(table)), "array<struct<g:array<string>,w:array<double>,t:array<int>>>")))  # as large as TEMPLATES
    named = [F.xxhash64(F.get("g", F.lit(k))) for k in range(3)]
    weights = weights.select(F.when(F.size("g") == 2, F.xxhash64(*named[:2])).otherwise(F.xxhash64(*named)).alias("gram"), "w", "t")
    rows = paragraphs(docs)
    padded = F.concat(F.array(F.xxhash64(F.lit("^"))), F.col("words"), F.array(F.xxhash64(F.lit("$"))))
    rows = rows.withColumn("p", padded)
    two = F.transform(F.sequence(F.lit(0), F.size("p") - 2), lambda i: F.xxhash64(F.get("p", i), F.get("p", i + 1)))
    three = F.transform(F.sequence(F.lit(0), F.size("p") - 3), lambda i: F.xxhash64(F.get("p", i), F.get("p", i + 1), F.get("p", i + 2)))
    grams = rows.select("_row", "doc_id", "paragraph", F.explode(F.array_distinct(F.concat(two, three))).alias("gram"))
    hits = grams.join(F.broadcast(weights), "gram")
    shared = [F.sum(F.array_contains("t", n).cast("int")).alias(f"t{n}") for n in range(len(holds))]
    sums = hits.groupBy("_row", "doc_id", "paragraph").agg(*[F.sum(F.get("w", F.lit(c))).alias(f"w{c}") for c in range(n_classes)], *shared)
    z = [(F.col(f"w{c}") + float(model.bias[c])) / model.temperature for c in range(n_classes)]
    top = F.array_max(F.array(*[F.struct(z[c].alias("z"), F.lit(model.classes[c]).alias("name")) for c in range(n_classes)]))
    scored = sums.withColumn("top", top).withColumn("probability", 1.0 / sum((F.exp(x - F.col("top.z")) for x in z), F.lit(0.0)))
    of = {f: [F.col(f"t{n}") / len(holds[n]) for n, (k2, _) in enumerate(model.templates) if k2 == c] for c, f in enumerate(TEMPLATES)}
    close = F.coalesce(*[F.when(F.col("top.name") == f, F.array_max(F.array(*x))) for f, x in of.items()], F.lit(0.0))
    scored = scored.withColumn("closeness", close).where(F.col("top.name") != OTHER)
    sure = (F.col("probability") >= model.floor) & (F.col("closeness") >= CONFIRM)
    return scored.select("doc_id", "paragraph", F.when(sure, F.col("top.name")).otherwise("unknown").alias("family"), "probability", F.col("top.name").alias("predicted"), "closeness")


def licence_scan(docs: DataFrame) -> DataFrame:
    """licence_paragraphs with a model trained on the same table."""
    return licence_paragraphs(docs, train(docs))
