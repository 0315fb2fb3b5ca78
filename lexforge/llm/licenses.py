"""Licence scan: a trained paragraph classifier, confirmed against templates.

A softmax regression over sparse word n-grams is fitted on the driver from the
template texts below, varied, and a bounded sample of corpus paragraphs. Besides
the families there is a class for licences of no listed family, fitted on other
licences and calibrated on ones that the fit has not seen, and one for what is no
licence. Scoring is DataFrame expressions only: a paragraph is a run of lines that
hold words of the model, cut where a line holds none; its n-grams meet the
broadcast weights, and their sum is turned into calibrated probabilities. The
paragraph is then compared with whole templates of the predicted family: it is
confirmed only if it holds nearly all word pairs of one of them.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.quality import let

NONE = "none"
UNKNOWN = "unknown"
#: Bounds of the sample of corpus paragraphs that the model is fitted on: documents, paragraphs, characters of a paragraph.
SAMPLE_DOCUMENTS, SAMPLE_PARAGRAPHS, SAMPLE_CHARS = 200, 1500, 4000
#: Least probability of a family, and least share of a template's word pairs that the paragraph must hold.
LEAST_PROBABILITY, LEAST_OVERLAP = 0.6, 0.9
NAMES = {
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD License", "New BSD License"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC BY 3.0"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC 3.0", "CC BY-NC-SA 4.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC BY-SA 3.0"],
    "cc0": ["CC0 1.0 Universal", "CC0 public domain dedication", "CC0 1.0"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL v3", "GPL-3.0"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v3", "LGPL-2.1"],
    "mit": ["MIT License", "MIT license (MIT)", "Expat License"],
    "mpl": ["Mozilla Public License, version 2.0", "MPL-2.0", "Mozilla Public License 2.0"],
}
SENTENCES = ["This work is licensed under the {}.", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This software is distributed under the terms of the {}.", "The code is available under the {}.", "See the {} for details.", "{}"]
_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
TEXTS = {
    "apache": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "You should have received a copy of the GNU General Public License along with this program. If not, see"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "You should have received a copy of the GNU Lesser General Public License along with this library"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", _WARRANTY],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}
#: Licences of no listed family; whole names go to one side or the other when the model is calibrated.
OTHERS = [
    "Boost Software License 1.0", "European Union Public Licence 1.2", "Eclipse Public License 2.0", "GNU Affero General Public License, version 3", "AGPL-3.0",
    "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0", "CC BY-NC-ND 4.0", "ISC License", "zlib License", "Artistic License 2.0",
    "Common Development and Distribution License 1.0", "Python Software Foundation License", "Microsoft Public License", "SIL Open Font License 1.1",
    "Academic Free License 3.0", "Open Software License 3.0", "PostgreSQL License", "Universal Permissive License 1.0", "University of Illinois Open Source License",
    "W3C Software Notice and License", "Business Source License 1.1", "Server Side Public License", "Elastic License 2.0", "Open Database License",
    "IBM Public License 1.0", "Apple Public Source License 2.0", "Ruby License", "PHP License 3.01", "Vim License", "Community Data License Agreement", "Unlicense",
]
OTHER_TEXTS = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
]
#: Talk of licences that grants nothing, and plain sentences.
OTHER = [
    "All rights reserved.", "This software is proprietary and confidential.", "Use of this service is subject to its terms of use.", "The driver must carry a valid license at all times.",
    "The public library opens at nine.", "Version 2 of the report is under review.", "The work was done under the supervision of the author.", "General terms of the contract were released in May.",
    "He lost his fishing license in the river.", "The bar has a licence to sell spirits.", "Software of this kind is used in many offices.", "A copy of the letter was included in the file.",
    "The license plate was green.", "They discussed which license would suit the project.", "Copyright law is a wide field.", "The foundation supports free schools.",
]


def tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", re.sub(r"[^\x00-\x7f]", " ", text.lower()))


def grams(words: list[str]) -> list[str]:
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))})


def templates(family: str) -> list[str]:
    return [s.format(n) for n in NAMES[family] for s in SENTENCES] + TEXTS.get(family, [])


def _sources() -> list[tuple[str, str, str]]:
    """(text, class, group): what is varied; a group is one name or text, so that held-out groups are new to the fit."""
    out = [(s.format(n), family, n) for family in sorted(NAMES) for n in NAMES[family] for s in SENTENCES]
    out += [(t, family, t) for family in sorted(TEXTS) for t in TEXTS[family]]
    out += [(s.format(n), UNKNOWN, n) for n in OTHERS for s in SENTENCES] + [(t, UNKNOWN, t) for t in OTHER_TEXTS]
    return out + [(t, NONE, t) for t in OTHER]


def examples(seed: int, copies: int = 12) -> list[tuple[list[str], str, str]]:
    """(words, class, group): templates with words dropped, cut out or put in between."""
    rng = random.Random(seed)
    filler = tokens(" ".join(OTHER))
    out = [([], NONE, "")]
    for text, label, group in _sources():
        words = tokens(text)
        for k in range(copies if len(words) > 20 or label == NONE else 3):
            some = list(words)
            if k:
                keep = set(tokens(group)) if len(words) <= 20 else set()
                some = [w for w in some if w in keep or rng.random() > 0.15]
                if len(some) > 20:
                    at = rng.randrange(len(some) // 2)
                    some = some[at : at + rng.randint(12, 60)]
                some = rng.choices(filler, k=rng.randint(0, 3)) + some + rng.choices(filler, k=rng.randint(0, 3))
            out.append((some, label, group))
    return out


@dataclass
class Model:
    families: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float


def _descend(x: np.ndarray, y: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by gradient descent with momentum; every class weighs the same."""
    share = y.mean(axis=0)
    weight = (y / share.clip(1e-9)).sum(axis=1, keepdims=True) / y.shape[1]
    w, b = np.zeros((x.shape[1], y.shape[1]), dtype=np.float32), np.zeros(y.shape[1], dtype=np.float32)
    dw, db = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = (weight * (p - y) / len(x)).astype(np.float32)
        dw = 0.9 * dw - 2.0 * (x.T @ slope + np.float32(1e-5) * w)
        db = 0.9 * db - 2.0 * slope.sum(axis=0)
        w, b = w + dw, b + db
    return w, b


def fit(negatives: list[list[str]], seed: int = 7, steps: int = 120) -> Model:
    """The model on all examples, with the temperature under which a fit without every fourth group makes those likeliest."""
    labelled = examples(seed) + [(w, NONE, f"negative {k}") for k, w in enumerate(negatives)]
    families = [*sorted(NAMES), UNKNOWN, NONE]
    common: dict[str, int] = {}
    for words in negatives:
        for g in set(words):
            common[g] = common.get(g, 0) + 1
    # Words that the corpus uses everywhere tell nothing and would touch every paragraph.
    rare = 0.01 * max(1, len(negatives))
    own = sorted({g for words, label, _ in labelled if label != NONE for g in grams(words) if any(common.get(w, 0) <= rare for w in g.split(" "))})
    vocabulary = {g: k for k, g in enumerate(own)}
    x = np.zeros((len(labelled), len(vocabulary)), dtype=np.float32)
    y = np.zeros((len(labelled), len(families)), dtype=np.float32)
    for i, (words, label, _) in enumerate(labelled):
        for g in grams(words):
            if g in vocabulary:
                x[i, vocabulary[g]] = 1
        y[i, families.index(label)] = 1
    groups = {g: k for k, g in enumerate(dict.fromkeys(g for *_, g in labelled))}
    held = np.array([groups[g] % 4 == 1 for *_, g in labelled])
    w, b = _descend(x[~held], y[~held], steps)

    def loss(t: float) -> float:
        z = (x[held] @ w + b) / t
        z -= z.max(axis=1, keepdims=True)
        return float(-(y[held] * (z - np.log(np.exp(z).sum(axis=1, keepdims=True)))).sum())

    temperature = min((0.25 * 1.25**k for k in range(16)), key=loss)
    w, b = _descend(x, y, steps)
    if families[int(b.argmax())] != NONE:
        raise ValueError("a line without a word of the model must score as no licence")
    return Model(families, {g: w[k].tolist() for g, k in vocabulary.items()}, b.tolist(), temperature)


def sample_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[list[str]]:
    """Lines of the SAMPLE_DOCUMENTS documents with the smallest hashes, without those that speak of licences.

    The sample depends on the rows alone, not on their order: documents are ranked
    by a hash of id and text, lines by one of their own, and a line counts with
    its first SAMPLE_CHARS characters.
    """
    text = F.col(text_col).cast("string")
    own = docs.select(F.xxhash64(F.col(id_col).cast("long"), text).alias("h"), text.alias("t")).filter("t IS NOT NULL")
    # Only hashes are ranked; the texts of the few documents up to the last of them are then read.
    last = own.select("h").orderBy("h").limit(SAMPLE_DOCUMENTS).agg(F.max("h")).first()[0]
    if last is None:
        return []
    lines = own.filter(F.col("h") <= F.lit(last)).select("h", F.explode(F.split("t", "\n")).alias("line")).filter("line <> ''").distinct()
    marked = r"(?i)licen[cs]|copyright|public domain|warrant|\bcc\b|\bgnu\b"
    rows = lines.filter(~F.col("line").rlike(marked)).select(F.xxhash64("h", "line").alias("k"), F.substring("line", 1, SAMPLE_CHARS).alias("line")).orderBy("k", "line").limit(SAMPLE_PARAGRAPHS)
    found = [tokens(r.line) for r in rows.collect()]
    return [w for w in found if w]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.regexp_replace(text, r"[^\x00-\x7f]", " ")), "[^a-z0-9]+"), "")


def _grams(words: Column) -> Column:
    def of(w: Column) -> Column:
        pairs = F.transform(w, lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
        return F.array_distinct(F.concat(w, F.slice(pairs, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0)))))

    return let(words, of)


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words that shares their beginnings, so a place is tried once and not once a word."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    ends = "" in heads
    parts = [c + _any_of(rest) for c, rest in sorted(heads.items()) if c]
    if not parts:
        return ""
    return f"(?:{'|'.join(parts)})" + ("?" if ends else "")


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from a literal, so that no Python runs on the executors."""
    text = F.lit(json.dumps(rows))
    return spark.range(1).select(F.explode(F.from_json(text, f"array<struct<{schema}>>")).alias("r")).select("r.*")


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least_probability: float = LEAST_PROBABILITY, least_overlap: float = LEAST_OVERLAP) -> DataFrame:
    """(doc_id, paragraph, family, probability, overlap, confirmed) for each paragraph that speaks of a licence.

    A paragraph is a run of lines that hold a word of the model, whole texts over;
    its number is that of its first line, from 0. One is reported if its likeliest
    class is a family or ``unknown``; it is also ``unknown`` if that family is under
    ``least_probability`` after calibration. ``overlap`` is the greatest share of one
    template's word pairs that the paragraph holds, over the templates of the
    likeliest family, and from ``least_overlap`` on the family is confirmed. Null and
    empty texts report nothing, rows that repeat an id report for each, a null id
    stays null, a very long line is one line. Other columns are not read.
    """
    spark = docs.sparkSession
    families = model.families
    of_family = {f: [sorted(g for g in grams(tokens(t)) if " " in g or len(tokens(t)) == 1) for t in templates(f)] for f in families if f in NAMES}
    compared = {g for held in of_family.values() for t in held for g in t}
    zero = [0.0] * len(families)
    weights = _table(spark, [{"gram": g, "w": model.weights.get(g, zero), "held": g in compared} for g in sorted({*model.weights, *compared})], "gram:string,w:array<double>,held:boolean")
    # A line without any gram of the model scores as its bias, which is no licence. Every pair
    # of the model has a word that the corpus seldom uses, and that word is in the model too.
    marks = sorted(g for g in model.weights if " " not in g)
    marked = rf"(?<![a-z0-9]){_any_of(marks)}(?![a-z0-9])" if marks else r"(?!)"
    lines = F.transform(F.split(F.col(text_col).cast("string"), "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    kept = F.filter(lines, lambda x: F.lower(x["line"]).rlike(marked))
    # Lines that stand together share the difference of their number and their place among the lines kept.
    runs = F.transform(kept, lambda x, k: F.struct(x["i"].alias("i"), (x["i"] - k).alias("run"), x["line"].alias("line")))
    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), runs.alias("runs")).filter(F.size("runs") > 0)
    each = each.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", F.explode("runs").alias("r"))
    exploded = each.select("doc_id", "row", "r.run", "r.i", F.explode(_grams(_words(F.col("r.line")))).alias("gram"))
    met = exploded.join(F.broadcast(weights), "gram")
    # A gram counts once in a paragraph, in however many of its lines it stands.
    once = met.groupBy("doc_id", "row", "run", "gram").agg(F.min("i").alias("i"), F.first("w").alias("w"), F.first("held").alias("held"))
    sums = once.groupBy("doc_id", "row", "run").agg(
        F.min("i").alias("paragraph"), *[F.sum(F.get("w", F.lit(k))).alias(f"z{k}") for k in range(len(families))], F.collect_list(F.when(F.col("held"), F.col("gram"))).alias("pairs")
    )
    z = F.array(*[(F.col(f"z{k}") + F.lit(model.bias[k])) / F.lit(model.temperature) for k in range(len(families))])
    scored = sums.select("doc_id", "paragraph", "pairs", z.alias("z")).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top")))
    best = scored.withColumn("probability", 1 / total).withColumn("best", F.element_at(F.array(*map(F.lit, families)), F.array_position("z", F.col("top")).cast("int")))
    held = F.from_json(F.lit(json.dumps(of_family)), "map<string,array<array<string>>>")
    share = F.transform(F.coalesce(F.try_element_at(held, F.col("best")), F.array()), lambda t: F.size(F.array_intersect("pairs", t)) / F.size(t))
    out = best.filter(F.col("best") != NONE).withColumn("overlap", F.coalesce(F.array_max(share), F.lit(0.0)))
    sure = (F.col("best") != UNKNOWN) & (F.col("probability") >= least_probability)
    return out.select(
        "doc_id", "paragraph", F.when(sure, F.col("best")).otherwise(F.lit(UNKNOWN)).alias("family"), "probability", "overlap",
        (sure & (F.col("overlap") >= least_overlap)).alias("confirmed"),
    )


def scan_documents(docs: DataFrame, **options) -> DataFrame:
    return scan(docs, fit(sample_paragraphs(docs)), **options)
