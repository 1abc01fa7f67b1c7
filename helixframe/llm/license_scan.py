"""Operator 5, license scans: a trained paragraph classifier, confirmed against templates.

A paragraph ends at a blank line, or at a line that ends like a sentence; one of several lines is judged as a whole, so
that a wrapped notice is read in one piece, and where that finds nothing, line by line. Sparse binary features are words
and word pairs; a multinomial logistic regression with an L1 penalty over license families and `unknown` is trained on
whole notices, on names in several framings, on sentences about licenses that are none, and on at most `negatives`
paragraphs of a hash sample of the corpus. A quarter of those, and sentences with license words that are no license, are
kept from training and calibrate the unknown class: a family needs more probability than all but a thousandth of the
former and any of the latter get, and more than the unknown class. A prediction is confirmed if the paragraph holds
most words of a name or notice of the family.

The penalty leaves few n-grams with weight, and a paragraph that holds none of those that speak for a family cannot be
found to be of one; that is tested first, so most paragraphs are never made into features. DataFrame functions and the
DataFrame-based spark.ml only; documents are scored where they are read, without a shuffle.

Defined results: null, empty and license-free texts give no rows; paragraphs of any length are read whole; equal
probabilities go to the later family by name; repeated rows and paragraphs are reported each; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm._shared import materialise

UNKNOWN = "unknown"
#: Names of license families, as notices write them.
NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "ASL 2.0"),
    "BSD": ("BSD 3-Clause License", "BSD 2-Clause License", "modified BSD license", "BSD license", "New BSD License"),
    "CC-BY": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY 3.0", "Creative Commons Attribution 3.0 Unported"),
    "CC-BY-NC": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC-BY-NC 3.0"),
    "CC-BY-SA": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA 2.0"),
    "CC0": ("CC0 1.0 Universal public domain dedication", "CC0 1.0", "public domain", "the Unlicense"),
    "GPL": ("GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL v3", "GPL version 2 or later", "GNU Affero General Public License", "GPLv3", "AGPL 3.0"),
    "LGPL": ("GNU Lesser General Public License, version 3", "GNU LGPL v2.1", "LGPL version 3", "LGPL-2.1"),
    "MIT": ("MIT License", "MIT license", "the Expat license", "MIT/X11 license"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "MPL 2.0", "Mozilla Public License 2.0"),
}
#: Paragraphs of the usual notices.
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "CC-BY": ("You are free to share and adapt the material for any purpose, even commercially, provided that you give appropriate credit and indicate if changes were made.",),
    "CC-BY-NC": ("You may share and adapt the material with appropriate credit, but you may not use the material for commercial purposes.",),
    "CC-BY-SA": ("If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.",),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This is free and unencumbered software released into the public domain."),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
    ),
    "LGPL": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "proprietary": (
        "Copyright 2021 the owner. All rights reserved.",
        "All rights reserved by the publisher.",
        "(c) 2019 Example Corporation, all rights reserved",
        "Copyright 2015-2020 by the editors. All rights are reserved worldwide.",
        "All rights reserved; no use without a written agreement.",
        "© The Example Press. All rights reserved",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "No part of this publication may be reproduced, stored or transmitted in any form without the prior written permission of the publisher.",
    ),
}
#: Framings of names; none is a whole line of the given tables, whose wordings are not trained on.
FRAMES = (
    "Distributed under the terms of the {}.", "This software is available under {}", "Content is licensed under a {} unless noted.", "License: {}", "See the {} for details.", "Made available under the {} by its authors",
    "Use of this file is governed by the {}", "{} applies to all files", "Code released under {}", "Subject to the {}; see the file for its text", "Dual licensed: {} or a commercial agreement", "This work is offered under the {}",
)
#: Sentences with words of licenses that are none.
NEAR_MISSES = (
    "The driver must carry a license at all times.", "She holds a license to practise medicine.", "The general public was invited to the reading.", "The work was released in the spring under a new title.", "He reserved a table for all of them.",
    "The software runs under version 3 of the system.", "Attribution of the painting is open.", "All rooms are reserved.", "Researchers at MIT published the results in May.", "An Apache helicopter landed at the base.", "The gnu is an antelope of the plains.",
    "The commons of the village were open to all creative minds.", "A public library opened in 1921 under the terms of the will.", "Permission to land was granted at noon.", "The license plate was bent.", "The copyright lawyer spoke for an hour.",
    "This program is on television every Friday.", "The terms of the contract were harsh.", "The domain of the function is public knowledge.", "The version of the story that was published is free of errors.", "Redistribution of wealth was debated.",
    "All rights of way are shown on the map.", "The material was shared by the team.", "You may use the door on the left.", "A fishing licence costs five pounds.", "The file was copied to another disk without loss.", "The Mozilla foundation moved its office.", "The author waived the fee.",
)
#: The same, kept from training: what they get is the least that a family has to exceed.
HELD_MISSES = (
    "He lost his driving license in March.", "The public was asked for permission.", "All of the seats were reserved by noon.", "The general told the public nothing.", "The second version of the bridge was built in 1910.", "The students of MIT won the cup.",
    "The rights of the workers were in the contract.", "A creative spirit common to the whole village.", "The attribution of the poem is in doubt.", "The team published an open letter.", "An Apache chief signed the treaty.", "Reserved people speak little of their rights.",
    "The copyright of the song was sold twice.", "The file was written under protest.", "The mayor distributed the prizes to the public.", "A licence for the shop was granted.", "Two conditions were met before the sale.", "The domain belongs to the public school.",
)
LICENSE_WORDS = r"(?i)licen[sc]|copyright|rights reserved|creative commons|\bcc\b|gpl|redistribut|public domain|permission|warrant"
VOCABULARY, SHARE = 1 << 14, 0.8
WORD_BREAK = r"[^\p{L}\p{N}]"


def templates() -> list[tuple[str, str]]:
    """(family, notice) of all that is trained on."""
    named = [(family, frame.format(name)) for family, names in NAMES.items() for name in names for frame in FRAMES]
    return named + [(family, text) for family, texts in NOTICES.items() for text in texts for _ in range(8)]


def literal_rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """`label_name`, `unit` of a list in the program."""
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("label_name"), F.lit(b).alias("unit")) for a, b in rows])).alias("r")).select("r.*")


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`hf_id`, `paragraph_no`, `paragraph`: lines up to a blank one or to one that ends like a sentence."""
    parts = F.split(F.col(text_col), r"\n\s*\n|(?<=[.!?:;])[ \t\r]*\n")
    return docs.select(F.col(id_col).alias("hf_id"), F.posexplode(parts).alias("paragraph_no", "paragraph"))


def features() -> list:
    return [
        RegexTokenizer(inputCol="unit", outputCol="hf_words", pattern=WORD_BREAK + "+", toLowercase=True),
        NGram(n=2, inputCol="hf_words", outputCol="hf_pairs"),
        CountVectorizer(inputCol="hf_words", outputCol="hf_w", vocabSize=VOCABULARY, minDF=2.0, binary=True),
        CountVectorizer(inputCol="hf_pairs", outputCol="hf_p", vocabSize=VOCABULARY, minDF=2.0, binary=True),
        VectorAssembler(inputCols=["hf_w", "hf_p"], outputCol="hf_x"),
    ]


def best(classes: list[str]) -> Column:
    """(probability, family) of the likeliest family other than unknown; ties go to the later name."""
    p = vector_to_array("hf_probability")
    return F.array_max(F.array(*[F.struct(p[i].alias("probability"), F.lit(c).alias("family")) for i, c in enumerate(classes) if c != UNKNOWN]))


def likely(classes: list[str], level: float) -> Column:
    """Whether the likeliest family gets more than `level` and more than unknown does."""
    p = best(classes)["probability"]
    return (p > level) & (p > vector_to_array("hf_probability")[classes.index(UNKNOWN)])


def train(docs: DataFrame, negatives: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> tuple[PipelineModel, list[str], float]:
    """The model, its classes, and the probability that a family needs.

    Documents are drawn by a hash of the id, four for each negative; of their paragraphs that name no license word those
    whose hash comes first are the negatives, so every run draws alike.
    """
    spark = docs.sparkSession
    known = templates() + [(UNKNOWN, t) for t in NEAR_MISSES for _ in range(4)]
    classes = sorted({f for f, _ in known})
    total = docs.select(id_col).count()
    drawn = docs.where(F.pmod(F.xxhash64(F.lit("license"), id_col), F.lit(1 << 30)) < F.lit(int(min(1.0, 4 * negatives / max(1, total)) * (1 << 30))))
    clean = paragraphs(drawn, id_col, text_col).where(F.rlike("paragraph", F.lit(r"\p{L}")) & ~F.rlike("paragraph", F.lit(LICENSE_WORDS)))
    place = F.xxhash64(F.lit("license"), "paragraph", "hf_id", "paragraph_no")
    chosen = clean.withColumn("hf_place", place).orderBy("hf_place", "paragraph").limit(negatives).select(F.lit(UNKNOWN).alias("label_name"), F.col("paragraph").alias("unit"), (F.pmod("hf_place", F.lit(4)) == 0).alias("hf_held"))
    hard = literal_rows(spark, [(UNKNOWN, t) for t in HELD_MISSES])
    rows = materialise(literal_rows(spark, known).withColumn("hf_held", F.lit(False)).unionByName(chosen).repartition(1))
    rows = rows.withColumn("label", F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label_name")).cast("double") - 1)
    regression = LogisticRegression(featuresCol="hf_x", labelCol="label", probabilityCol="hf_probability", rawPredictionCol="hf_raw", predictionCol="hf_prediction", family="multinomial", regParam=5e-4, elasticNetParam=1.0, standardization=False, maxIter=100)
    model = Pipeline(stages=[*features(), regression]).fit(rows.where("NOT hf_held"))
    usual = model.transform(rows.where("hf_held")).agg(F.percentile(best(classes)["probability"], F.lit(0.999))).first()[0]
    most = model.transform(hard).agg(F.max(best(classes)["probability"])).first()[0]
    return model, classes, max(usual or 0.0, most)


def speaking(model: PipelineModel, classes: list[str]) -> str | None:
    """A pattern of the n-grams that speak for a family; what holds none of them cannot be likelier than unknown. None where the model has no such bound."""
    weights, base, unknown = model.stages[-1].coefficientMatrix.toArray(), model.stages[-1].interceptVector.toArray(), classes.index(UNKNOWN)
    if max(b - base[unknown] for c, b in zip(classes, base, strict=True) if c != UNKNOWN) > 0:
        return None
    gain = (weights - weights[unknown]).max(axis=0)
    words, pairs = model.stages[2].vocabulary, model.stages[3].vocabulary
    strong = {w for w, g in zip(words, gain, strict=False) if g > 0}
    both = [p.split(" ") for p, g in zip(pairs, gain[len(words) :], strict=True) if g > 0]
    grams = [re.escape(w) for w in sorted(strong)] + [f"{WORD_BREAK}+".join(map(re.escape, p)) for p in sorted(both) if not strong & set(p)]
    return rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(grams)})(?![\p{{L}}\p{{N}}])" if grams else None


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", negatives: int = 4000) -> DataFrame:
    """id, paragraph_no, family, probability, confirmed, paragraph: one row a paragraph, or line of one, that a family is found in."""
    docs = docs.select(id_col, text_col)
    model, classes, level = train(docs, negatives, id_col, text_col)
    pattern = speaking(model, classes)
    may = lambda c: F.rlike(c, F.lit(pattern)) if pattern else F.rlike(c, F.lit(r"\p{L}"))
    kept = ("hf_id", "paragraph_no")
    whole = model.transform(paragraphs(docs, id_col, text_col).where(may("paragraph")).withColumn("unit", F.col("paragraph"))).withColumn("hf_found", likely(classes, level))
    units = F.when(F.col("hf_found"), F.array("paragraph")).when(F.contains("paragraph", F.lit("\n")), F.split("paragraph", "\n")).otherwise(F.array().cast("array<string>"))
    single = whole.select(*kept, "hf_found", F.explode(units).alias("unit")).where(F.col("hf_found") | may("unit"))
    scored = model.transform(single).withColumn("hf_best", best(classes)).where(likely(classes, level))
    words = lambda text: F.array_distinct(F.filter(F.split(F.lower(text), WORD_BREAK + "+"), lambda w: w != ""))
    forms = {c: [*NAMES.get(c, ()), *NOTICES.get(c, ()), *(("All rights reserved.",) if c == "proprietary" else ())] for c in classes if c != UNKNOWN}
    table = F.create_map(*[x for c, texts in forms.items() for x in (F.lit(c), F.array(*[words(F.lit(t)) for t in texts]))])
    fits = F.exists(F.element_at(table, F.col("family")), lambda t: F.size(F.array_intersect(t, F.col("hf_words"))) >= SHARE * F.size(t))
    found = scored.select(*kept, F.col("hf_best.family").alias("family"), F.round("hf_best.probability", 6).alias("probability"), "hf_words", F.col("unit").alias("paragraph"))
    return found.select(F.col("hf_id").alias(id_col), F.col("paragraph_no").cast("long").alias("paragraph_no"), "family", "probability", fits.alias("confirmed"), "paragraph")
