"""Licence scans: a trained paragraph classifier, with DataFrame and SQL functions and MLlib's DataFrame API only.

Paragraphs are blocks between blank lines, and the single lines of blocks of several
lines, so that wrapped notices and one-line notices are both seen whole. Sparse word
n-grams (1 to 3 words of the training notices) feed a multinomial logistic regression
over licence families, other licences and "none". Paragraphs whose words can't lift any
class above "none", by a bound taken from the fitted weights, are "none" without
being scored: the result is the same as with all of them scored. The probability below which a family is called
`unknown` is calibrated on held-out paragraphs that are no licence of any family. A
predicted family stands only if a template of that family confirms it by shared
word pairs; otherwise the paragraph is `unknown` too, as other licences are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_sample, checkpoint

NONE, OTHER, UNKNOWN = "none", "other", "unknown"

#: Notices of each family, from the public licence texts and their usual short forms.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This software is licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Distributed under the terms of the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Licensed under the BSD 3-Clause License.",
        "Released under the 2-clause BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Content is available under CC BY-SA 4.0 unless otherwise noted.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}
#: Paragraphs that speak of licences or the same names without granting any of the families.
OTHERS = (
    "All rights reserved. No part of this publication may be reproduced without written permission of the publisher.",
    "This software is proprietary and confidential; use is subject to a separate license agreement with the vendor.",
    "Copyright 2021 by the authors.",
    "The driver had no license and the plate of the car was missing.",
    "Apache helicopters landed near the base in the morning.",
    "She studied at MIT and later worked on compilers.",
    "The license fee is due every year on the first of March.",
    "He was licensed to practise medicine in two countries.",
    "Please ask for permission before you copy the pictures.",
    "The warranty covers parts and labour for two years.",
    "The BSD conference takes place in Ottawa.",
    "You need a fishing licence for the lake.",
    "The book is in the public domain.",
    "Terms of use and license agreement apply to all customers.",
    "The software vendor updated the license server, version 4.0.",
    "Mozilla released a new version of the browser.",
    "The general public was invited to the open day.",
    "Attribution of the painting to the master is disputed.",
)
#: Notices of licences of no family.
OTHER_LICENSES = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "This is free and unencumbered software released into the public domain.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Licensed under the EUPL, Version 1.2 or later.",
    "Distributed under the Boost Software License, Version 1.0.",
    "SPDX-License-Identifier: ISC",
    "SPDX-License-Identifier: Zlib",
    "Licensed under the Open Software License version 3.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "Released under the Artistic License 2.0.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document.",
)
#: Words around a notice, for training examples.
FRAMES = ("{}", "Copyright (c) 2019 Example Authors. {}", "{} See the LICENSE file for details.", "Note: {}", "{} All contributions are welcome.", "* {} *", "The code in this repository: {}", "{} http://example.com/legal")


def _split_words(text: Column) -> Column:
    """Lower-cased runs of [a-z0-9.+-], without marks at their ends; empty ones among them."""
    return F.split(F.lower(text), r"[.+-]*[^a-z0-9.+-]+[.+-]*|^[.+-]+|[.+-]+$")


def _words(text: Column) -> Column:
    """Lower-cased words of [a-z0-9.+-] with a letter or digit, without marks at their ends."""
    return F.filter(_split_words(text), lambda w: w.rlike("[a-z0-9]"))


def _grams(words: Column | str) -> Column:
    """The distinct pairs of neighbouring words."""
    w = F.col(words) if isinstance(words, str) else words
    pairs = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(w) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def with_runs(df: DataFrame, text: str) -> DataFrame:
    """df and the columns __words and __runs, the runs of 1 to 3 words of a text column."""
    df = df.withColumn("__words", _words(F.coalesce(F.col(text), F.lit(""))))
    for n in (2, 3):
        df = NGram(n=n, inputCol="__words", outputCol=f"__runs{n}").transform(df)
    return df.withColumn("__runs", F.concat("__words", "__runs2", "__runs3")).drop("__runs2", "__runs3")


def _vectors(spark: SparkSession, vocabulary: list[str]) -> CountVectorizerModel:
    return CountVectorizerModel.from_vocabulary(vocabulary, inputCol="__runs", outputCol="__features").setBinary(True)


@dataclass
class LicenseModel:
    """The fitted regression over `vocabulary`; `cues` bounds, word by word, how far the n-grams of a paragraph lift each class over "none", which takes `lifts`."""

    classes: list[str]
    vocabulary: list[str]
    regression: LogisticRegressionModel
    cues: dict[str, list[float]]
    lifts: list[float]
    threshold: float


def _cue_bound(vocabulary: list[str], weights, bias, counts: dict[str, int]) -> tuple[dict[str, list[float]], list[float]]:
    """For each class but "none": each n-gram that speaks for it more than for "none" counts, with its lead, for the longest
    run of letters and digits of the rarest of its words; and the sum of leads from which the class may beat "none"."""
    leads = np.maximum((weights - weights[-1])[:-1], 0.0)
    cues: dict[str, np.ndarray] = {}
    for gram, own in zip(vocabulary, leads.T):
        if own.any():
            word = min(gram.split(" "), key=lambda w: (counts.get(w, 0), -len(w), w))
            run = max(re.findall("[a-z0-9]+", word), key=len)
            cues[run] = cues.get(run, 0.0) + own
    return {run: own.tolist() for run, own in cues.items()}, (bias[-1] - bias[:-1] - 1e-6).tolist()


def may_be_license(text: Column, model: LicenseModel) -> Column:
    """Whether the cue words of a text can lift any class to "none" or above it; true of a text if it is of one of its parts."""
    names = sorted(model.cues)
    found = F.array_intersect(F.array(*map(F.lit, names)), F.split(F.lower(text), "[^a-z0-9]+"))

    table = F.create_map(*[x for n in names for x in (F.lit(n), F.array(*map(F.lit, model.cues[n])))])
    sums = F.aggregate(found, F.array(*[F.lit(0.0)] * len(model.lifts)), lambda s, w: F.zip_with(s, F.element_at(table, w), lambda x, y: x + y))
    return F.exists(F.zip_with(sums, F.array(*map(F.lit, model.lifts)), lambda x, y: x >= y), lambda x: x)


def paragraphs_of(docs: DataFrame, text: str, model: LicenseModel | None = None) -> DataFrame:
    """docs without `text`, and block_no, line_no, paragraph: the blocks of its texts (line_no 0) and the lines (from 1) of blocks of several lines.

    With a model only those that may be licences by its bound: texts first, then their blocks, then lines of these.
    """

    def admitted(df: DataFrame, column: str) -> DataFrame:
        return df if model is None else df.where(may_be_license(F.col(f"`{column}`"), model))

    docs = admitted(docs, text)
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]
    blocks = docs.select(*kept, F.posexplode(F.split(F.col(f"`{text}`"), r"\n[ \t\r]*\n")).alias("block_no", "__block"))
    blocks = admitted(blocks, "__block")
    lines = F.split("__block", "\n")
    units = F.when(F.size(lines) > 1, F.concat(F.array("__block"), lines)).otherwise(F.array("__block"))
    return admitted(blocks.select(*kept, "block_no", F.posexplode(units).alias("line_no", "paragraph")).where(F.col("paragraph").rlike("[A-Za-z0-9]")), "paragraph")


def _training_rows(spark: SparkSession, docs: DataFrame, most_rows: int, text: str) -> DataFrame:
    """(text, label, fold): framed and thinned notices, other paragraphs, and those of a bounded sample of the corpus that share less than a third of the word pairs of any template."""
    classes = [*TEMPLATES, OTHER, NONE]
    notices = {**TEMPLATES, OTHER: OTHER_LICENSES, NONE: OTHERS}
    known = [(t, classes.index(c)) for c, texts in notices.items() for t in texts]
    fixed = spark.createDataFrame(known, "text string, label int")
    frames = F.explode(F.array(*map(F.lit, FRAMES))).alias("frame")
    framed = fixed.select("label", "text", frames).select(F.expr("replace(frame, '{}', text)").alias("text"), "label")
    words = F.split("text", " ")
    thinned = fixed.where(F.size(words) > 6).select("label", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"), words.alias("w")).select(F.array_join(F.filter("w", lambda w, i: i % 7 != F.col("k")), " ").alias("text"), "label")
    sample = bounded_sample(docs.select(F.xxhash64(text).alias("__at"), F.col(text).alias("text")).where("text IS NOT NULL"), "__at", most_rows, "licence")
    plain = paragraphs_of(sample.select("text"), "text").select(F.col("paragraph").alias("text"), F.lit(len(classes) - 1).alias("label")).distinct()
    alike = F.greatest(*[template_overlap("__grams", F.lit(c)) for c in TEMPLATES])
    plain = checkpoint(plain.withColumn("__grams", _grams(_words(F.col("text"))))).where(alike < 1 / 3).select("text", "label")
    rows = framed.unionByName(thinned).unionByName(plain)
    return rows.withColumn("fold", F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(5)))


def train_licenses(docs: DataFrame, most_rows: int = 200, text: str = "text", false_rate: float = 0.01) -> LicenseModel:
    """Fits on four folds of the training rows and calibrates the threshold on the fifth.

    The threshold is the highest family probability that at most `false_rate` of the
    held-out paragraphs of no family exceed, and at least 0.5. `most_rows` bounds the
    texts of the corpus whose paragraphs the fit sees.
    """
    spark = docs.sparkSession
    rows = checkpoint(with_runs(_training_rows(spark, docs, most_rows, text), "text"))  # the paragraphs of most_rows texts
    classes = [*TEMPLATES, OTHER, NONE]
    often = rows.where(F.col("label") < len(classes) - 1).select(F.explode(F.array_distinct("__runs")).alias("run")).groupBy("run").agg(F.count("*").alias("n")).where("n > 1")
    vocabulary = [r["run"] for r in often.select("run").orderBy("run").collect()]  # n-grams of the notices above
    counts = {r["w"]: r["n"] for r in rows.where(F.col("label") == len(classes) - 1).select(F.explode("__words").alias("w")).where(F.col("w").isin(sorted({w for g in vocabulary for w in g.split(" ")}))).groupBy("w").agg(F.count("*").alias("n")).collect()}
    data = _vectors(spark, vocabulary).transform(rows).select(F.col("label").cast("double").alias("label"), "fold", F.col("__features").alias("features")).repartition(4).cache()
    fitted = LogisticRegression(family="multinomial", regParam=0.001, elasticNetParam=0.8, maxIter=40).fit(data.where("fold <> 0"))
    model = LicenseModel(classes, vocabulary, fitted, *_cue_bound(vocabulary, fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray(), counts), 0.5)
    held = score_paragraphs(rows.where(f"fold = 0 AND label >= {len(TEMPLATES)}").select("text"), model)
    found = held.agg(F.percentile(F.when(F.col("family").isin(*TEMPLATES), F.col("probability")).otherwise(0.0), 1 - false_rate)).first()[0]
    data.unpersist()
    model.threshold = max(0.5, float(found or 0.0))
    return model


def score_paragraphs(paragraphs: DataFrame, model: LicenseModel, text: str = "text") -> DataFrame:
    """paragraphs and the columns family (the class of the highest probability), probability and overlap (see template_overlap).

    Each paragraph is scored where it is; nothing is shuffled.
    """
    featured = _vectors(paragraphs.sparkSession, model.vocabulary).transform(with_runs(paragraphs, text))
    scored = model.regression.copy().setFeaturesCol("__features").setRawPredictionCol("").setProbabilityCol("__probability").setPredictionCol("").transform(featured)
    shares = scored.withColumn("__shares", vector_to_array("__probability")).withColumn("probability", F.array_max("__shares"))
    names = F.array(*map(F.lit, model.classes))
    named = shares.withColumn("family", F.element_at(names, F.array_position("__shares", F.col("probability")).cast("int")))
    overlap = F.when(F.col("family").isin(*TEMPLATES), template_overlap(_grams("__words"))).otherwise(F.lit(0.0))
    # out of a generator, so that filters on the results stay above it and don't compute all of this once more
    result = F.explode(F.array(F.struct("family", "probability", overlap.alias("overlap")))).alias("__result")
    return named.select(*[F.col(f"`{c}`") for c in paragraphs.columns], result).select(*[F.col(f"`{c}`") for c in paragraphs.columns], "__result.family", "__result.probability", "__result.overlap")


def template_overlap(grams: Column | str, family: Column | str = "family") -> Column:
    """The largest share of the word pairs of a template of the family that the paragraph has."""
    own = F.col(grams) if isinstance(grams, str) else grams
    of = F.col(family) if isinstance(family, str) else family
    cases = None
    for name, notices in TEMPLATES.items():
        shares = []
        for notice in notices:
            words = [w.strip(".+-") for w in re.split(r"[^a-z0-9.+-]+", notice.lower()) if w.strip(".+-")]
            pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
            shares.append(F.size(F.array_intersect(own, F.array(*map(F.lit, pairs)))) / F.lit(len(pairs)) if pairs else F.lit(0.0))
        share = F.greatest(*shares)
        cases = F.when(of == name, share) if cases is None else cases.when(of == name, share)
    return cases.otherwise(F.lit(0.0))


def license_paragraphs(docs: DataFrame, model: LicenseModel, confirm: float = 0.5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, block_no, line_no, paragraph, family, probability, confirmed) for the paragraphs that look like licences.

    See paragraphs_of for what is a paragraph. family is `unknown` for other licences, where the
    probability is under the model's threshold, or where no template of the family shares
    `confirm` of its word pairs; paragraphs of class none are left out. Null and empty texts have
    none; rows that repeat give their paragraphs each time; other columns are not read.
    """
    units = paragraphs_of(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")), "__text", model)
    scored = score_paragraphs(units, model, "paragraph").where(F.col("family") != NONE)
    confirmed = F.col("family").isin(*TEMPLATES) & (F.col("probability") >= model.threshold) & (F.col("overlap") >= confirm)
    return scored.select("doc_id", "block_no", "line_no", "paragraph", F.when(confirmed, F.col("family")).otherwise(UNKNOWN).alias("family"), "probability", confirmed.alias("confirmed"))


def scan_licenses(docs: DataFrame, model: LicenseModel, confirm: float = 0.5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, families (sorted, distinct, comma-joined; empty if none), n_licenses and n_unknown paragraphs.

    A block counts by its confirmed lines where it has any, and once by itself
    otherwise. Rows that share an id share its result; null ids, like ids without a licence, have none.
    """
    found = license_paragraphs(docs, model, confirm, text, doc_id)
    line, known = F.col("line_no") > 0, F.col("confirmed")
    blocks = found.groupBy("doc_id", "block_no").agg(
        F.collect_set(F.when(known & line, F.col("family"))).alias("of_lines"), F.max(F.when(known & ~line, F.col("family"))).alias("of_block"),
        F.count_if(known & line).alias("known"), F.count_if(~known & line).alias("unknown"), F.count_if(~known & ~line).alias("whole"),
    )
    families = F.when(F.col("known") > 0, F.col("of_lines")).when(F.col("of_block").isNotNull(), F.array("of_block")).otherwise(F.array().cast("array<string>"))
    n_licenses = F.when(F.col("known") > 0, F.col("known")).otherwise(F.col("of_block").isNotNull().cast("bigint"))
    n_unknown = F.when(F.col("known") > 0, F.col("unknown")).when(F.col("of_block").isNotNull(), F.lit(0)).otherwise(F.greatest("unknown", "whole"))
    judged = blocks.select("doc_id", families.alias("families"), n_licenses.alias("n_licenses"), n_unknown.alias("n_unknown"))
    summed = judged.groupBy("doc_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("families")))), ",").alias("families"), F.sum("n_licenses").alias("n_licenses"), F.sum("n_unknown").alias("n_unknown"))
    ids = docs.select(F.col(doc_id).alias("doc_id"))
    return ids.join(summed, "doc_id", "left").select("doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_licenses", F.lit(0)).alias("n_licenses"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"))
