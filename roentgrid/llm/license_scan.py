"""Licence notices by a trained paragraph classifier.

Paragraphs (lines) are bags of word n-grams. A multinomial logistic regression with sparse
weights is fitted on notices of each family and on paragraphs of the corpus as the unknown
class; a second regression on held-back rows calibrates how sure it is that a paragraph is
a notice at all. A prediction counts once the paragraph also holds most n-grams of one of
the family's templates, and most of those that no other family's templates have. Column functions and joins only; only bounded tables are broadcast.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stored
from .common import row_key, whole_text

# Notices as their licences word them, by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache License 2.0.",
        "Distributed under the terms of the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This software is distributed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "Released under the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without permission.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ],
}
UNKNOWN = "unknown"
FAMILIES = [*TEMPLATES, UNKNOWN]
# Bounds of the sample of paragraphs that stands for the unknown class.
DOCUMENTS, PARAGRAPHS = 400, 4_000
# A word in more than this share of the sample's paragraphs is no sign of a notice.
COMMON = 0.02
SURE, CONFIRMED = 0.5, 0.6


def words(text: Column) -> Column:
    """Lower-case words of letters and digits; a version such as 2.0 is one word."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:\.[0-9]+)*"), F.lit(0))


def ngrams(ws: Column) -> Column:
    """Distinct word n-grams, n = 1, 2, 3."""
    two = F.zip_with(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 2, F.size(ws)), lambda a, b: F.concat_ws(" ", a, b))
    three = F.zip_with(F.slice(two, 1, F.greatest(F.size(two) - 1, F.lit(0))), F.slice(ws, 3, F.size(ws)), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(ws, two, three))


def paragraphs(docs: DataFrame, signs: list[str] | None = None) -> DataFrame:
    """(__key, line, ws): paragraphs with words; given ``signs``, those that hold one of these words.

    Documents without any of the words are left before their lines are cut.
    """
    rows = docs.select(row_key().alias("__key"), whole_text().alias("__text"))
    if signs is not None:
        held = F.array(*map(F.lit, signs))
        rows = rows.where(F.arrays_overlap(words(F.col("__text")), held))
    lines = rows.select("__key", F.posexplode(F.split("__text", "\n")).alias("line", "__line"))
    lines = lines.select("__key", "line", words(F.col("__line")).alias("ws")).where(F.size("ws") > 0)
    return lines if signs is None else lines.where(F.arrays_overlap("ws", held))


def notices(spark) -> DataFrame:
    """(family, ws) of every template; a fixed table."""
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    return spark.createDataFrame(rows, "family string, text string").select("family", words(F.col("text")).alias("ws"))


def strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


class Model:
    """Weights of n-grams as a bounded table (gram, w), constants, calibration, signs and templates by family."""

    def __init__(self, weights: DataFrame, constants: list[float], signs: list[str], templates: dict[str, list[list[str]]]):
        self.weights, self.constants, self.signs, self.templates = weights, constants, signs, templates
        self.slope, self.shift = 1.0, 0.0

    def likeness(self, grams: Column, families: list[str]) -> Column:
        """Largest share of a template's n-grams, over the given families, that a paragraph holds."""
        shares = [F.size(F.array_intersect(strings(t), grams)) / len(t) for f in families for t in self.templates[f]]
        return F.greatest(F.lit(0.0), *shares)


def logits(rows: DataFrame, by: list[str], model: Model) -> DataFrame:
    """(by..., z, grams): score of every family and the unknown, for rows with any weighted n-gram."""
    grams = rows.select(*by, F.explode(ngrams(F.col("ws"))).alias("gram")).join(F.broadcast(model.weights), "gram")
    sums = [(F.sum(F.col("w")[i]) + c).alias(f"z{i}") for i, c in enumerate(model.constants)]
    found = grams.groupBy(*by).agg(*sums, F.collect_list("gram").alias("grams"))
    return found.select(*by, F.array(*[f"z{i}" for i in range(len(sums))]).alias("z"), "grams")


def ahead(z: Column) -> Column:
    """How far the best family is ahead of the unknown class."""
    return F.array_max(F.slice(z, 1, len(TEMPLATES))) - z[len(TEMPLATES)]


def learn(docs: DataFrame) -> Model:
    """Classifier of notices against a bounded sample of the corpus' own paragraphs."""
    spark = docs.sparkSession
    known = notices(spark)
    templates: dict[str, list[list[str]]] = {}
    for row in known.select("family", ngrams(F.col("ws")).alias("grams")).collect():
        templates.setdefault(row["family"], []).append(row["grams"])
    ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(DOCUMENTS)
    lines = paragraphs(docs.join(F.broadcast(ids), "doc_id", "left_semi")).orderBy(F.xxhash64("ws"), "line").limit(PARAGRAPHS)
    blank = Model(None, [], [], templates)
    # The sample may hold notices itself; they are no examples of the unknown.
    sample = stored(lines.where(blank.likeness(ngrams(F.col("ws")), list(TEMPLATES)) < 0.5).select("ws"), "paragraphs")
    total = sample.count()
    words_of = sample.select(F.explode(F.array_distinct("ws")).alias("word")).groupBy("word").count()
    common = {r["word"] for r in words_of.where(F.col("count") > COMMON * total).collect()}
    grams = {g for family in templates.values() for t in family for g in t}
    signs = sorted(g for g in grams if " " not in g and g not in common)
    # An n-gram of common words only has no weight, so paragraphs without a sign need no scoring.
    vocabulary = sorted(g for g in grams if any(w not in common for w in g.split(" ")))
    n = F.size("ws")
    forms = F.array(F.col("ws"), F.slice("ws", 1, F.ceil(n * 2 / 3).cast("int")), F.slice("ws", F.floor(n / 3).cast("int") + 1, n))
    label = F.array_position(strings(FAMILIES), F.col("family")).cast("double") - 1
    shown = known.select(label.alias("label"), F.posexplode(forms).alias("form", "ws"))
    others = sample.select(F.lit(len(TEMPLATES) * 1.0).alias("label"), F.pmod(F.xxhash64("ws"), F.lit(3)).cast("int").alias("form"), "ws")
    # Both kinds weigh alike, however many paragraphs the sample has.
    balance = F.when(F.col("label") == len(TEMPLATES), 100.0 / max(total, 1)).otherwise(1.0)
    rows = stored(shown.unionByName(others).withColumns({"weight": balance, "grams": ngrams(F.col("ws")), "row": F.monotonically_increasing_id()}), "notices")
    bag = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "x")
    fit = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", family="multinomial", regParam=2e-3, standardization=False)
    fitted = fit.fit(bag.transform(rows.where("form < 2")))
    matrix, constants = fitted.coefficientMatrix.toArray().tolist(), fitted.interceptVector.toArray().tolist()
    if len(constants) == len(TEMPLATES):  # an empty sample: nothing speaks for the unknown
        matrix, constants = [*matrix, [0.0] * len(vocabulary)], [*constants, 0.0]
    table = spark.createDataFrame([(g, [w[i] for w in matrix]) for i, g in enumerate(vocabulary)], "gram string, w array<double>")
    model = Model(table, constants, signs, templates)
    # Calibrated on the rows held back: is it a notice, given how far ahead the best family is?
    held = logits(rows.where("form = 2"), ["row", "label", "weight"], model)
    held = held.select((F.col("label") < len(TEMPLATES)).cast("double").alias("label"), "weight", array_to_vector(F.array(ahead(F.col("z")))).alias("x"))
    held = stored(held, "held")
    if held.select("label").distinct().count() == 2:
        line = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=1e-2).fit(held)
        if line.coefficients[0] > 0:
            model.slope, model.shift = float(line.coefficients[0]), float(line.intercept)
    return model


def scan(docs: DataFrame, model: Model, sure: float = SURE, confirmed: float = CONFIRMED) -> DataFrame:
    """(__key, line, family, confidence, likeness): paragraphs predicted to be notices and confirmed by a template.

    ``confidence`` is the calibrated probability that the paragraph is no unknown one, and
    ``likeness`` the share of the nearest template of the family that it holds. What notices
    of several families share, such as the words in front of an identifier, confirms none of
    them: the family's own n-grams in a template have to be held alike.
    """
    found = logits(paragraphs(docs, model.signs).dropDuplicates(["__key", "line"]), ["__key", "line"], model)
    place = F.array_position(F.slice("z", 1, len(TEMPLATES)), F.array_max(F.slice("z", 1, len(TEMPLATES)))).cast("int")
    confidence = 1 / (1 + F.exp(-(ahead(F.col("z")) * model.slope + model.shift)))
    found = found.select("__key", "line", strings(TEMPLATES)[place - 1].alias("family"), confidence.alias("confidence"), "grams")
    found = found.where(F.col("confidence") >= sure)
    # Templates are compared by their weighted n-grams, those with a sign.
    weighted = {f: [[g for g in t if any(w in model.signs for w in g.split(" "))] for t in ts] for f, ts in model.templates.items()}
    grams_of = {f: {g for t in ts for g in t} for f, ts in weighted.items()}

    def held(family: str) -> Column:
        others = set().union(*(grams for f, grams in grams_of.items() if f != family))
        shares = [F.lit(0.0)]
        for t in weighted[family]:
            parts = [part for part in (t, [g for g in t if g not in others]) if part]
            if len(parts) == 2:
                shares.append(F.least(*[F.size(F.array_intersect(strings(part), F.col("grams"))) / len(part) for part in parts]))
        return F.greatest(*shares, F.lit(0.0))

    likeness = F.coalesce(*[F.when(F.col("family") == f, held(f)) for f in TEMPLATES])
    return found.select("__key", "line", "family", "confidence", likeness.alias("likeness")).where(F.col("likeness") >= confirmed)


def licenses(docs: DataFrame, model: Model) -> DataFrame:
    """Per document row: (doc_id, license, licenses, n_notices, confidence).

    ``licenses`` lists the families found, sorted; ``license`` is that of the surest notice
    (ties: the first line), "unknown" without any. Null and empty texts have none, repeated
    rows are judged alike, an empty table gives no rows.
    """
    best = F.max_by("family", F.struct("confidence", -F.col("line")))
    found = scan(docs, model).groupBy("__key").agg(
        best.alias("license"), F.array_sort(F.collect_set("family")).alias("licenses"), F.count("*").alias("n_notices"), F.max("confidence").alias("confidence")
    )
    rows = docs.select("doc_id", row_key().alias("__key")).join(found, "__key", "left")
    return rows.select(
        "doc_id", F.coalesce("license", F.lit(UNKNOWN)).alias("license"), F.coalesce("licenses", strings([])).alias("licenses"),
        F.coalesce("n_notices", F.lit(0).cast("long")).alias("n_notices"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )
