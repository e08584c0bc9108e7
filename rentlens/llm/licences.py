"""Licence scans: a trained classifier of passages, confirmed by comparison with templates.

A paragraph is what stands between blank lines, so a wrapped notice is whole in it. It is read
in overlapping windows, and in every window the stretch that holds pairs of a template is a
passage. A multinomial logistic regression over sparse word n-grams tells licence families
and the unknown class apart; the unknown class and the least probability come from ordinary
passages, which hold pairs of a template too but few of them. A prediction stands only if
the passage holds enough of a template of that family. What a template is compared by are
its word pairs with content, so a window without any such pair cannot be confirmed and needs
no score: this filter is exact. The main path is column expressions, joins and aggregates.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens.llm.common import join_small, lower_az, staged

UNKNOWN = "unknown"

# Sentences by which licences are commonly announced or which open their text.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Except where otherwise noted, content on this site is licensed under CC BY-SA 4.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "proprietary": [
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "Proprietary and confidential.",
    ],
}

# Words without content; a pair of two of them is not compared.
FUNCTION_WORDS = (
    "a all an and any are as at be by for from has have in is it its may not of on or that the"
    " this to under was were will with you"
).split()

#: Least share of a template's content pairs that a passage must hold, and the share below
#: which a passage counts as ordinary text.
LEAST_SHARE, ORDINARY_SHARE = 0.6, 0.3

#: Length of a window in words of its template: room for names, dates and comment marks.
ROOM = 1.5

#: Share of the ordinary passages held back from training that may pass the calibrated
#: probability, and the accuracy of that quantile: a rank is off by a millionth of the passages.
PASS_RATE = 0.001
ACCURACY = 1_000_000
LEAST_PROBABILITY = 0.5

BETWEEN = r"[\x00-\x2C\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words in lower case; points and hyphens inside stay, outside they go."""
    parts = F.transform(F.split(lower_az(text), BETWEEN), lambda w: F.trim(w, F.lit(".-")))
    return F.filter(parts, lambda w: w != "")


def _grams(words: str, n: int) -> Column:
    last = F.size(words) - n
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice(words, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def templates(spark: SparkSession) -> DataFrame:
    """``family, template, words, pairs, room``; pairs are the distinct content pairs."""
    rows = [(f, i, t) for f, ts in TEMPLATES.items() for i, t in enumerate(ts)]
    table = spark.createDataFrame(rows, "family string, template int, text string")
    worded = table.withColumn("words", words_of(F.col("text")))
    pairs = F.array_distinct(F.filter(_grams("words", 2), _has_content))
    room = F.ceil(F.size("words") * ROOM).cast("int")
    return worded.withColumn("pairs", pairs).withColumn("room", room).drop("text")


def _has_content(pair: Column) -> Column:
    return ~F.forall(F.split(pair, " "), lambda w: w.isin(FUNCTION_WORDS))


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``row, key, paragraph, words``: what stands between the blank lines of every text."""
    blocks = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\n\s*\n"), lambda p: p.rlike(r"\S"))
    one = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), blocks.alias("blocks"))
    spread = one.select("row", "key", F.posexplode("blocks").alias("paragraph", "block"))
    return spread.select("row", "key", "paragraph", words_of(F.col("block")).alias("words"))


def _with_hits(worded: DataFrame, pairs: list[str]) -> DataFrame:
    """Adds ``hits``: place (from 0) and pair of every template pair in ``words``."""
    after = F.slice("words", 2, F.greatest(F.size("words"), F.lit(1)))
    # The last word has no word after it, and so no pair: null is in no list.
    joined = F.zip_with("words", after, lambda a, b: F.concat(a, F.lit(" "), b))
    placed = F.transform("grams", lambda g, i: F.when(g.isin(pairs), F.struct(i.alias("at"), g.alias("pair"))))
    graded = worded.withColumn("grams", joined)
    return graded.withColumn("hits", F.filter(placed, lambda h: h.isNotNull())).drop("grams")


def windows(docs: DataFrame, key: str, text: str, pairs: list[str], step: int) -> DataFrame:
    """``row, key, paragraph, words``: windows of ``2 * step`` words that hold a template pair.

    A window begins at every ``step``-th word, so any ``step + 1`` words in a row are in one.
    """
    held = _with_hits(paragraphs(docs, key, text), pairs)
    first = F.transform("hits", lambda h: F.floor(h["at"] / step).cast("int"))
    begun = F.array_distinct(F.concat(first, F.transform(first, lambda w: F.greatest(w - 1, F.lit(0)))))
    cut = F.transform("begun", lambda w: F.slice("words", w * step + 1, 2 * step))
    numbered = held.select("row", "key", "paragraph", "words", begun.alias("begun"))
    return numbered.select("row", "key", "paragraph", F.explode(cut).alias("words"))


def passages(distinct: DataFrame, known: DataFrame, pairs: list[str]) -> DataFrame:
    """``id, wanted, similarity, words``: by template, the stretch of a window from its first pair to its last.

    A stretch spans twice the template's room at most, and any that fits its room is found.
    """
    wanted = known.select(
        F.col("family").alias("wanted"), "template", "room", F.size("pairs").alias("n"), F.explode("pairs").alias("pair")
    )
    hits = _with_hits(distinct, pairs).select("id", F.explode("hits").alias("hit")).select("id", "hit.*")
    # The pairs of the templates: a few hundred rows.
    by_template = hits.join(F.broadcast(wanted), "pair")
    place = F.floor(F.col("at") / F.col("room")).cast("int")
    spread = by_template.withColumn("part", F.explode(F.array_distinct(F.array(place, F.greatest(place - 1, F.lit(0))))))
    found = spread.groupBy("id", "wanted", "template", "n", "part").agg(
        F.size(F.collect_set("pair")).alias("held"), F.min("at").alias("low"), F.max("at").alias("high")
    )
    return found.join(distinct.select("id", F.col("words").alias("whole")), "id").select(
        "id", "wanted", (F.col("held") / F.col("n")).alias("similarity"),
        F.slice("whole", F.col("low") + 1, F.col("high") - F.col("low") + 2).alias("words"),
    )


def _train(ordinary: DataFrame, known: DataFrame):
    """Weights of every n-gram by class, class names and intercepts."""
    spark = known.sparkSession
    # The least part of a notice that is confirmed stands for notices that are cut or reworded.
    part = F.ceil(F.size("words") * LEAST_SHARE).cast("int")
    last = F.slice("words", F.size("words") - part + 1, part)
    cut = known.select("family", F.explode(F.array("words", F.slice("words", 1, part), last)).alias("words"))
    labelled = cut.union(ordinary.select(F.lit(UNKNOWN), "words"))
    ready = staged(labelled.withColumn("grams", F.concat("words", _grams("words", 2))))
    names = [UNKNOWN, *TEMPLATES]
    index = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("family")) - 1
    counted = CountVectorizer(inputCol="grams", outputCol="features", minDF=1, binary=True).fit(
        ready.join(F.broadcast(known.select("family").distinct()), "family", "left_semi")
    )
    # Every class weighs the same, however many ordinary passages there are.
    sizes = ready.groupBy("family").agg((1 / F.count(F.lit(1))).alias("weight"))
    train = counted.transform(ready).join(F.broadcast(sizes), "family").withColumn("label", index.cast("double"))
    model = LogisticRegression(
        family="multinomial", regParam=1e-3, elasticNetParam=0.1, maxIter=60, weightCol="weight"
    ).fit(train)
    weights = model.coefficientMatrix.toArray().tolist()
    rows = [(g, [float(w[i]) for w in weights]) for i, g in enumerate(counted.vocabulary)]
    table = spark.createDataFrame([r for r in rows if any(r[1])], "gram string, weights array<double>")
    return table, names[: len(weights)], [float(x) for x in model.interceptVector.toArray()]


def _scored(candidates: DataFrame, weights: DataFrame, names: list[str], intercepts: list[float], on: list[str]) -> DataFrame:
    """Adds ``family`` and ``probability`` of the likeliest class to distinct ``on`` rows."""
    grams = candidates.select(*on, F.explode(F.array_distinct(F.concat("words", _grams("words", 2)))).alias("gram"))
    # The vocabulary of the templates: a few hundred rows.
    found = grams.join(F.broadcast(weights), "gram")
    sums = found.groupBy(*on).agg(
        *[F.sum(F.element_at("weights", i + 1)).alias(f"__w{i}") for i in range(len(names))]
    )
    logits = F.array(*[F.coalesce(F.col(f"__w{i}"), F.lit(0.0)) + b for i, b in enumerate(intercepts)])
    scored = candidates.join(sums, on, "left").withColumn("__logits", logits)
    top = F.array_max("__logits")
    total = F.aggregate("__logits", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("__logits")))
    place = F.array_position("__logits", top).cast("int")
    return (
        scored.withColumn("probability", 1 / total)
        .withColumn("family", F.element_at(F.array(*[F.lit(n) for n in names]), place))
        .drop("__logits", *[f"__w{i}" for i in range(len(names))])
    )


def _ordinary(candidates: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    """``words, half``: the passages of all windows, none of them part of a notice.

    A paragraph that holds enough of a template anywhere gives none, nor does a window that
    holds as much as ordinary text does not. A hash says which half trains; the other one
    calibrates.
    """
    most = staged(found.groupBy("id").agg(F.max("similarity").alias("most")).join(distinct, "id"))
    noticed = join_small(candidates, staged(most.where(F.col("most") >= LEAST_SHARE).select("words")), ["words"], "left_semi")
    noticed = staged(noticed.select("row", "paragraph").distinct())
    # As many windows as there are texts may be left, each of a hundred words: no hint to broadcast them.
    quiet = join_small(candidates, noticed, ["row", "paragraph"], "left_anti").select("words").distinct()
    ids = staged(most.where(F.col("most") < ORDINARY_SHARE).join(quiet, "words", "left_semi").select("id"))
    texts = join_small(found, ids, ["id"], "left_semi").select("words").distinct()
    return staged(texts.withColumn("half", F.pmod(F.xxhash64("words", F.lit(1)), F.lit(2))))


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per paragraph and family it announces: key, paragraph, family, probability, similarity.

    Paragraphs stand between blank lines and are counted from 0. Null and empty texts have
    none; repeated rows are reported each; an empty table gives an empty result. Of several
    passages of a family the most similar one is reported. A passage whose likeliest family
    is unknown, is not probable enough, or is not confirmed by a template has no row.
    """
    known = staged(templates(docs.sparkSession))
    pairs = [r["pair"] for r in known.select(F.explode("pairs").alias("pair")).distinct().collect()]
    step = known.agg(F.max("room")).first()[0]
    candidates = staged(windows(docs, key, text, pairs, step))
    # Windows repeat across documents, so each distinct one is compared once.
    distinct = staged(candidates.select("words").distinct().withColumn("id", F.monotonically_increasing_id()))
    found = staged(passages(distinct, known, pairs))
    near = found.where(F.col("similarity") >= LEAST_SHARE)
    ordinary = _ordinary(candidates, distinct, found)
    weights, names, intercepts = _train(ordinary.where("half = 0").select("words"), known)
    held = ordinary.where("half = 1").withColumn("id", F.monotonically_increasing_id())
    calibration = _scored(staged(held), weights, names, intercepts, ["id"])
    limit = calibration.select(
        F.percentile_approx(
            F.when(F.col("family") != UNKNOWN, F.col("probability")).otherwise(0.0), 1 - PASS_RATE, ACCURACY
        )
    ).first()[0]
    least = max(LEAST_PROBABILITY, limit or 0.0)
    texts = staged(near.select("words").distinct().withColumn("text_id", F.monotonically_increasing_id()))
    judged = _scored(texts, weights, names, intercepts, ["text_id"]).where(
        (F.col("family") != UNKNOWN) & (F.col("probability") >= least)
    )
    best = F.max(F.struct("similarity", "probability")).alias("best")
    confirmed = (
        near.join(judged.select("words", "family", "probability"), "words")
        .where(F.col("family") == F.col("wanted"))
        .groupBy("id", "family")
        .agg(best)
        .join(distinct, "id")
        .select("words", "family", "best.*")
    )
    reported = join_small(candidates, staged(confirmed), ["words"], "inner")
    one = reported.groupBy("row", "key", "paragraph", "family").agg(best)
    return one.select(
        F.col("key").alias(key), F.col("paragraph").cast("long").alias("paragraph"), "family",
        F.round("best.probability", 6).alias("probability"), F.round("best.similarity", 6).alias("similarity"),
    )
