"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A multinomial logistic regression over words and word pairs (MLlib, on data frames) is
trained on perturbed notices of each licence family and, as the class ``unknown``, on
ordinary paragraphs of the corpus and on sentences that only sound like notices. Its
temperature is calibrated on held-out rows. A predicted family counts if the paragraph
also contains most words of one of the family's templates, its numbers among them. Short
forms, which are titles and SPDX identifiers, are told by their names alone. A notice may
be one line or wrapped over adjoining lines. Only data-frame expressions and MLlib's
models touch the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_sample, staged, text_or_empty

UNKNOWN = "unknown"
#: The usual notices of licence families.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "You can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("BSD", "Released under the BSD License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "You can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "You can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "You can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Sentences with words of notices that are none.
LOOKALIKES = (
    "The driver was asked for a license and registration.",
    "A fishing license is required for the public part of the lake.",
    "All rights reserved. No part of this publication may be reproduced without permission.",
    "Copyright of the images remains with the authors.",
    "This software is proprietary; a commercial license can be bought from the vendor.",
    "Permission to film in the museum was granted free of charge.",
    "The apache helicopter, version 2, was released in May.",
    "She studied at the MIT and works on general public health.",
    "The species was licensed for release under the terms of the treaty.",
    "Version 3 of the report was released under pressure from the public.",
    "Redistribution of income is permitted under the following conditions.",
    "The creative commons of the village are open to the public domain.",
)
_V = r"(?: version| v| license| licence)*"
_GNU = r"(?:gnu {0} general public(?: license| licence)|{1}){2} (?:v)?{3}(?:\.0)?(?: {4})?|{1}-?v?{3}(?:\.0)?(?:-only|-or-later)?"
#: Names of families, on words with single spaces between.
NAMES = (
    ("AGPL-3.0", _GNU.format("affero", "agpl", _V, "3", "19 november 2007")),
    ("Apache-2.0", rf"apache(?: software)?{_V} v?2(?:\.0)?(?: january 2004)?|apache-2\.0"),
    ("BSD", r"(?:(?:new|modified|simplified|revised) )?(?:[234][- ]clause )?bsd(?:[- ][234][- ]clause)?"),
    ("CC0-1.0", r"cc0(?:[- ]1\.0)?(?: universal)?|creative commons(?: zero)?(?: v1\.0| 1\.0| cc0 1\.0) universal"),
    ("CC-BY-4.0", r"cc[- ]by[- ]4\.0|creative commons attribution 4\.0"),
    ("CC-BY-NC-4.0", r"cc[- ]by-nc[- ]4\.0|creative commons attribution[- ]non-?commercial 4\.0"),
    ("CC-BY-SA-4.0", r"cc[- ]by-sa[- ]4\.0|creative commons attribution[- ]share-?alike 4\.0"),
    ("GPL-2.0", _GNU.replace("{0} ", "").format("", "gpl", _V, "2", "june 1991")),
    ("GPL-3.0", _GNU.replace("{0} ", "").format("", "gpl", _V, "3", "29 june 2007")),
    ("LGPL-3.0", _GNU.format("lesser", "lgpl", _V, "3", "29 june 2007")),
    ("MIT", r"mit|expat"),
    ("MPL-2.0", rf"mozilla public{_V} 2\.0|mpl{_V}[- ]2\.0"),
)
#: What a title may have besides names.
_FILLER = r"licen[cs]es?|licensed|under|the|terms|of|is|this|project|software|code|work|released|available|international|public"
#: A paragraph without any of these is no candidate: every template and title has one.
EVIDENCE = r"(?i)licen[cs]|permission|redistribut|\bpublic\s+domain\b|\bcreative\s+commons\b|\bcc0\b|\bcc[ -]by\b"
_TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


@dataclass(frozen=True)
class Model:
    vectorizer: CountVectorizerModel
    regression: LogisticRegressionModel
    families: tuple[str, ...]
    temperature: float


def tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def grams(words: str) -> Column:
    """The distinct words and word pairs of an array of words."""
    pairs = F.transform(F.col(words), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
    return F.array_distinct(F.concat(F.col(words), pairs))


def _training_rows(spark: SparkSession, docs: DataFrame, text_col: str, max_paragraphs: int, variants: int, seed: int) -> DataFrame:
    """``family, words, held``: each template and look-alike in ``variants`` forms that miss some
    words and have some foreign ones, and at most ``max_paragraphs`` corpus paragraphs."""
    fixed = spark.createDataFrame([*TEMPLATES, *((UNKNOWN, t) for t in LOOKALIKES)], "family string, text string")
    forms = fixed.select("family", tokens("text").alias("words"), F.explode(F.sequence(F.lit(0), F.lit(variants - 1))).alias("form"))
    chance = lambda w, i, salt: F.pmod(F.xxhash64(w, i, F.col("form"), F.lit(seed + salt)), F.lit(100))
    missing = F.filter("words", lambda w, i: (F.col("form") == 0) | (chance(w, i, 0) >= 8))
    foreign = F.transform("words", lambda w, i: F.concat(F.lit("word"), F.xxhash64(w, i, "form").cast("string")))
    foreign = F.slice(foreign, 1, F.pmod(F.col("form"), F.lit(4)))
    fixed = forms.select("family", F.concat(missing, foreign).alias("words"), (F.pmod("form", F.lit(5)) == 4).alias("held"))
    # About as many texts as paragraphs are wanted, each once; then the same of their lines.
    own = docs.select(F.col(text_col).alias("text")).where("text is not null")
    number = max(1, docs.count())
    own = own.where(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(number)) < max_paragraphs).distinct()
    lines = own.select(F.explode(F.split("text", "\n")).alias("text")).where(F.length("text") > 0).where(~F.col("text").rlike(EVIDENCE))
    lines = bounded_sample(lines.distinct(), ["text"], max_paragraphs, seed).withColumn("order", F.xxhash64("text"))
    lines = lines.select(F.lit(UNKNOWN).alias("family"), tokens("text").alias("words"), (F.pmod("order", F.lit(5)) == 4).alias("held"))
    return fixed.unionByName(lines)


def train(
    docs: DataFrame, text_col: str = "text", max_paragraphs: int = 1000, variants: int = 40, vocabulary: int = 4096, seed: int = 11
) -> Model:
    """Fits on the fixed notices and at most ``max_paragraphs`` paragraphs of the corpus, chosen
    by seeded hash; the bound and ``vocabulary`` keep the model small. An empty corpus only
    lacks those paragraphs."""
    rows = _training_rows(docs.sparkSession, docs, text_col, max_paragraphs, variants, seed)
    families = tuple(sorted({f for f, _ in TEMPLATES})) + (UNKNOWN,)
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    rows = staged(rows.select(label.cast("double").alias("label"), grams("words").alias("grams"), "held"), "notices")
    seen = rows.where("not held")
    vectorizer = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=vocabulary, minDF=2).fit(seen)
    regression = LogisticRegression(regParam=0.0005, elasticNetParam=0.5, maxIter=60, family="multinomial")
    fitted = regression.fit(vectorizer.transform(seen))
    held = fitted.transform(vectorizer.transform(rows.where("held"))).select("label", vector_to_array("rawPrediction").alias("raw"))
    trials = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]
    loss = lambda t: F.avg(-F.log(F.greatest(F.get(_softmax("raw", t), F.col("label").cast("int")), F.lit(1e-9))))
    losses = held.agg(*(loss(t).alias(str(i)) for i, t in enumerate(trials))).first()
    known = [(value, t) for value, t in zip(losses, trials) if value is not None]
    return Model(vectorizer, fitted, families, min(known)[1] if known else 1.0)


def _softmax(raw: str, temperature: float) -> Column:
    scaled = F.transform(raw, lambda x: F.exp((x - F.array_max(raw)) / temperature))
    total = F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x)
    return F.transform(scaled, lambda x: x / total)


def stated(words: str) -> Column:
    """The family that an array of words names: after ``SPDX-License-Identifier``, or as a title,
    which is names of one family and fillers only. Else null."""
    text = F.array_join(words, " ")
    title = text.rlike("licen[cs]|^creative commons|^cc")
    marks = []
    for family, name in NAMES:
        marks.append(F.when(text.rlike(rf"(?:^| )spdx-license-identifier (?:{name})(?: |$)"), family))
        marks.append(F.when(title & text.rlike(rf"^(?:(?:{_FILLER}) )*(?:{name})(?: (?:{_FILLER}|{name}))*$"), family))
    return F.coalesce(*marks)


def classify(paragraphs: DataFrame, model: Model, min_probability: float = 0.5, min_overlap: float = 0.8) -> DataFrame:
    """Adds ``family, probability`` to rows with a column ``paragraph``.

    The family is ``unknown`` if the most probable one is, has less than
    ``min_probability``, or has no template of whose distinct words the paragraph contains
    ``min_overlap``, and all numbers. A paragraph that states its family by name has that
    one, with probability 1.
    """
    rows = paragraphs.withColumn("words", tokens("paragraph")).withColumn("grams", grams("words"))
    scored = model.regression.transform(model.vectorizer.transform(rows))
    scored = scored.withColumn("raw", vector_to_array("rawPrediction")).withColumn("chances", _softmax("raw", model.temperature))
    scored = scored.withColumn("probability", F.array_max("chances"))
    best = F.get(F.array(*map(F.lit, model.families)), F.array_position("chances", F.col("probability")).cast("int") - 1)
    alike = [
        (F.col("best") == family)
        & (F.size(F.array_intersect("words", own)) >= F.size(own) * min_overlap)
        & (F.size(F.array_except(F.filter(own, lambda w: w.rlike(r"^[0-9.]+$")), "words")) == 0)
        for family, own in ((f, F.array_distinct(tokens(F.lit(t)))) for f, t in TEMPLATES)
    ]
    sure = (F.col("probability") >= min_probability) & F.array_contains(F.array(*alike), True)
    scored = scored.withColumn("best", best).withColumn("named", stated("words"))
    scored = scored.withColumn("family", F.when(F.col("named").isNotNull(), F.col("named")).when(sure, F.col("best")).otherwise(UNKNOWN))
    scored = scored.withColumn("probability", F.when(F.col("named").isNotNull(), 1.0).otherwise(F.col("probability")))
    return scored.select(*paragraphs.columns, "family", "probability")


def _wrapped(lines: DataFrame, inner: int = 60, reach: int = 40) -> DataFrame:
    """``id, hash, first, last, paragraph``: the adjoining lines that could be one wrapped notice.

    ``lines`` has ``id, hash, line, paragraph``. A line without words ends a run. A notice is
    at most ``inner`` words on its lines between the first and the last, of which it has the
    last and the first ``reach`` words; templates are shorter.
    """
    rows = lines.withColumn("words", tokens("paragraph")).withColumn("n", F.size("words")).where("n > 0")
    # Of a long line only its ends can belong to a notice that goes on.
    ends = F.concat(F.slice("words", 1, reach), F.slice("words", -reach, reach))
    rows = rows.withColumn("words", F.when(F.col("n") > 2 * reach, ends).otherwise(F.col("words")))
    order = Window.partitionBy("id", "hash").orderBy("line")
    rows = rows.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    following = F.collect_list(F.struct("line", "n", "upto", "words")).over(order.rowsBetween(0, inner + 1))
    rows = rows.withColumn("next", following)
    more = F.filter("next", lambda e, k: (k > 0) & (e["line"] == F.col("line") + k) & (e["upto"] - e["n"] - F.col("upto") <= inner))
    rows = rows.select("id", "hash", "line", "words", "next", F.explode(F.transform(more, lambda e: e["line"])).alias("last"))
    between = F.flatten(F.transform(F.slice("next", F.lit(2), F.col("last") - F.col("line") - 1), lambda e: e["words"]))
    tail = F.slice("words", -F.least(F.size("words"), F.lit(reach)), F.lit(reach))
    head = F.slice(F.get("next", F.col("last") - F.col("line"))["words"], 1, reach)
    text = F.array_join(F.concat(tail, between, head), " ")
    rows = rows.select("id", "hash", F.col("line").alias("first"), "last", text.alias("paragraph"))
    return rows.where(F.col("paragraph").rlike(EVIDENCE))


def _noticed(found: DataFrame) -> DataFrame:
    """Of classified lines and wrapped paragraphs, ``id, hash, line, family, probability``: the
    shortest that have a family, and the unknown lines outside of them."""
    own = Window.partitionBy("id", "hash")
    known = found.where(F.col("family") != UNKNOWN)
    best = F.row_number().over(Window.partitionBy("id", "hash", "first").orderBy("last"))
    known = known.withColumn("rank", best).where("rank = 1").drop("rank")
    later = F.min("last").over(own.orderBy("first").rowsBetween(1, Window.unboundedFollowing))
    known = known.withColumn("later", later).where("later is null or later > last").drop("later")
    # Paragraphs of a family that overlap are one notice, at the first of them.
    before = F.lag("last").over(Window.partitionBy("id", "hash", "family").orderBy("first"))
    known = known.withColumn("goes_on", F.coalesce(before >= F.col("first"), F.lit(False)))
    lines = found.where((F.col("family") == UNKNOWN) & (F.col("first") == F.col("last"))).withColumn("goes_on", F.lit(False))
    every = known.unionByName(lines)
    reached = F.max(F.when(F.col("family") != UNKNOWN, F.col("last"))).over(own.orderBy("first").rangeBetween(Window.unboundedPreceding, 0))
    every = every.withColumn("reached", reached)
    every = every.where((F.col("family") != UNKNOWN) | F.col("reached").isNull() | (F.col("reached") < F.col("first")))
    return every.where(~F.col("goes_on")).select("id", "hash", F.col("first").alias("line"), "family", "probability")


def find_licences(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_probability: float = 0.5,
    min_overlap: float = 0.8,
) -> DataFrame:
    """``doc_id, n_paragraphs, notices`` for every row of ``docs``.

    Paragraphs are lines with a character other than white space. ``notices`` is an array
    of structs ``line, family, probability``, by line, of the paragraphs with a word of
    ``EVIDENCE``; ``unknown`` ones included. A notice wrapped over adjoining lines, none of
    which is one by itself, counts once, at its first line, instead of its lines. A null text has none. Rows that repeat id and
    text get equal results, a null id is an id like any other, other columns are not read.
    Each line is classified by itself, whole. An empty table yields an empty result.
    """
    split = F.split(text_or_empty(text_col), "\n")
    numbered = F.transform(split, lambda line, i: F.struct(i.alias("line"), line.alias("paragraph")))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("hash"),
        F.size(F.filter(split, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))).cast("long").alias("n_paragraphs"),
        F.when(F.col(text_col).rlike(EVIDENCE), numbered).alias("candidates"),
    )
    rows = staged(rows, "candidates")
    each = rows.select("id", "hash", F.explode("candidates").alias("c")).select("id", "hash", "c.line", "c.paragraph")
    each = each.dropDuplicates(["id", "hash", "line"])
    single = each.where(F.col("paragraph").rlike(EVIDENCE)).select("id", "hash", F.col("line").alias("first"), F.col("line").alias("last"), "paragraph")
    paragraphs = staged(single.unionByName(_wrapped(each)), "paragraphs")
    found = _noticed(staged(classify(paragraphs, model, min_probability, min_overlap), "classified"))
    notice = F.struct("line", "family", "probability")
    found = found.groupBy(F.col("id").alias("of"), F.col("hash").alias("of_hash")).agg(F.array_sort(F.collect_list(notice)).alias("notices"))
    both = rows.join(found, F.expr("id <=> of") & (F.col("hash") == F.col("of_hash")), "left")
    none = F.array().cast(found.schema["notices"].dataType)
    return both.select(F.col("id").alias("doc_id"), "n_paragraphs", F.coalesce("notices", none).alias("notices"))
