"""Licence scans: a trained paragraph classifier, confirmed by templates.

Paragraphs (lines of a text, and runs of lines) are sets of word n-grams (1 to 3 words) from the
vocabulary of the licence templates; an n-gram counts only if it holds a word
that is not a stop word.  Multinomial logistic regression over these sparse
features gives each licence family and ``unknown`` a probability.  It is
trained here: on every template, on the templates with one word left out, on
pieces of templates and fixed sentences that grant nothing (unknown), and on at
most ``max_unknown`` corpus paragraphs that share words with a template but
less than a third of its trigrams (unknown; those with the smallest hash).

The probabilities are calibrated on held-out examples (temperature with the
least log loss).  A paragraph is reported when a family is likelier than
unknown and the others together and it shares at least ``MIN_SIMILARITY`` of the
trigrams of a template of that family (``confirmed``).

Notices are also wrapped over several lines.  In a document that holds half of the
trigrams of a template, every run of 2 to ``max_lines`` lines with words, at most
``max_inner`` words between its first and its last line, is classified and confirmed
as one paragraph (parameters of ``scan``; no line is empty, so ``max_inner + 2`` lines set
no bound of their own).  Of overlapping runs and lines the one most like its template is
reported, then the shortest; ``line`` is its first line, and its line feeds are spaces.
A line inside such a run that is less like its own template is not reported as well.
Lines without words part paragraphs.

A paragraph without any n-gram of the vocabulary is unknown by construction
and is left out early.  Everything is a Spark expression or a Spark ML stage.

Rows: null and empty texts have no paragraphs.  Repeated documents give
repeated rows.  A null ``doc_id`` is kept.  An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import materialise, text_or_empty

MAX_UNKNOWN = 2_000
MIN_SIMILARITY = 0.5
# a notice has at most so many lines, and words between its first and its last (the longest template: 36)
MAX_LINES, MAX_INNER = 24, 70
TEMPERATURES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
UNKNOWN = "unknown"

# Notices by which licences are granted, by family.
TEMPLATES = {
    "MIT": ["Released under the MIT License.",
            "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License.",
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License.",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
             "Lesser General Public License"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.",
                 "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": ["Licensed under the BSD License.",
            "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, Version 2.0.",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": ["Released under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY": ["Licensed under CC BY 4.0.",
              "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0": ["Released under CC0 1.0 Universal.",
            "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
            "to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
# Sentences with words of licences that grant nothing.
NO_GRANTS = [
    "The driver renewed the license last week.", "A license is needed to fish in this lake.",
    "The software was released under heavy criticism.", "This work is under review by the general public.",
    "The foundation published a free version of the report.", "You may obtain a copy at the front desk.",
    "The public library is free for any person.", "Permission to use the room was granted without a fee.",
    "The source of the apache helicopter story is unknown.", "She studied at MIT and works with software.",
    "The conditions are met by all binary forms of the compound.", "Version 2 of the plan was modified in part.",
]
# Words too common to tell a licence by.
STOP = frozenset("a an and any are as at be by can for from in is it its may not of on or that the this to under v "
                 "was with without you all above either except following has http most one provided related www".split())


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _ngrams(words: Column, n: int) -> Column:
    def join(first, i):
        return F.concat(first, *(x for k in range(1, n) for x in (F.lit(" "), F.get(words, i + k))))

    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0))), join)


def _split(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _vocabulary() -> tuple[list[str], list[str]]:
    """(n-grams of the templates with a telling word, telling words)."""
    grams, telling = set(), set()
    for text in (t for ts in TEMPLATES.values() for t in ts):
        w = _split(text)
        telling |= {x for x in w if x not in STOP}
        grams |= {" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)
                  if any(x not in STOP for x in w[i:i + n])}
    return sorted(grams), sorted(telling)


def _literals(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small fixed table from literals."""
    structs = [F.struct(*(F.lit(v).alias(n) for v, n in zip(r, names))) for r in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(f, f"{f}/{i}", t) for f, ts in TEMPLATES.items() for i, t in enumerate(ts)]
    t = _table(spark, rows, ["family", "template", "text"])
    return t.withColumn("trigrams", F.array_distinct(_ngrams(_words(F.col("text")), 3)))


def _features(df: DataFrame) -> DataFrame:
    """``words`` to ``features``: its n-grams in the vocabulary."""
    grams = F.concat(F.col("words"), _ngrams(F.col("words"), 2), _ngrams(F.col("words"), 3))
    return df.withColumn("features", F.array_intersect(grams, _literals(_vocabulary()[0])))


def _row() -> Column:
    return F.xxhash64("doc_id", text_or_empty()).alias("row")


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, row, line, paragraph, words, features, trigrams`` of the paragraphs with an
    n-gram of a template.  Words and then n-grams are written once: a filter on an
    expression over them would else be pushed down and compute them again in every
    step of its lambdas."""
    lines = docs.select("doc_id", _row(), F.posexplode(F.split(text_or_empty(), "\n")).alias("line", "paragraph"))
    near = lines.withColumn("words", _words(F.col("paragraph"))).where(
        F.arrays_overlap("words", _literals(_vocabulary()[1])))
    return _grams(materialise(near, "licence-lines"), "licence-paragraphs").where(F.size("features") > 0)


def _grams(rows: DataFrame, name: str) -> DataFrame:
    return materialise(_features(rows).withColumn("trigrams", _ngrams(F.col("words"), 3)), name)


def _similar(df: DataFrame, spark: SparkSession, by_family: bool) -> DataFrame:
    """Adds ``template`` and ``similarity``: the best template (of the family) by the part
    of its trigrams that the paragraph has."""
    best = None
    for family, texts in TEMPLATES.items():
        for i, text in enumerate(texts):
            w = _split(text)
            grams = sorted({" ".join(w[k:k + 3]) for k in range(len(w) - 2)})
            share = F.size(F.array_intersect(F.col("trigrams"), _literals(grams))) / F.lit(float(len(grams)))
            if by_family:
                share = F.when(F.col("family") == family, share).otherwise(F.lit(-1.0))
            one = F.struct(share.alias("similarity"), F.lit(f"{family}/{i}").alias("template"))
            best = [one] if best is None else [*best, one]
    return (df.withColumn("_best", F.array_max(F.array(*best)))
            .withColumns({"template": F.col("_best.template"), "similarity": F.col("_best.similarity")}).drop("_best"))


def _examples(spark: SparkSession, near: DataFrame, max_unknown: int) -> DataFrame:
    """``family, words, fold`` of the training paragraphs."""
    t = _templates(spark).withColumn("w", _words(F.col("text")))
    n = F.size("w")
    whole = t.select("family", F.col("w").alias("words"))
    less = t.select("family", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.filter(
        F.col("w"), lambda x, j: j != i))).alias("words"))
    pieces = t.select(F.lit(UNKNOWN).alias("family"), F.explode(F.flatten(F.array(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.slice("w", i, 1)),
        F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.slice("w", i, 2))))).alias("words"))
    plain = _table(spark, [(x,) for x in NO_GRANTS], ["text"]).select(F.lit(UNKNOWN).alias("family"), _words(F.col("text")).alias("words"))
    similar = materialise(_similar(near, spark, False).select("words", "similarity"), "licence-similar")
    seen = (similar.where("similarity < 1.0 / 3").groupBy("words").agg(F.count(F.lit(1)).alias("_n"))
            .orderBy(F.xxhash64("words"), F.col("words")).limit(max_unknown)
            .select(F.lit(UNKNOWN).alias("family"), "words"))
    rows = reduce(DataFrame.unionByName, (whole, whole, less, pieces, plain, plain, plain, seen))
    return _grams(materialise(rows, "licence-words"), "licence-grams").withColumn("fold", F.pmod(F.xxhash64("family", "words"), F.lit(5)))


class Scanner:
    """The fitted classifier and its temperature."""

    def __init__(self, spark: SparkSession, model: LogisticRegressionModel, temperature: float, families: list[str]):
        self.spark, self.model, self.temperature, self.families = spark, model, temperature, families
        self.vectors = _vectors(spark)

    def classify(self, rows: DataFrame) -> DataFrame:
        """Adds ``family`` and ``probability`` to rows with ``features``."""
        out = self.model.transform(self.vectors.transform(rows))
        p = _softmax(vector_to_array("raw"), self.temperature)
        out = out.withColumn("_p", p)
        top = F.array_max(F.transform("_p", lambda x, i: F.struct(x.alias("p"), (-i).alias("i"))))
        return (out.withColumn("_top", top)
                .withColumns({"family": F.element_at(_literals(self.families), 1 - F.col("_top.i")), "probability": F.col("_top.p")})
                .drop("_p", "_top", "raw", "vector", "probabilities", "prediction"))


def _vectors(spark: SparkSession) -> CountVectorizerModel:
    return CountVectorizerModel.from_vocabulary(_vocabulary()[0], "features", outputCol="vector", minTF=1.0).setBinary(True)


def _softmax(raw: Column, temperature: float) -> Column:
    scaled = F.transform(raw, lambda x: x / F.lit(temperature))
    powers = F.transform(scaled, lambda x: F.exp(x - F.array_max(scaled)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def fit(spark: SparkSession, near: DataFrame, max_unknown: int = MAX_UNKNOWN) -> Scanner:
    """Train on four fifths of the examples; the rest sets the temperature."""
    families = [UNKNOWN, *sorted(TEMPLATES)]
    label = F.array_position(_literals(families), F.col("family")).cast("double") - 1
    rows = materialise(_examples(spark, near, max_unknown).select("features", label.alias("label"), "fold"), "licence-examples")
    lr = LogisticRegression(featuresCol="vector", labelCol="label", rawPredictionCol="raw", probabilityCol="probabilities",
                            family="multinomial", regParam=1e-3, maxIter=60)
    vectors = _vectors(spark)
    data = vectors.transform(rows)
    # every label occurs in both parts, as templates are given twice and with words left out
    model = lr.fit(data.where("fold > 0"))
    held = model.transform(data.where("fold = 0"))
    loss = [F.avg(-F.log(F.greatest(F.element_at(_softmax(vector_to_array("raw"), t), F.col("label").cast("int") + 1), F.lit(1e-12))))
            for t in TEMPERATURES]
    scores = held.agg(*(x.alias(f"t{i}") for i, x in enumerate(loss))).first()
    usable = [(s, t) for s, t in zip(scores, TEMPERATURES) if s is not None]
    return Scanner(spark, model, min(usable)[1] if usable else 1.0, families[:model.numClasses])


def _needs() -> list[tuple[list[str], int]]:
    """(telling words of a template, how many of them half of its trigrams hold at least)."""
    out = []
    for text in (t for ts in TEMPLATES.values() for t in ts):
        w = _split(text)
        grams = {tuple(w[k:k + 3]) for k in range(len(w) - 2)}
        need = 0
        for place in range(3):  # trigrams hold different words at one place, but for repeats
            at = [g[place] for g in grams]
            left = MIN_SIMILARITY * len(grams) - sum(x in STOP for x in at)
            counts, n = sorted((at.count(x) for x in set(at) if x not in STOP), reverse=True), 0
            while left > 0:
                left, n = left - counts[n], n + 1
            need = max(need, n)
        out.append((sorted({x for x in w if x not in STOP}), need))
    return out


def _wrapped(docs: DataFrame, max_lines: int = MAX_LINES, max_inner: int = MAX_INNER) -> DataFrame:
    """``key, row, doc_id, line, n_lines, paragraph, words, trigrams`` of the runs of lines (and
    single lines) that hold half of the trigrams of a template."""
    spark = docs.sparkSession
    vocabulary, needs = _literals(_vocabulary()[1]), _needs()

    def enough(told):
        return reduce(Column.__or__, (F.size(F.array_intersect(told, _literals(w))) >= n for w, n in needs))

    texts = docs.select("doc_id", text_or_empty().alias("text")).where(F.contains("text", F.lit("\n")))
    # one filter, as a second column would be computed again in each of its uses
    some = texts.where(_bound(_words(F.col("text")), lambda w: _bound(F.array_intersect(w, vocabulary), enough)
                              & _half(_ngrams(w, 3))))
    some = some.withColumn("key", F.monotonically_increasing_id())
    lines = some.select("key", _row(), "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "paragraph")).withColumn(
        "words", _words(F.col("paragraph")))
    lines = materialise(lines, "licence-text-lines")  # fixes the keys
    by = Window.partitionBy("key").orderBy("line")
    lines = lines.withColumn("run", F.count(F.when(F.size("words") == 0, 1)).over(by)).where(F.size("words") > 0)
    # of a long line only its ends can belong to a notice with other lines
    ends = F.when(F.size("words") <= 2 * max_inner, F.col("words")).otherwise(F.concat(
        F.slice("words", 1, max_inner), F.array(F.lit("")), F.slice("words", -max_inner, max_inner)))
    lines = lines.withColumn("words", ends)
    after = Window.partitionBy("key", "run").orderBy("line").rowsBetween(0, max_lines - 1)
    starts = lines.withColumn("lines", F.collect_list(F.struct("paragraph", "words")).over(after))
    # a run begins and ends with a line that has a trigram of a template; others are no better than a shorter one
    grams = _literals(_template_trigrams())
    every = F.flatten("lines.words")
    head = F.slice(every, F.lit(1), F.size("words") + 2)
    # the first line, the inner words and a last line are all that a run can hold
    most = F.slice(every, F.lit(1), F.size("words") + max_inner + 2 * max_inner + 1)
    starts = starts.where(_bound(head, lambda w: F.arrays_overlap(_ngrams(w, 3), grams)) & _bound(most, lambda w: _half(_ngrams(w, 3))))
    runs = starts.select("key", "row", "doc_id", "line", "lines", F.explode(F.sequence(F.lit(1), F.size("lines"))).alias("n_lines"))
    inner = F.size(F.flatten(F.slice(F.col("lines.words"), F.lit(2), F.greatest(F.col("n_lines") - 2, F.lit(0)))))
    runs = runs.where((F.col("n_lines") <= 2) | (inner <= max_inner))
    upto = F.flatten(F.slice("lines.words", F.lit(1), F.col("n_lines")))
    tail = F.least(F.size(upto), F.size(F.element_at("lines.words", F.col("n_lines"))) + 2)
    runs = runs.where(F.arrays_overlap(_ngrams(F.slice(upto, -tail, tail), 3), grams))
    runs = runs.select("key", "row", "doc_id", "line", "n_lines",
                       F.array_join(F.slice("lines.paragraph", F.lit(1), F.col("n_lines")), " ").alias("paragraph"),
                       F.flatten(F.slice("lines.words", F.lit(1), F.col("n_lines"))).alias("words"))
    runs = materialise(_trigrams(materialise(runs, "licence-runs")), "licence-run-grams")
    return _similar(runs, spark, False).where(F.col("similarity") >= MIN_SIMILARITY).drop("template", "similarity")


def _bound(value: Column, test) -> Column:
    """``test`` of a value that is computed once."""
    return F.exists(F.array(value), test)


def _template_trigrams() -> list[str]:
    return sorted({" ".join(w[k:k + 3]) for w in map(_split, (t for ts in TEMPLATES.values() for t in ts))
                   for k in range(len(w) - 2)})


def _half(trigrams: Column) -> Column:
    """Whether they hold ``MIN_SIMILARITY`` of the trigrams of a template; those of no
    template go first, in one pass."""
    needs = []
    for text in (t for ts in TEMPLATES.values() for t in ts):
        w = _split(text)
        grams = sorted({" ".join(w[k:k + 3]) for k in range(len(w) - 2)})
        needs.append((grams, -int(-MIN_SIMILARITY * len(grams) // 1)))
    return _bound(F.array_intersect(trigrams, _literals(_template_trigrams())), lambda found: (F.size(found) > 0) & reduce(
        Column.__or__, (F.size(F.array_intersect(found, _literals(g))) >= n for g, n in needs)))


def _trigrams(rows: DataFrame) -> DataFrame:
    return rows.withColumn("trigrams", _ngrams(F.col("words"), 3))


def _best_runs(found: DataFrame, max_lines: int) -> DataFrame:
    """Runs of several lines that no better run or line overlaps: of the same family in any
    line, of another one in more than half of the lines of the shorter."""
    near = Window.partitionBy("key").orderBy("line").rangeBetween(-max_lines, max_lines)
    found = found.withColumn("near", F.collect_list(F.struct("line", "n_lines", "family", "similarity")).over(near))

    def beats(v):
        shared = F.least(v["line"] + v["n_lines"], F.col("line") + F.col("n_lines")) - F.greatest(v["line"], F.col("line"))
        meets = (shared > 0) & ((v["family"] == F.col("family")) | (shared * 2 > F.least(v["n_lines"], F.col("n_lines"))))
        rank = lambda s, n, line: F.struct(-s, n, line)
        return meets & (rank(v["similarity"], v["n_lines"], v["line"])
                        < rank(F.col("similarity"), F.col("n_lines"), F.col("line")))

    return found.where((F.col("n_lines") > 1) & ~F.exists("near", beats))


def scan(docs: DataFrame, max_unknown: int = MAX_UNKNOWN, confirmed_only: bool = True,
         max_lines: int = MAX_LINES, max_inner: int = MAX_INNER) -> DataFrame:
    """``doc_id, line, family, probability, template, similarity, confirmed, paragraph``
    of the paragraphs that grant a licence; predictions that no template confirms
    are given only on request, and only of single lines."""
    spark = docs.sparkSession
    near = paragraphs(docs)
    scanner = fit(spark, near, max_unknown)

    def granted(rows, name):
        out = materialise(scanner.classify(rows).drop("features", "words"), name)
        out = out.where((F.col("family") != UNKNOWN) & (F.col("probability") > 0.5))
        return _similar(out, spark, True).withColumn("confirmed", F.col("similarity") >= MIN_SIMILARITY)

    found = granted(near, "licence-classes")
    if confirmed_only:
        found = found.where("confirmed")
    runs = materialise(_features(_wrapped(docs, max_lines, max_inner)), "licence-run-features")
    runs = materialise(_best_runs(granted(runs, "licence-run-classes").where("confirmed"), max_lines), "licence-best-runs")
    inside = runs.select("row", F.explode(F.sequence(F.col("line"), F.col("line") + F.col("n_lines") - 1)).alias("line"),
                         "similarity").groupBy("row", "line").agg(F.max("similarity").alias("in_run"))
    found = found.join(inside, ["row", "line"], "left").where("in_run IS NULL OR in_run <= similarity")
    names = ["line", "family", "probability", "template", "similarity", "confirmed", "paragraph"]
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), *names).unionByName(
        runs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *names))
