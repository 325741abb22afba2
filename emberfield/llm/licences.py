"""Licence statements in texts, with built-in functions and the DataFrame machine-learning library.

A multinomial logistic regression on word n-grams, with a penalty that leaves few weights, names the
licence family of a stretch of a paragraph, or ``other``. It is trained on the statements of ``TEMPLATES``,
on versions of them with words left out, on their last words, and on a bounded sample of ordinary lines.
The least probability for a family is calibrated on versions and on ordinary lines that were not trained on.
A prediction counts only if the stretch shares enough word pairs with a statement of that family, or holds
one of the family's ``NAMES``; what is predicted but not confirmed is counted apart, as an unknown licence, if it has a word of ``CUE``.

A paragraph ends at a blank line. Stretches are its lines, runs of two and three lines, and overlapping
windows over all its words whatever the line ends, so that a statement in hard-wrapped text lies whole in
some of them. All stretches are classified, but most without evaluating them: the model's own weights bound
by how much the n-grams of a stretch can lift the families above ``other`` (``gram_lifts``), and below that
the verdict is ``other`` for certain. Of stretches that overlap, the one that shares most pairs counts.

Defined results: a null or empty text has no licence; repeated rows get equal results; an input column
named like an added one is replaced; ties between places go by their order of words and by family name; an
empty table gives an empty result, and without ordinary lines the model knows the sentences below only.
Work and memory for a text grow linearly with its length.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield.llm.common import text_print, without

#: Most n-grams the classifier knows, the most frequent of the statements and sentences below.
FEATURES = 1 << 12
WINDOW, STEP = 48, 24
#: Windows over a paragraph, (words, step): the long ones hold every statement whole, the short ones brief ones.
ACROSS = ((80, 24), (24, 12))
#: More than the words of any stretch.
SIZES = 128
#: Ordinary lines that the classifier is trained on, and further ones that its threshold is calibrated on.
OTHER_ROWS, HELD_ROWS = 1500, 500
LEAST_SHARE = 0.6
OTHER = "other"
#: What an unknown licence must have besides its probability.
CUE = r"licen|lizenz|copyright|permission|redistribut|public domain|spdx|gpl"
#: Words that lines of the ordinary sample must not have.
GATE = r"licen[cs]|copyright|permission|redistribut|warrant|creative commons|public domain|spdx|gpl|\bcc by"

# How licence families are commonly stated.
TEMPLATES = {
    "MIT": [
        "released under the mit license", "licensed under the mit license", "this project is licensed under the terms of the mit license",
        "spdx license identifier mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction including without limitation the rights "
        "to use copy modify merge publish distribute sublicense and or sell copies of the software"],
    "Apache-2.0": [
        "licensed under the apache license version 2.0", "released under the apache license version 2.0", "apache license version 2.0 january 2004",
        "spdx license identifier apache 2.0", "you may not use this file except in compliance with the license you may obtain a copy of the "
        "license at http www apache org licenses license 2.0", "unless required by applicable law or agreed to in writing software "
        "distributed under the license is distributed on an as is basis without warranties or conditions of any kind"],
    "GPL-3.0": [
        "this work is licensed under the gnu general public license version 3", "licensed under the gnu gpl version 3",
        "released under the gnu general public license v3", "spdx license identifier gpl 3.0",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
        "software foundation either version 3 of the license or at your option any later version"],
    "GPL-2.0": [
        "this work is licensed under the gnu general public license version 2", "licensed under the gnu gpl version 2",
        "released under the gnu general public license v2", "spdx license identifier gpl 2.0",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
        "software foundation either version 2 of the license or at your option any later version"],
    "LGPL": [
        "licensed under the gnu lesser general public license version 3", "released under the lgpl",
        "spdx license identifier lgpl 2.1", "under the terms of the gnu lesser general public license version 2.1"],
    "AGPL-3.0": ["licensed under the gnu affero general public license version 3", "released under the agpl", "spdx license identifier agpl 3.0"],
    "BSD": [
        "released under the bsd license", "licensed under the 3 clause bsd license", "spdx license identifier bsd 3 clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "MPL-2.0": [
        "this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0",
        "spdx license identifier mpl 2.0"],
    "ISC": [
        "released under the isc license", "spdx license identifier isc", "permission to use copy modify and or distribute this software for any "
        "purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "CC-BY": ["licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"],
    "CC-BY-SA": ["licensed under cc by sa 4.0", "licensed under a creative commons attribution sharealike 4.0 international license"],
    "CC-BY-NC": ["licensed under cc by nc 4.0", "licensed under a creative commons attribution noncommercial 4.0 international license"],
    "CC0": ["released under cc0 1.0 public domain dedication", "dedicated to the public domain under the cc0 license"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "released under the unlicense license"],
}
# Short names of licences with a word that makes them one; a stretch confirms a family if it holds all pairs of a name.
NAMES = {
    "MIT": ["mit license", "mit licence", "mit licensed", "mit lizenz", "licence mit", "licencia mit"],
    "Apache-2.0": ["apache 2.0", "apache license 2.0", "apache license version 2.0", "apache lizenz 2.0", "licence apache 2.0", "licencia apache 2.0"],
    "GPL-3.0": ["gplv3", "gpl v3", "gpl 3.0", "gnu gpl version 3"],
    "GPL-2.0": ["gplv2", "gpl v2", "gpl 2.0", "gnu gpl version 2"],
    "LGPL": ["lgplv3", "lgplv2", "lgpl v3", "lgpl 3.0", "lgpl 2.1"],
    "AGPL-3.0": ["agplv3", "agpl v3", "agpl 3.0"],
    "BSD": ["bsd license", "bsd licence", "bsd 3 clause", "bsd 2 clause", "bsd lizenz", "licence bsd", "licencia bsd"],
    "MPL-2.0": ["mpl 2.0", "mplv2"],
    "ISC": ["isc license", "isc licence"],
    "Unlicense": ["the unlicense"],
}
# What leads to a name.
LEADS = ["", "released under", "licensed under", "licensed under the", "this software is", "lizenziert unter der", "sous", "licenciado bajo la"]
# Sentences with words of the gate that state no licence.
NOT_LICENCES = [
    "he lost his driving licence last year", "the license plate was covered in mud", "all rights reserved", "copyright by the authors",
    "a software license costs ten dollars per month", "the fishing licence must be renewed every spring",
    "with the permission of his parents he left", "the warranty covers parts and labour for two years", "a licensed electrician checked it",
    "please ask for permission before entering", "the public domain is a legal concept", "copyright law changed in that year",
    "the restaurant applied for a liquor licence", "we accept no warranty for the content of external links",
    "please read the license carefully", "redistribution of income is a matter of debate",
    "they walked under the bridge to the old building", "she studied at the mit in her youth", "the mit building was empty that evening", "the tunnel under the mit campus was flooded",
    "the lawyer was released from the general hospital", "the film was released in version 2", "software for the public is free"]


TOKEN = r"[a-z]+[0-9]*|[0-9]+(?:\.[0-9]+)*"
STATED = [re.findall(TOKEN, t) for ts in TEMPLATES.values() for t in ts]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _after(words: Column, k: int) -> Column:
    """``words`` from the ``k``-th on, one-based."""
    return F.slice(words, F.lit(k), F.size(words))


def pairs(words: Column) -> Column:
    """Distinct neighbouring word pairs, and the last word."""
    return F.array_distinct(F.zip_with(words, _after(words, 2), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)).otherwise(a)))


def grams(words: Column) -> Column:
    """Words, pairs and triples, the features of the classifier."""
    second, third = _after(words, 2), _after(words, 3)
    two = F.zip_with(words, second, lambda a, b: F.concat(a, F.lit(" "), b))
    three = F.zip_with(F.zip_with(words, second, lambda a, b: F.concat(a, F.lit(" "), b)), third, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_compact(F.concat(words, two, three))


def _with_gaps(words: DataFrame, turns: list[tuple[int, int]]) -> DataFrame:
    """Versions of ``words`` with every ``k``-th word from ``s`` on left out."""
    def version(k: int, s: int) -> Column:
        return F.filter("words", lambda _, i: (i + s) % k != 0)
    versions = F.array(*[version(k, s) for k, s in turns])
    return words.select("family", F.explode(versions).alias("words")).where(F.size("words") > 2)


def _short_forms(words: DataFrame) -> DataFrame:
    """The last words of each statement, without what leads to the licence's name."""
    size = F.size("words")
    return words.select("family", F.slice("words", size - F.ceil(size * LEAST_SHARE).cast("int") + 1, size).alias("words")).where(F.size("words") > 2)


def once(df: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """``keep`` and the columns ``made``, each computed once: later filters are not moved below a generator."""
    row = F.struct(*[c.alias(n) for n, c in made.items()])
    return df.select(*keep, F.explode(F.array(row)).alias("made")).select(*keep, *[f"made.{n}" for n in made])


@dataclass(frozen=True)
class LicenceModel:
    counter: CountVectorizerModel
    model: LogisticRegressionModel
    families: list[str]
    least: float
    lift: dict[str, float]  # of n-grams, see gram_lifts
    margin: float

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add to rows with ``words`` the likeliest ``family``, and the ``probability`` that they state any licence."""
        counted = once(self.counter.transform(once(rows, rows.columns, grams=grams(F.col("words")))), rows.columns, features=F.col("features"))
        scored = once(self.model.transform(counted), rows.columns, p=vector_to_array("probability"))
        names, licences = F.array(*map(F.lit, self.families)), F.slice("p", 1, len(self.families) - 1)
        return scored.select(*rows.columns, F.get(names, (F.array_position(licences, F.array_max(licences)) - 1).cast("int")).alias("family"),
                             F.aggregate(licences, F.lit(0.0), lambda total, x: total + x).alias("probability"))

    def lifts(self, words: Column) -> Column:
        """By how much the n-grams that end at each word can lift any family above ``other``."""
        ends = sorted({gram.split(" ")[-1] for gram in self.lift})
        tables = {k: {g: v for g, v in sorted(self.lift.items()) if g.count(" ") == k} for k in (0, 1, 2)}

        def looked_up(gram: Column, table: dict[str, float]) -> Column:
            values = F.create_map(*[F.lit(x) for item in table.items() for x in item]) if table else None
            return F.lit(0.0) if values is None else F.when(gram.isin(list(table)), F.element_at(values, gram)).otherwise(0.0)

        def lift(word: Column, i: Column) -> Column:
            two = F.concat(F.get(words, i - 1), F.lit(" "), word)
            three = F.concat(F.get(words, i - 2), F.lit(" "), two)
            return F.when(word.isin(ends), looked_up(word, tables[0]) + looked_up(two, tables[1]) + looked_up(three, tables[2])).otherwise(0.0)

        return F.transform(words, lift)

    def may_be(self, lifts: Column) -> Column:
        """False where words of these ``lifts`` are below the least probability for certain."""
        return F.aggregate(lifts, F.lit(self.margin), lambda total, x: total + x) >= math.log(self.least / (1 - self.least))

    def may_hold(self, words: Column) -> Column:
        """False where no stretch of ``words`` can reach the least probability."""
        return self.may_be(self.lifts(words))


def gram_lifts(vocabulary: list[str], weights: np.ndarray, biases: np.ndarray, other: int) -> tuple[dict[str, float], float]:
    """(lift of each n-gram that favours a family, margin): ``margin`` plus the lifts of the n-grams of a stretch bounds,
    from above, the logarithm of the odds of all families against class ``other``."""
    lead = np.delete(weights - weights[other], other, axis=0).max(axis=0)
    margin = np.logaddexp.reduce(np.delete(biases - biases[other], other)) + 1e-9
    return {vocabulary[i]: float(lead[i]) for i in np.flatnonzero(lead > 0)}, float(margin)


def best_threshold(licence: list[float], ordinary: list[float]) -> float:
    """The probability that parts held-out rows best: least sum of the two rates of error; of equal ones the middle."""
    yes, no = np.sort(licence), np.sort(ordinary)
    if not len(yes) or not len(no):
        return 0.5
    at = np.unique(np.concatenate([[0.0], yes, no, [1.0]]))
    tried = (at[1:] + at[:-1]) / 2
    wrong = np.searchsorted(yes, tried) / len(yes) + 1 - np.searchsorted(no, tried) / len(no)
    best = tried[wrong <= wrong.min() + 1e-12]
    return float(best[len(best) // 2])


def template_rows(spark: SparkSession) -> DataFrame:
    rows = [(f, t) for f, ts in TEMPLATES.items() for t in ts] + [(OTHER, t) for t in NOT_LICENCES]
    return spark.createDataFrame(rows, "family string, text string").select("family", tokens(F.col("text")).alias("words")).coalesce(1)


def name_rows(spark: SparkSession, leads: list[str]) -> DataFrame:
    rows = [(f, f"{lead} {n}") for f, ns in NAMES.items() for n in ns for lead in leads]
    return spark.createDataFrame(rows, "family string, text string").select("family", tokens(F.col("text")).alias("words")).coalesce(1)


def ordinary_lines(df: DataFrame, text: str = "text", rows: int = OTHER_ROWS) -> DataFrame:
    """(line): at most ``rows`` distinct lines without a word of the gate, those with the smallest hashes.

    A count of the distinct hashes gives a bound below which half as many lines again are expected, so few lines
    move; where more than a third of the lines has a word of the gate, the sample is smaller.
    """
    lines = df.select(F.explode(F.split(text, "\n")).alias("line")).where("length(line) > 20")
    order = F.xxhash64("line")
    there = lines.agg(F.approx_count_distinct(order, 0.02)).first()[0]
    bound = min((1 << 63) - 1, -(1 << 63) + int((1 << 64) * min(1.0, 1.5 * rows / max(there, 1))))
    few = lines.where(order <= F.lit(bound).cast("long")).distinct()
    return few.where(~F.lower("line").rlike(GATE)).orderBy(order, "line").limit(rows)


def fit_licences(df: DataFrame, text: str = "text") -> LicenceModel:
    """Train on the templates and on at most ``OTHER_ROWS`` lines of ``df`` without a word of the gate.

    The sample of ``OTHER_ROWS + HELD_ROWS`` lines is cut at random by a second hash; what is not trained on calibrates.
    """
    spark = df.sparkSession
    stated, named = template_rows(spark), name_rows(spark, LEADS[::2])
    sample = ordinary_lines(df, text, OTHER_ROWS + HELD_ROWS).select(F.lit(OTHER).alias("family"), tokens(F.col("line")).alias("words"), (
        F.pmod(F.xxhash64(F.lit("held"), "line"), F.lit(OTHER_ROWS + HELD_ROWS)) < HELD_ROWS).alias("held")).coalesce(1).cache()
    plain = sample.where("not held").select("family", "words")
    families = [*TEMPLATES, OTHER]
    number = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    licences = stated.where(F.col("family") != OTHER)
    known = stated.union(named).union(_with_gaps(licences, [(k, s) for k in (4, 5, 6) for s in range(3)])).union(_short_forms(licences)).union(
        _with_gaps(stated.where(F.col("family") == OTHER), [(4, 0), (5, 1)]))
    weighed = known.withColumn("weight", F.when(F.col("family") == OTHER, 2.0).otherwise(1.0)).union(plain.withColumn("weight", F.lit(0.2)))
    rows = once(weighed.coalesce(1), ["family", "weight"], grams=grams(F.col("words"))).select("grams", number.alias("label"), "weight").cache()
    counter = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=FEATURES, minDF=2, binary=True).fit(rows.where("weight > 0.5"))
    hashed = counter.transform(rows).select("label", "features", "weight").cache()
    model = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.5, maxIter=40, weightCol="weight").fit(hashed)
    hashed.unpersist()
    rows.unpersist()
    lift, margin = gram_lifts(counter.vocabulary, model.coefficientMatrix.toArray(), model.interceptVector.toArray(), len(families) - 1)
    fitted = LicenceModel(counter, model, families, 0.5, lift, margin)
    # Versions that the training has not seen, ordinary lines and sentences held out of it.
    unseen = _with_gaps(licences, [(7, 1), (3, 2)]).union(name_rows(spark, LEADS[1::2])).withColumn("licence", F.lit(True)).union(
        _with_gaps(stated.where(F.col("family") == OTHER), [(3, 1), (6, 2)]).union(sample.where("held").select("family", "words")).withColumn("licence", F.lit(False)))
    judged = fitted.predict(unseen.drop("family"))
    # At most HELD_ROWS lines and a few hundred versions.
    scores = [(r.licence, r.probability) for r in judged.select("licence", "probability").collect()]
    sample.unpersist()
    least = best_threshold([p for yes, p in scores if yes], [p for yes, p in scores if not yes])
    return replace(fitted, least=least)


def _stretches(bounds: Column, total: Column) -> Column:
    """at * SIZES + size of lines, of runs of lines and of windows over a paragraph whose lines start at ``bounds``."""
    def stretch(at: Column, size: Column) -> Column:
        return at.cast("long") * SIZES + size.cast("long")

    def windows(begin: Column, size: Column, width: int, step: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(size - (width - step) - 1, F.lit(0)), F.lit(step))
        return F.transform(starts, lambda j: stretch(begin + j, F.least(F.lit(width), size - j)))

    def runs(k: int) -> Column:
        """(at, size) of ``k`` lines in a row."""
        return F.filter(F.transform(bounds, lambda b, i: F.struct(b.alias("at"), (F.get(bounds, i + k) - b).alias("size"))),
                        lambda r: r["size"].isNotNull())

    lines = F.flatten(F.transform(runs(1), lambda r: windows(r["at"], r["size"], WINDOW, STEP)))
    several = [F.transform(F.filter(runs(k), lambda r: r["size"] <= WINDOW), lambda r: stretch(r["at"], r["size"])) for k in (2, 3)]
    across = [F.when((F.size(bounds) > 2) | (total > WINDOW), windows(F.lit(0), total, *w)).otherwise(F.array().cast("array<long>"))
              for w in ACROSS]
    # Numbers, not structs: distinct structs are found by comparing all with all.
    return F.array_distinct(F.concat(lines, *several, *across))


def find_licences(df: DataFrame, model: LicenceModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print, paragraph, start, family, probability, share) of every place that states a licence.

    ``share`` is that of the word pairs of the stretch or of a statement of its family, whichever
    contains the other; below ``LEAST_SHARE`` the family is null. Places of a paragraph do not overlap.
    """
    keys = ["doc_id", "print", "paragraph"]
    docs = df.select(F.col(doc_id).alias("doc_id"), text_print(F.col(text)).alias("print"), F.posexplode(
        F.split(F.lower(text), r"\n\s*\n")).alias("paragraph", "t"))
    marked = once(docs, keys, marked=F.regexp_extract_all("t", F.lit(TOKEN + r"|\n"), F.lit(0)))
    whole = once(marked, keys, all=F.filter("marked", lambda t: t != "\n"), ends=F.array_compact(
        F.transform("marked", lambda t, i: F.when(t == "\n", i))))
    bounds = F.array_distinct(F.concat(F.array(F.lit(0)), F.transform("ends", lambda p, k: p - k), F.array(F.size("all"))))
    lifted = once(whole, [*keys, "all", "ends"], lifts=model.lifts(F.col("all"))).where(model.may_be(F.col("lifts")))
    lined = once(lifted, [*keys, "all", "lifts"], bounds=bounds)
    def place(s: Column) -> tuple[Column, Column]:
        return F.floor(s / SIZES).cast("int"), (s % SIZES).cast("int")

    def may_be(s: Column) -> Column:
        at, size = place(s)
        return (size > 0) & model.may_be(F.slice("lifts", at + 1, size))

    def cut_out(s: Column) -> Column:
        at, size = place(s)
        return F.struct(at.alias("at"), F.slice("all", at + 1, size).alias("words"))

    # Cut inside the array: a generator would copy the whole paragraph to each of its stretches.
    left = F.filter(_stretches(F.col("bounds"), F.size("all")), may_be)
    cut = lined.select(*keys, F.explode(F.transform(left, cut_out)).alias("s")).select(*keys, "s.at", "s.words")
    judged = model.predict(cut).where(F.col("probability") >= model.least)
    # Bounded by the table of templates above.
    names = name_rows(df.sparkSession, [""])
    neighbouring = F.when(F.size("words") > 1, F.zip_with("words", _after(F.col("words"), 2), lambda a, b: F.concat(a, F.lit(" "), b)))
    known = F.broadcast(template_rows(df.sparkSession).where(F.col("family") != OTHER).select(
        F.col("family").alias("f"), pairs(F.col("words")).alias("stated"), F.lit(False).alias("name")).union(
        names.select("family", F.coalesce(F.array_compact(neighbouring), "words"), F.lit(True))))
    near = F.zip_with("words", _after(F.col("words"), 2), lambda a, b: F.concat_ws(" ", a, b))
    own = once(judged, judged.columns, own=pairs(F.col("words")), near=near)
    compared = own.join(known, own.family == known.f)
    compared = once(compared, [*own.columns, "stated", "name"], both=F.array_intersect(
        "stated", F.when(F.col("name"), F.array_union("own", "words")).otherwise(F.col("own"))))
    shared = F.size("both")
    share = F.greatest(shared / F.size("stated"), F.when(~F.col("name") & (F.size("own") >= 4), shared / F.size("own")).otherwise(0.0))
    # Where the shared pairs first occur, in words of the paragraph.
    places = F.transform("both", lambda x: F.greatest(F.array_position("near", x), F.when(
        ~F.contains(x, F.lit(" ")), F.array_position("words", x)).otherwise(0)))
    compared = once(compared, [*judged.columns, "both"], share=F.when(F.col("name") & (share < 1), 0.0).otherwise(share), places=places)
    end = F.least(F.array_max("places") + 1, F.size("words"))
    confirmed = F.col("share") >= LEAST_SHARE
    compared = compared.withColumn("low", F.when(confirmed, F.col("at") + F.array_min("places") - 1).otherwise(F.col("at"))).withColumn(
        "high", F.when(confirmed, F.col("at") + end).otherwise(F.col("at") + F.size("words")))
    one = F.struct(confirmed.alias("confirmed"), shared.alias("shared"), (F.col("low") - F.col("high")).alias("tight"), "share", "probability",
                   "low", "high", "family")
    counted = compared.where(confirmed | F.array_join("words", " ").rlike(CUE))
    best = counted.groupBy("doc_id", "print", "paragraph", "at", F.size("words").alias("size")).agg(F.max(one).alias("one"))
    # The stretches of one paragraph, most shared pairs first; each one counts that overlaps none before it.
    found = best.groupBy("doc_id", "print", "paragraph").agg(F.sort_array(F.collect_set("one"), asc=False).alias("found"))
    kept = F.aggregate("found", F.slice("found", 1, 0), lambda kept, x: F.when(
        F.exists(kept, lambda y: (x["low"] < y["high"]) & (y["low"] < x["high"])), kept).otherwise(F.concat(kept, F.array(x))))
    rows = found.select("doc_id", "print", "paragraph", F.explode(kept).alias("x"))
    return rows.select("doc_id", "print", "paragraph", F.col("x.low").alias("start"), F.when(F.col("x.confirmed"), F.col("x.family")).alias("family"),
                       "x.probability", "x.share")


def licences_of_documents(df: DataFrame, model: LicenceModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without ``text``, with the confirmed ``families`` and counts of places."""
    found = find_licences(df, model, doc_id, text).groupBy("doc_id", "print").agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.count("family").alias("n_licences"),
        F.round(F.max(F.when(F.col("family").isNotNull(), F.col("probability"))), 4).alias("confidence"),
        F.count(F.when(F.col("family").isNull(), 1)).alias("n_unconfirmed"))
    added = ["families", "n_licences", "confidence", "n_unconfirmed"]
    keep = [c for c in without(df, added) if c != text]
    held = df.select(F.struct(*keep).alias("held"), F.col(doc_id).alias("i"), text_print(F.col(text)).alias("p"))
    joined = held.join(found, held.i.eqNullSafe(found.doc_id) & (held.p == found.print), "left")
    return joined.select("held.*", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_licences", F.lit(0)).alias("n_licences"),
                         F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("n_unconfirmed", F.lit(0)).alias("n_unconfirmed"))
