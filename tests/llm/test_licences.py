import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberfield.llm.licences import (
    ACROSS, GATE, NAMES, OTHER_ROWS, SIZES, STATED, STEP, TEMPLATES, WINDOW, best_threshold, find_licences, fit_licences,
    gram_lifts, licences_of_documents, ordinary_lines, tokens)
from tests.llm.helpers import AWKWARD, awkward, empty

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def model(spark):
    return fit_licences(spark.read.parquet(DOCUMENTS))


def test_every_statement_passes_the_gate():
    assert all(re.search(GATE, t) for ts in TEMPLATES.values() for t in ts)


SHORT = {"Released under CC0 1.0.": "CC0", "CC-BY-SA 4.0": "CC-BY-SA", "CC-BY-4.0": "CC-BY", "Published under CC-BY-SA 4.0": "CC-BY-SA",
         "Released under the MIT.": "MIT", "Licensed under CC-BY-NC-4.0.": "CC-BY-NC", "Released under the BSD": "BSD"}


def test_lifts_bound_the_odds():
    rng = np.random.default_rng(5)
    vocabulary = ["a", "b", "c", "d", "a b", "b c", "c d", "a b c", "x y"]
    weights, biases = rng.normal(size=(4, 9)) * (rng.random((4, 9)) < 0.5), np.array([-2.0, -1.5, -3.0, 0.0])
    lift, margin = gram_lifts(vocabulary, weights, biases, 3)
    for _ in range(500):
        words = rng.choice(list("abcdxyz"), rng.integers(0, 6)).tolist()
        held = {" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)}
        scores = biases + weights[:, [i for i, g in enumerate(vocabulary) if g in held]].sum(axis=1)
        assert np.logaddexp.reduce(scores[:3] - scores[3]) <= margin + sum(lift.get(g, 0.0) for g in held)


def test_threshold():
    assert 0.4 < best_threshold([0.9, 0.8, 0.7], [0.1, 0.4]) < 0.7
    assert best_threshold([], [0.2]) == 0.5
    # One ordinary row in four above a licence: either error costs the same rate or more.
    assert 0.3 < best_threshold([0.6, 0.9], [0.1, 0.2, 0.3, 0.7]) < 0.6


def test_bound_skips_nothing(spark, model):
    """Stretches that the bound takes for ordinary are so for the classifier too."""
    df = spark.read.parquet(DOCUMENTS).limit(300).select(F.explode(F.split(F.lower("text"), "\n")).alias("t"))
    made = spark.createDataFrame([(t,) for t in (*SHORT, *STATED_FORMS, *WRAPPED, "", "under the rain")], "t string")
    words = df.union(made).select(tokens(F.lower("t")).alias("words")).where("size(words) > 0")
    judged = model.predict(words.withColumn("passed", model.may_hold(F.col("words"))))
    over = (F.col("probability") >= model.least).alias("over")
    got = {(r.passed, r.over): r["count"] for r in judged.groupBy("passed", over).count().collect()}
    assert (False, True) not in got and (False, False) in got and (True, True) in got
    assert model.margin < 0 and WINDOW < SIZES and max(w for w, _ in ACROSS) < SIZES and STEP < WINDOW


STATED_FORMS = {
    "MIT License": "MIT", "Released under Apache-2.0": "Apache-2.0", "Licensed under LGPL-2.1": "LGPL", "GPLv3": "GPL-3.0",
    "licensed under GPLv2": "GPL-2.0", "This software is MIT licensed.": "MIT", "Sous licence MIT": "MIT",
    "Licenciado bajo la licencia MIT": "MIT", "Lizenziert unter der MIT-Lizenz": "MIT"}


def test_stated_forms(spark, model):
    texts = [*STATED_FORMS, "Licensed under the EUPL", "The wealthy lawyer went under the mit building to release the dog"]
    got = licences_of_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    rows = {texts[r.doc_id]: (r.families, r.n_unconfirmed > 0) for r in got}
    assert {t: rows[t][0] for t in STATED_FORMS} == STATED_FORMS
    assert rows[texts[-2]] == ("", True) and rows[texts[-1]] == ("", False)
    assert set(NAMES) <= set(TEMPLATES)


def test_very_long_text(spark, model):
    """Half a million words in one paragraph of many lines: every statement is found."""
    long = ("word of a plain line\n" * 1000 + "Licensed under the MIT License.\n") * 100
    got = licences_of_documents(spark.createDataFrame([(1, long)], "doc_id long, text string"), model).first()
    assert (got.families, got.n_licences) == ("MIT", 100)


def test_ordinary_lines_span_all_documents(spark):
    long = "\n".join(f"line number {i} of the one long document" for i in range(3 * OTHER_ROWS))
    texts = [(long,), *[("the same line again and again",)] * 50, *[(f"a short document with number {i}",) for i in range(3 * OTHER_ROWS)]]
    got = [[r.line for r in ordinary_lines(spark.createDataFrame(some, "text string").repartition(n)).collect()]
           for some, n in ((texts, 1), (texts[::-1], 5))]
    assert got[0] == got[1] and len(set(got[0])) == OTHER_ROWS
    assert OTHER_ROWS // 3 < sum(x.startswith("line") for x in got[0]) < 2 * OTHER_ROWS // 3
    assert ordinary_lines(spark.createDataFrame([(None,), ("",)], "text string")).count() == 0


def test_short_forms(spark, model):
    got = licences_of_documents(spark.createDataFrame(list(enumerate(SHORT)), "doc_id long, text string"), model)
    assert {list(SHORT)[r.doc_id]: r.families for r in got.collect()} == SHORT


GPL = ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
       "the Free Software Foundation; either version {} of the License, or\n(at your option) any later version.")
WRAPPED = {
    "Licensed under the\nMIT License.": "MIT", "Licensed under\nthe MIT\nLicense.": "MIT", "a\n\nb\n\nLicensed under the\r\nMIT License.\n\nc": "MIT",
    GPL.format(3): "GPL-3.0", GPL.format(2): "GPL-2.0", "Released under the GNU General Public License\nv2": "GPL-2.0",
    "This work is licensed under the GNU General Public License, version 3.\nLicensed under the\nMIT License.": "GPL-3.0,MIT",
    "The rain fell\non the old town. " * 40 + "\n" + GPL.format(3) + "\n" + "The rain fell\non the old town. " * 40: "GPL-3.0",
    "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles (the "
    '"Software"), to deal in the Software without\nrestriction, including without limitation the rights to use,\ncopy, modify, merge, publish, '
    "distribute, sublicense, and/or\nsell copies of the Software": "MIT"}


def test_wrapped_statements(spark, model):
    assert max(map(len, STATED)) <= max(width - step for width, step in ACROSS)
    df = spark.createDataFrame(list(enumerate(WRAPPED)), "doc_id long, text string")
    got = {list(WRAPPED)[r.doc_id]: (r.families, r.n_licences) for r in licences_of_documents(df, model).collect()}
    assert got == {t: (f, f.count(",") + 1) for t, f in WRAPPED.items()}


def test_families(spark, model):
    texts = {
        "Intro\nReleased under the MIT License.\nmore": "MIT", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.": "Apache-2.0",
        "x\nThis work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.": "CC-BY-NC,GPL-3.0",
        "He lost his driving licence last year.": "", "All rights reserved. Copyright by the authors.": "", "no such words here": "",
        "word " * 200 + "Licensed under the Mozilla Public License, Version 2.0. " + "word " * 200: "MPL-2.0"}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licences_of_documents(df, model).collect()}
    assert [got[i].families for i in range(len(texts))] == list(texts.values())
    assert find_licences(df, model).where("family = 'MIT'").count() == 1


def test_given_documents(spark, model):
    """Against the plain statements that the documents hold."""
    plain = {"MIT": r"mit\W+license", "Apache-2.0": r"apache\W+license", "GPL-3.0": r"gnu\W+general\W+public\W+license", "CC-BY-NC": r"cc\W+by\W+nc"}
    df = spark.read.parquet(DOCUMENTS).select("doc_id", "text")
    got = {r.doc_id: r.families for r in licences_of_documents(df, model).collect()}
    for r in df.collect():
        assert got[r.doc_id] == ",".join(sorted(k for k, p in plain.items() if re.search(p, r.text.lower())))


def test_awkward_rows(spark, model):
    got = licences_of_documents(awkward(spark, "families"), model)
    assert got.count() == len(AWKWARD) and {r.families for r in got.collect()} == {""}
    assert licences_of_documents(empty(spark), model).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
