"""Held-out quality of the two classifiers, and of the parts of the label model."""

import numpy as np
import pytest

from emberfield.llm import quality_knn, queries, toxicity
from emberfield.llm.labelled import labelled_sample
from tests.llm.helpers import AWKWARD, awkward, empty

FOLDER = "/root/testdata/sf0.01"


def ranked(pairs):
    """Area under the curve of (score, label) pairs."""
    one = np.array([s for s, y in pairs if y == 1])
    zero = np.array([s for s, y in pairs if y == 0])
    return float((one[:, None] > zero).mean() + 0.5 * (one[:, None] == zero).mean())


@pytest.mark.parametrize("name, label, area, right", [
    ("op6_toxicity_weak_supervision", "toxic", 0.85, 0.93), ("op7_quality_neighbours", "quality", 0.97, 0.95)])
def test_held_out_rows(spark, name, label, area, right):
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, FOLDER).collect()}
    assert len(got) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    known = [(got[r.doc_id], r[label]) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()]
    known = [(g, y) for g, y in known if g.held_out]
    assert ranked([(g.score, y) for g, y in known]) >= area
    assert np.mean([g.predicted == y for g, y in known]) >= right
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in got.values())


def test_label_model_finds_rates_and_repeats():
    """Independent voters keep their weight, copies of one voter share theirs."""
    rnd = np.random.default_rng(1)
    truth = rnd.random(6000) < 0.2
    votes = np.column_stack([np.where(truth, rnd.random(6000) < h, rnd.random(6000) < f) for h, f in ((.7, .05), (.6, .1), (.8, .02))])
    votes = np.column_stack([votes, votes[:, 0], votes[:, 0], np.where(truth, rnd.random(6000) < .97, rnd.random(6000) < .01)]).astype(float)
    model = toxicity.fit_label_model(votes, np.clip(votes[:, -1], 0.05, 0.95), np.ones(6000))
    assert model.hit[1] == pytest.approx(0.6, abs=0.06) and model.false[2] == pytest.approx(0.02, abs=0.02)
    assert model.discount[0] < 0.6 < model.discount[1] and model.correlation[0, 3] > 0.9
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.98


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(0, 1, 0), (5, 0, 1), (9, 1, None), (77, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = awkward(spark, "score")
    for label, folds, held in (("quality", 3, 1), ("toxic", 5, 0)):
        sample, counts = labelled_sample(docs, labels, label, folds, held, 10, "sample")
        if label == "toxic":
            got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(sample, counts))
        else:
            got = quality_knn.score_quality(docs, quality_knn.fit_neighbours(quality_knn.collect_terms(sample), counts))
        rows = got.collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    none, counts = labelled_sample(docs, labels.limit(0), "toxic", 5, 0, 10, "sample")
    model = toxicity.fit_toxicity(none, counts)
    insult = spark.createDataFrame([(1, "you idiot, moron"), (2, "a fine day")], "doc_id long, text string")
    high, low = (r.score for r in toxicity.score_toxicity(insult, model).orderBy("doc_id").collect())
    assert high > 0.5 > low
    knn = quality_knn.fit_neighbours(quality_knn.collect_terms(none), counts)
    assert {r.score for r in quality_knn.score_quality(docs, knn).collect()} == {0.5}
    assert quality_knn.score_quality(empty(spark), knn).count() == toxicity.score_toxicity(empty(spark), model).count() == 0
