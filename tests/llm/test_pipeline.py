"""The pipeline stage by stage against plain Python on the smallest documents."""

import re

import pytest

import corpus_pipeline
from emberfield.llm.parity_join import shingle_set
from emberfield.llm.quality_rules import RULES, Document, passes
from emberfield.session import materialize
from tests.llm.helpers import awkward, empty

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], FOLDER), name))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "source_mixing", "bpe_tokens"]
    assert all(t.columns == COLUMNS for t in stages[:-1])


def test_quality_and_exact(stages):
    first = {r.doc_id: r.text for r in stages[0].collect()}
    good = {i: t for i, t in first.items() if not (d := Document(t)).base_failed and passes(d, RULES)}
    assert {r.doc_id for r in stages[1].collect()} == set(good)
    seen = {}
    for i in sorted(good):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", good[i]), i)
    assert {r.doc_id for r in stages[2].collect()} == set(seen.values())


def test_near(stages):
    docs = {r.doc_id: shingle_set(r.text, 5) for r in stages[2].collect()}
    root = {i: i for i in docs}
    for i in sorted(docs):
        for j in docs:
            both = len(docs[i] & docs[j])
            if i < j and docs[i] and both * 100 >= 80 * (len(docs[i]) + len(docs[j]) - both):
                old, new = root[j], root[i]
                root = {k: min(old, new) if r in (old, new) else r for k, r in root.items()}
    assert {r.doc_id for r in stages[3].collect()} == set(root.values())


def test_mix_and_tokens(stages):
    before = {r.doc_id: len(r.text.encode().split()) for r in stages[3].collect()}
    taken = {}
    for r in stages[4].collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.encode().split())
    assert set(taken) <= set(before) and all(taken[i] <= 3 * before[i] for i in taken)
    assert sum(taken.values()) == pytest.approx(sum(before.values()), rel=0.02)
    last = stages[5].collect()
    assert len(last) == stages[4].count() and all(r.round_trip and r.n_tokens == len(r.ids) > 0 for r in last)


def test_awkward_and_empty_tables(spark):
    for df in (awkward(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, FOLDER)
            assert out.count() >= 0 and out.columns[:5] == COLUMNS
