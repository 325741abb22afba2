from collections import Counter, defaultdict
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberfield.llm.mixing import mix_documents, mixed_blocks, permuted, plan_mix
from tests.llm.helpers import AWKWARD, awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def wanted_targets(sizes):
    """Fill by weight, cap, and share the excess again until nothing is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] >= 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= over


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    for seed in (1, 2):
        assert sorted(permuted(np.arange(n), np.full(n, n), np.full(n, seed))) == list(range(n))


def rows(seed):
    rnd = random.Random(seed)
    source = ["big"] * 30 + ["a", "b", "tiny", None]
    return [(i, " ".join(["w"] * rnd.choice([0, 1, 40, 700])), rnd.choice(source)) for i in range(400)]


def test_targets_and_taken(spark):
    data = rows(1)
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = plan_mix(df.repartition(5), block_words=16).taken().collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.size == len(data[r.doc_id][1].split()) and 0 <= r.taken <= 3 * r.size
    want = wanted_targets(sizes)
    for s, t in want.items():
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 16 + 0.01 * t
    again = plan_mix(df.coalesce(1), block_words=16).taken().collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in got}


def test_texts_of_the_mix(spark):
    df = spark.createDataFrame(rows(2), "doc_id long, text string, source string").withColumn("n_chars", F.length("text"))
    mix = plan_mix(df, block_words=16, slots_per_shard=32)
    taken = {r.doc_id: r.taken for r in mix.taken().collect() if r.taken}
    got = defaultdict(int)
    docs = mix_documents(df, mix)
    assert docs.columns == df.columns
    for r in docs.collect():
        got[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert got == taken
    blocks = mixed_blocks(df, mix).collect()
    assert sum(len(r.words.split()) for r in blocks) == sum(taken.values())
    places = [(r.shard, r.place) for r in blocks]
    assert len(set(places)) == len(places) and {p for _, p in places} <= set(range(32))
    assert sum(r.blocks for r in mix.shard_counts().collect()) == len(blocks)


def test_awkward_rows(spark):
    mix = plan_mix(awkward(spark, "row"))
    got = mix.taken().collect()
    assert len(got) == len(AWKWARD)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
    docs = mix_documents(awkward(spark, "row"), mix)
    assert docs.columns[-1] == "row"
    assert sum(len(WORD.findall(r.text)) for r in docs.collect()) == sum(r.taken for r in got)
    assert plan_mix(empty(spark)).taken().count() == 0 and mix_documents(empty(spark), plan_mix(empty(spark))).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r.taken for r in plan_mix(blank).taken().collect()] == [0, 0]
