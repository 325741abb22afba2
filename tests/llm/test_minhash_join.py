import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberfield.llm import minhash_join
from emberfield.llm.minhash_join import COORDINATES, drop_near_duplicates, near_components, signature, signature_bytes
from emberfield.llm.parity_join import Similarity, shingle_hashes
from tests.llm.helpers import AWKWARD, awkward, empty
from tests.llm.test_parity_join import brute, near_texts


@pytest.mark.parametrize("like", [Similarity(2, 80, 100), Similarity(5, 80, 100)])
def test_components(spark, like):
    rnd = random.Random(like.width)
    rows = near_texts(rnd, 260, 12, [4, 9, 12, 30, 100, 300]) + [(r[0], r[1]) for r in AWKWARD] + [(1000, "One TWO three four five six")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_components(df, like).collect()
    want, n = brute(rows, like)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == n


def chain(rnd, n, length, step):
    """Texts of which each differs from the one before in one place: only neighbours are linked."""
    words = [f"c{rnd.random()}" for _ in range(length)]
    out = []
    for i in range(n):
        for j in range(step):
            words[(i * step + j) % length] = f"x{i}-{j}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("centres", [1, 4])
def test_chains_and_common_passages(spark, monkeypatch, centres):
    """Links that no centre meets are found, whatever the number of centres."""
    monkeypatch.setattr(minhash_join, "CENTRES", centres)
    rnd = random.Random(11)
    texts = chain(rnd, 60, 60, 2) + chain(rnd, 40, 80, 3)
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [f"{passage} own{i} word{i} here{i}" for i in range(60)] + [f"{passage} {' '.join(f't{i}-{j}' for j in range(120))}" for i in range(60)]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want, n = brute(rows, minhash_join.PAIRS_OF_WORDS)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == n


def test_large_groups_are_dealt_out(spark, monkeypatch):
    """A centre with many partners is sent to several groups, with the same links."""
    monkeypatch.setattr(minhash_join, "GROUP", 7)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:i % 50] + [f"v{i}"] + base[i % 50 + 1:])) for i in range(80)]
    got = near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and sum(r.n_links for r in got) >= 2 * 79


def test_linked_sets_collide_often():
    """Collisions of linked sets stay above the match threshold, and bytes count at least the equal values."""
    rnd, like, least, seen = random.Random(2), minhash_join.PAIRS_OF_WORDS, COORDINATES, 0
    hashes = [shingle_hashes(t, like.width) for _, t in near_texts(rnd, 200, 5, [9, 40, 300])]
    signed = [signature(h) for h in hashes]
    for i, a in enumerate(hashes):
        for j, b in enumerate(hashes[:i]):
            both = len(np.intersect1d(a, b))
            equal = int((signed[i] == signed[j]).sum())
            bytes_ = int((signature_bytes(signed[i]).view(np.uint8) == signature_bytes(signed[j]).view(np.uint8)).sum())
            assert bytes_ >= equal
            if 100 * both >= 80 * (len(a) + len(b) - both):
                seen, least = seen + 1, min(least, equal)
    assert seen > 500 and least > minhash_join.LEAST_MATCHES


def test_byte_count(spark):
    rnd = np.random.default_rng(4)
    a, b = rnd.integers(0, 256, (2, 200, COORDINATES), dtype=np.uint8)
    b[rnd.random(b.shape) < 0.5] = 0
    a[rnd.random(a.shape) < 0.3] = 255
    b[:, ::3] = a[:, ::3]
    rows = [tuple(x.view(np.int64).tolist()) + tuple(y.view(np.int64).tolist()) for x, y in zip(a, b)]
    words = COORDINATES // 8
    df = spark.createDataFrame(rows, ", ".join(f"a{i} long" for i in range(words)) + ", " + ", ".join(f"b{i} long" for i in range(words)))
    pair = [F.struct(*[F.col(f"{side}{i}").alias(f"s{i}") for i in range(words)]) for side in "ab"]
    got = [r[0] for r in df.select(minhash_join._collisions(*pair)).collect()]
    assert sorted(got) == sorted((a == b).sum(axis=1).tolist())


def test_edges(spark):
    df = awkward(spark, "component_id")
    got = drop_near_duplicates(df)
    assert got.columns == df.columns
    # doc 0, 4 and 9 are one component, "short" another; texts without words stay.
    assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted([0, 1, 2, 3, 5, 7, 8], key=repr)
    assert near_components(empty(spark)).count() == 0 and drop_near_duplicates(empty(spark)).count() == 0
    long = " ".join(f"w{i % 9973}-{i % 31}" for i in range(200_000))
    rows = [(1, long), (2, long + " more"), (3, None), (4, ""), (None, "a b c"), (None, "a b c"), (9, "A b C")]
    got = near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == sorted(
        [(1, 1), (2, 1), (3, 3), (4, 4), (None, 9), (None, 9), (9, 9)], key=repr)


@pytest.mark.parametrize("part", [1, 3, 1000])
def test_long_lists_meet_in_parts(spark, monkeypatch, part):
    """Pairs of different components are found once each, however many parts a list has."""
    monkeypatch.setattr(minhash_join, "LIST_PART", part)
    rnd = random.Random(part)
    rows = list(enumerate(chain(rnd, 40, 60, 2)))
    signed = minhash_join._signed(spark.createDataFrame(rows, "doc_id long, print string").withColumn(
        "text", F.col("print")), minhash_join.PAIRS_OF_WORDS).collect()
    docs = spark.createDataFrame([(r.doc_id, (r.n_shingles, *r.bytes, *r.parity)) for r in signed], "row long, doc struct<" + ", ".join(
        f"{name}: long" for name in minhash_join._FIELDS) + ">")
    members = spark.range(40).selectExpr("explode(array(7L, 8L + id % 2)) AS key", "id AS row", "id div 2 AS component")
    got = sorted(tuple(r) for r in minhash_join._open_pairs(members, docs, minhash_join.PAIRS_OF_WORDS, 12).collect())
    spread = minhash_join._open_pairs(members.where("key = 7"), docs, minhash_join.PAIRS_OF_WORDS, 0).collect()
    assert got == sorted(set(got)) and {(i, i + 1) for i in range(1, 39, 2)} <= set(got) <= {tuple(r) for r in spread}
    assert not any(a // 2 == b // 2 for a, b in got)


def test_condition_of_pairs_is_compiled(spark):
    """Past 8000 bytes the JVM interprets a method, and pairs take fifty times as long."""
    docs = spark.createDataFrame([], "row long, doc struct<" + ", ".join(f"{name}: long" for name in minhash_join._FIELDS) + ">")
    members = spark.createDataFrame([], "key long, row long, component long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = minhash_join._open_pairs(members, docs, minhash_join.PAIRS_OF_WORDS, 12)
        plans = found._jdf.queryExecution().debug().codegenToSeq()
        sizes = [plans.apply(i)._3().maxMethodCodeSize() for i in range(plans.size())]
        joins = [i for i in range(plans.size()) if "SortMergeJoin" in plans.apply(i)._1()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert joins and max(sizes) < 8000
