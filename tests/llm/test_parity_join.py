import random

import pytest

from emberfield.llm.components import components
from emberfield.llm.parity_join import Similarity, drop_near_copies, lanes_of, near_groups, shingle_hashes, shingle_set
from tests.llm.helpers import AWKWARD, awkward, empty


def brute(rows, like):
    """Component of each row by comparing every pair."""
    sets = [shingle_set(t, like.width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and like.whole * both >= like.share * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        if doc_id is not None and (r not in least or doc_id < least[r]):
            least[r] = doc_id
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr), len({find(i) for i in range(len(rows))})


def near_texts(rnd, n, groups, length):
    """Groups of texts that differ in a few words, around the bound of the similarity."""
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.choice(length))] for _ in range(groups)]
    out = []
    for i in range(n):
        words = list(rnd.choice(bases))
        for _ in range(rnd.randrange(1 + len(words) // 25)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary).upper()
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("like", [Similarity(), Similarity(5, 80, 100)])
def test_components(spark, like):
    rnd = random.Random(like.width)
    rows = near_texts(rnd, 260, 12, [4, 9, 12, 30, 100, 300]) + [(r[0], r[1]) for r in AWKWARD] + [(1000, "One TWO three four five six")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_groups(df, like).collect()
    want, n = brute(rows, like)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == n


def test_bounds_hold():
    """Linked sets share more lanes than are spare, and their sketches are within the bound."""
    import numpy as np

    from emberfield.llm.parity_join import bands_of, bit_sketch, lane_keys

    rnd, like, seen = random.Random(5), Similarity(), 0
    rows = near_texts(rnd, 120, 4, [40, 300])
    hashes = [shingle_hashes(t) for _, t in rows]
    for i, a in enumerate(hashes):
        for b in hashes[:i]:
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both):
                seen += 1
                bands = dict(bands_of(len(a), like)).items() & dict(bands_of(len(b), like)).items()
                assert bands
                shared = [len(np.intersect1d(lane_keys(a, n, h, like), lane_keys(b, n, h, like))) - lanes_of(h, like)[1] for n, h in bands]
                assert max(shared) >= 1
                distance = sum(int(x).bit_count() for x in np.bitwise_xor(bit_sketch(a).view(np.uint64), bit_sketch(b).view(np.uint64)))
                assert distance * 190 <= (len(a) + len(b)) * 10
    assert seen > 50


def test_stage_and_edges(spark):
    df = awkward(spark, "kept")
    got = drop_near_copies(df)
    assert got.columns == df.columns
    # doc 0, 4 and 9 are one component, "short" another; texts without words stay.
    assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted([0, 1, 2, 3, 5, 7, 8], key=repr)
    assert near_groups(empty(spark)).count() == 0 and drop_near_copies(empty(spark)).count() == 0


def test_connected_components(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + rnd.randrange(30), 200 + rnd.randrange(30)) for _ in range(25)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    root = {n: n for link in links for n in link}
    for _ in range(70):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    loose = {a for a, b in links if a == b and all(a not in x or x == (a, a) for x in links)}
    assert got == {n: r for n, r in root.items() if n not in loose}
