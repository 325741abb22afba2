import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberfield.llm import periodic_runs
from emberfield.llm.periodic_runs import Shape, find_runs, plant_repetition, runs_of
from tests.llm.helpers import awkward, empty


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i - q] for i in range(q, len(words))))


def brute_runs(words, shape=Shape()):
    """Every lag over the whole text: maximal matches, kept where the lag is the smallest period."""
    out, n = [], len(words)
    for q in range(1, n // shape.min_exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(shape.min_length, shape.min_exponent * q) and smallest_period(words[i:j + q]) == q:
                out.append((i, j - i + q, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(words):
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    milli = 1000 * best[1] // best[2] if runs else None
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def periodic_texts(rnd, n):
    """Periodic stretches of all kinds: nested, adjacent, powers, broken in one place, next to noise."""
    out = []
    for _ in range(n):
        vocabulary = [f"w{i}" for i in range(rnd.choice([1, 2, 3, 20]))]
        words = []
        for _ in range(rnd.randrange(5)):
            unit = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 40]))]
            if rnd.random() < 0.3:
                unit = unit * rnd.randrange(1, 4)
            part = unit * rnd.randrange(1, 6) + unit[:rnd.randrange(len(unit) + 1)]
            if rnd.random() < 0.3:
                part[rnd.randrange(len(part))] = "broken"
            words += part + [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 0, 1, 5]))]
        out.append(words)
    return out


@pytest.mark.parametrize("shape", [Shape(), Shape(10, 4), Shape(1, 3), Shape(40, 3)])
def test_runs_of_many_documents(shape):
    texts = periodic_texts(random.Random(shape.min_length), 150)
    number = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    ids = np.array([number[w] + d * 1000 for d, t in enumerate(texts) for w in t], np.int64)
    starts = np.cumsum([0, *map(len, texts)])
    got = runs_of(ids, starts, shape)
    assert got == [brute_runs(t, shape) for t in texts]
    assert sum(map(len, got)) > 100


def test_guaranteed_overlap():
    for shape in (Shape(), Shape(10, 4), Shape(40, 3)):
        assert all(max(shape.min_length - q, (shape.min_exponent - 1) * q) >= shape.overlap() >= shape.first_gram() for q in range(1, 300))
    with pytest.raises(ValueError):
        Shape(24, 2)


def test_find_runs(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "WORDS_AT_ONCE", 300)
    texts = periodic_texts(random.Random(8), 120)
    rows = [(i, "  ".join(t) + "\n") for i, t in enumerate(texts)]
    got = find_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[2:9] == brute(texts[r.doc_id])
        assert [tuple(x) for x in r.runs] == brute_runs(texts[r.doc_id])
        assert hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_planted_repetition(spark):
    rnd = random.Random(1)
    rows = [(i, " \t".join(f"w{rnd.randrange(50)}" for _ in range(rnd.choice([0, 1, 2, 30, 400])))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.t.split() for r in df.select("doc_id", plant_repetition(F.col("doc_id"), F.col("text")).alias("t")).collect()}
    assert got == {i: planted(i, t.split()) for i, t in rows}
    assert sum(got[i] != t.split() for i, t in rows) > 8


def test_edges(spark):
    nothing = hashlib.sha256(b"").hexdigest()
    got = {}
    for r in find_runs(awkward(spark, "period"), texts=False).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0].n_runs == got[2][0].n_runs == got[3][0].n_runs == 0
    assert got[1][0].runs_sha256 == got[1][0].collapsed_sha256 == got[3][0].collapsed_sha256 == nothing
    assert len(got[5]) == 2 and got[None][0].start is None
    assert (got[7][0].start, got[7][0].length, got[7][0].period, got[7][0].exponent_milli) == (0, 3000, 1, 3_000_000)
    assert find_runs(empty(spark)).count() == 0
    # Two runs of one exponent: the earlier one; and a very long text with one run at its end.
    twice = "a b " * 12 + "x " + "c d " * 12
    long = " ".join(f"n{i}" for i in range(150_000)) + " " + " ".join(f"m{i % 5000}" for i in range(40_000))
    got = find_runs(spark.createDataFrame([(1, twice), (2, long)], "doc_id long, text string"), texts=False).orderBy("doc_id").collect()
    assert (got[0].n_runs, got[0].start, got[0].period) == (2, 0, 2)
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period) == (1, 150_000, 40_000, 5000)
