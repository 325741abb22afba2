import hashlib
import random
import zlib

import pytest

from emberfield.llm.conversation_trie import NUMBERS, number_digests, prefix_trie, sequences

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(conversations):
    """Rows of the trie over {conv: [(role, text), ...]} by listing every prefix."""
    members = {}
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    out = []
    for prefix, convs in members.items():
        below = [p for p in members if p[:len(prefix)] == prefix]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].split()) for p in below if p)
        inner = {p[:-1] for p in members if p}
        ends = sorted(c for c in convs if len(conversations[c]) == len(prefix))
        out.append((min(convs), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(convs),
                    sum(len(p) == len(prefix) + 1 for p in below), sum(p not in inner for p in below), saved,
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def ordered(rows):
    """{conv: turns} with turns by number, null first, then by role and digest; null text is empty."""
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))

    def key(t):
        return *t[:3], hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()
    return {c: [t[2:] for t in sorted(turns, key=key)] for c, turns in out.items()}


def rebuilt(conversations, shared, family):
    out = {}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % shared
        out[c] = conversations.get(c - c % family, [])[:h] + turns[h:]
    return out


def random_rows(rnd, n, longest):
    """Conversations over few texts, so that they share first turns; some long, some repeated."""
    rows = []
    for conv in range(n):
        turns = rnd.choice([0, 1, 2, 3, 4, 5, 8, 9, longest])
        for t in range(turns):
            text = f"text {'x ' * rnd.randrange(3)}" if rnd.random() < 0.15 else "common first words"
            rows.append((conv * 3, t, ("user", "assistant")[t % 2], text))
    return rows


@pytest.mark.parametrize("longest", [1, 2, 7, 16, 33])
def test_trie(spark, longest):
    rows = [r for r in random_rows(random.Random(longest), 60, longest) if r[1] < longest]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = prefix_trie(sequences(df)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(ordered(rows))


def test_rebuilt_conversations(spark):
    rnd = random.Random(5)
    rows = [(c, t, "user", f"t{rnd.randrange(3)}") for c in rnd.sample(range(100), 70) if c not in (20, 60) for t in range(rnd.randrange(1, 4))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = prefix_trie(sequences(df, shared=4, family=20)).collect()
    want = rebuilt(ordered(rows), 4, 20)
    assert any(not turns for turns in want.values())
    assert sorted(map(tuple, got), key=repr) == brute(want)


def test_edges(spark):
    long = "word " * 100_000
    rows = [(1, 1, "user", "a"), (1, None, None, None), (1, 1, "user", "a"), (1, 1, "assistant", "b"), (2, 5, "user", None),
            (None, 1, "user", "left out"), (3, 1, "user", long), (4, 1, "user", long), (4, 2, "", ""), (-7, 1, "user", "a")]
    df = spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA + ", conv string").selectExpr("*", "'x' AS seq", "1 AS depth")
    got = prefix_trie(sequences(df)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(ordered(rows))
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(sequences(none)).count() == 0 and prefix_trie(sequences(none, shared=4)).count() == 0


def test_numbers_of_one_node_in_many_ranges(spark):
    ids = random.Random(3).sample(range(-3 * NUMBERS, 8 * NUMBERS), 20_000)
    df = spark.createDataFrame([(bytearray(b"k" if i % 4 else b"m"), i) for i in ids], "key binary, conv long").repartition(6)
    got = {bytes(r.key): r.sha256 for r in number_digests(df).collect()}
    for key in (b"k", b"m"):
        listed = ",".join(str(i) for i in sorted(ids) if (b"k" if i % 4 else b"m") == key)
        assert got[key] == hashlib.sha256(listed.encode()).hexdigest()


def test_copies_of_one_conversation(spark):
    """Many copies are one sequence: the trie has one path, whatever their number."""
    rows = [(c, t, "user", f"turn {t}") for c in range(500) for t in range(5)]
    got = prefix_trie(sequences(spark.createDataFrame(rows, SCHEMA))).orderBy("depth").collect()
    assert [(r.depth, r.n_convs, r.n_leaves, r.saved_tokens) for r in got] == [(d, 500, 1, 499 * 2 * (5 - max(d - 1, 0))) for d in range(6)]
