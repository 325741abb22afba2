import hashlib
import random
import re

import pytest

from emberfield.llm.exact_dedup import chunks, drop_exact_copies, exact_groups, normalised
from tests.llm.helpers import AWKWARD, awkward, empty


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    out = []
    for body, ids in groups.items():
        known = [i for i in ids if i is not None]
        out += [(i, min(known) if known else None, len(ids), hashlib.sha256(body.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr), len(groups)


@pytest.mark.parametrize("key_bytes", [16, 1])  # one byte: many chunks share a key and are told apart by content
def test_groups(spark, key_bytes):
    rnd = random.Random(key_bytes)
    words = ["".join(rnd.choice("abcdef") for _ in range(rnd.randrange(1, 9))) for _ in range(300)]
    texts = [" ".join(rnd.choices(words, k=rnd.choice([3, 60, 900]))) for _ in range(60)]
    rows = [(i, rnd.choice(texts).replace(" ", rnd.choice([" ", "\n", " \t"]))) for i in range(150)]
    rows += [(r[0], r[1]) for r in AWKWARD]
    got = exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), key_bytes=key_bytes).collect()
    want, n = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == n and all(r.doc_id == r.keep_id for r in got if r.kept and r.keep_id is not None)


def test_chunks_are_content_defined():
    rnd = random.Random(2)
    body = bytes(rnd.randrange(256) for _ in range(60_000))
    assert b"".join(chunks(body)) == body and max(map(len, chunks(body))) <= 16_384
    shared = set(chunks(body)) & set(chunks(b"something before it " + body))
    assert len(shared) >= len(chunks(body)) - 3
    for text in ("", " ", "a", " a b\n", "\n\n"):
        assert normalised(text.encode()).decode() == re.sub(r"[\x20\x09-\x0D]+", " ", text)


def test_kept_rows_keep_their_columns(spark):
    df = awkward(spark, "kept")
    got = drop_exact_copies(df)
    assert got.columns == df.columns
    bodies = sorted(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in got.collect())
    assert bodies == sorted({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in AWKWARD})
    assert drop_exact_copies(empty(spark)).count() == 0 and exact_groups(empty(spark)).count() == 0
