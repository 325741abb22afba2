import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from emberfield.llm import bpe
from emberfield.llm.bpe import Vocabulary, bpe_decode, bpe_encode, byte_letters
from tests.llm.helpers import AWKWARD, awkward, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rnd = random.Random(1)
    out = ["", "  a  b\n\n c ", "<|endoftext|><|endoftext|>x", "a<|endoftext|>", "é" * 3000, "ab" * 2000, "x" * 47 + "é" * 3,
           "\x1c\x1d a\x85b c　 d", "'s't'S 'll", "՘aᲉ" + chr(0x323B0) + "b", " " * 900 + "x", "\x00\x7f", "end  "]
    for _ in range(1500):
        out.append("".join(rnd.choice([chr(rnd.randrange(32, 127)), chr(rnd.randrange(97, 123)), chr(rnd.randrange(0xD7FF)),
                                       chr(rnd.randrange(0xE000, 0x33500)), "<|endoftext|>", " ", "\n", "aa"]) for _ in range(rnd.randrange(50))))
    return out


def test_like_the_library():
    with open(PATH, encoding="utf-8") as file:
        ours, theirs = Vocabulary(file.read()), Tokenizer.from_file(PATH)
    some = texts() + [" ".join(f"w{i * j % 97}x{j}" for j in range(40)) for i in range(300)]
    for text, packed in zip(some, ours.packed_many(some)):
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == memoryview(packed).cast("i").tolist() == ids, text
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False) == text
    assert len(set(byte_letters())) == 256


def test_short_and_long_words_merge_alike():
    with open(PATH, encoding="utf-8") as file:
        ours = Vocabulary(file.read())
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdethinorsé ") for _ in range(rnd.randrange(1, 46))) for _ in range(400)]
    for word, many in zip(words, ours.merge_many(words)):
        parts = [ours.first[b] for b in word.encode()]
        assert ours._merge_short(list(parts)) == ours._merge_long(list(parts)) == memoryview(many).cast("i").tolist()


def test_awkward_rows(spark):
    theirs = Tokenizer.from_file(PATH)
    df = awkward(spark, "decoded")
    got = bpe_decode(bpe_encode(df, PATH), PATH).collect()
    want = sorted(((d, theirs.encode(t or "", add_special_tokens=False).ids, t or "") for d, t, *_ in AWKWARD), key=repr)
    assert sorted(((r.doc_id, list(r.ids), r.decoded) for r in got), key=repr) == want
    assert bpe_decode(bpe_encode(empty(spark), PATH), PATH).count() == 0


def test_rows_are_decoded_in_slices(monkeypatch):
    names = np.array([b"a", b"\xc3", b"\xa9"], object)
    lists = pa.array([[0, 1, 2], None, [], [1], [0] * 5, [2]], pa.list_(pa.int32()))
    want = ["aé", "", "", "�", "aaaaa", "�"]
    for most in (1, 2, 100):
        monkeypatch.setattr(bpe, "DECODE_TOKENS", most)
        assert list(bpe.decoded_rows(names, lists)) == want
        assert list(bpe.decoded_rows(names, lists.slice(2, 3))) == want[2:5]
        assert list(bpe.decoded_rows(names, lists.slice(0, 0))) == []
