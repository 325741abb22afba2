"""Byte-level BPE encoding and decoding with a public vocabulary file.

Each word of the text is held as a contiguous array of part ids with the ranks of adjacent pairs
beside it. The least rank is found by scanning, its boundary is deleted, and the two neighbouring
ranks are refreshed. Words beyond ``LONG_WORD`` bytes hold the same arrays in a heap of pairs, so
that a long run without white space costs n log n instead of n squared; the result is the same.

Defined results: a null text encodes as the empty list and decodes to the empty text; the special
token's string in a text becomes its single id; texts are never cut. An input column named like an
added one is replaced.
"""

from __future__ import annotations

import array
import functools
import heapq
import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from emberfield.llm.common import without

LONG_WORD = 400
#: Words up to this length are merged many at a time, at most ``ROWS`` in one array.
ROW_WORD, ROWS = 48, 20_000
#: Texts that are coded together; each group leaves the task before the next one is read.
GROUP = 512
#: Words and stretches remembered by one task, in two generations of at most this many each.
CACHE_WORDS, CACHE_STRETCHES = 120_000, 40_000
#: Tokens that are decoded together; a longer text is decoded alone.
DECODE_TOKENS = 1 << 18
NO_RANK = 1 << 62
ID_MASK = (1 << 32) - 1

# Letters, then digits, that Unicode assigned after version 16, which the
# vocabulary's tokenizer treats as symbols. Inclusive ranges.
LATER_LETTERS = (
    "558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 "
    "a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee "
    "11b0a-11b0a 11db0-11ddb 11df1-11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff "
    "18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 "
    "1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 "
    "1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead "
    "323b0-33479 3d000-3fc3f")
LATER_DIGITS = "11de0-11de9 1246f-1246f 12475-1247f 12550-12686 16ff4-16ff6"
# Fixed value: the published word pattern of the vocabulary, white space by Unicode property.
PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
          r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

_PIECES = regex.compile(PIECES)
_LATER = regex.compile("[" + "".join(
    "\\U{:08x}-\\U{:08x}".format(*(int(x, 16) for x in r.split("-")))
    for r in (LATER_LETTERS + " " + LATER_DIGITS).split()) + "]")
_STAND_IN = chr(0xE000)  # a private-use symbol: neither letter, digit nor white space


def pieces(text: str) -> list[str]:
    """The words that are merged separately."""
    if not has_later(text):
        return _PIECES.findall(text)
    return [text[slice(*m.span())] for m in _PIECES.finditer(_LATER.sub(_STAND_IN, text))]


def has_later(text: str) -> bool:
    try:
        text.encode("latin-1")  # much faster than a search, and true for most texts
        return False
    except UnicodeEncodeError:
        return _LATER.search(text) is not None


def byte_letters() -> list[str]:
    """The printable character by which the vocabulary file names each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Vocabulary:
    """Merge rules and byte strings of a byte-level BPE vocabulary in the tokenizers JSON format."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, odd = spec["model"], []
        if spec.get("normalizer") or model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            odd.append("not a plain byte-level BPE vocabulary")
        if odd:
            raise ValueError(odd[0])
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        ids = model["vocab"]
        self.first = [ids[c] for c in letters]
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
        # Left and right id -> rank of the merge above the id it makes.
        self.pairs = {ids[a] << 32 | ids[b]: rank << 32 | ids[a + b] for rank, (a, b) in enumerate(model["merges"])}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.bytes_of |= {i: s.encode() for s, i in special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, word: str) -> list[int]:
        parts = [self.first[b] for b in word.encode("utf-8")]
        return self._merge_long(parts) if len(parts) > LONG_WORD else self._merge_short(parts)

    def _merge_short(self, parts: list[int]) -> list[int]:
        get = self.pairs.get
        ranks = [get(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = least & ID_MASK
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | parts[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = get(parts[i] << 32 | parts[i + 1], NO_RANK)
        return parts

    def merge_many(self, words: list[str]) -> list[bytes]:
        """``merge`` for many words: rows of one array per word length are scanned and shortened together."""
        raw = [w.encode("utf-8") for w in words]
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, r in enumerate(raw):
            by_length.setdefault(len(r), []).append(i)
        for length, members in by_length.items():
            if length > ROW_WORD:
                for i in members:
                    out[i] = array.array("i", self.merge(words[i])).tobytes()
                continue
            for start in range(0, len(members), ROWS):
                some = members[start:start + ROWS]
                rows = np.frombuffer(b"".join(raw[i] for i in some), np.uint8).reshape(len(some), length)
                ids, width = self._merge_rows(rows)
                cut = (4 * width).tolist()
                for i, row, end in zip(some, ids, cut):
                    out[i] = row.tobytes()[:end]
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) << 32 | right
        place = np.minimum(np.searchsorted(self.pair_keys, pair), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[place] == pair, self.pair_ranks[place], NO_RANK)

    def _merge_rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Part ids of words of one length, left-aligned, and how many parts each word has."""
        count, length = rows.shape
        ids = np.full((count, length + 1), -1, np.int32)
        ids[:, :length] = np.array(self.first, np.int32)[rows]
        ranks = np.full((count, length + 1), NO_RANK, np.int64)
        if length > 1:
            ranks[:, :length - 1] = self._ranks(ids[:, :length - 1], ids[:, 1:length])
        width, live, column = np.full(count, length), np.arange(count), np.arange(length)
        while len(live):
            at = ranks[live].argmin(1)
            least = ranks[live, at]
            merged = least != NO_RANK
            live, at, least = live[merged], at[merged], least[merged]
            if not len(live):
                break
            # Delete the boundary: everything to its right moves one place to the left.
            ids[live, at] = least & ID_MASK
            ids[live, :length] = np.take_along_axis(ids[live], column + (column > at[:, None]), 1)
            ranks[live, :length] = np.take_along_axis(ranks[live], column + (column >= at[:, None]), 1)
            width[live] -= 1
            right = ids[live, at + 1]
            ranks[live, at] = np.where(right >= 0, self._ranks(ids[live, at], right), NO_RANK)
            inner = at > 0
            row, left = live[inner], at[inner] - 1
            ranks[row, left] = self._ranks(ids[row, left], ids[row, left + 1])
        return ids, width

    def packed_many(self, texts: list[str]) -> list[bytes]:
        """``packed`` of each text; the words of all of them are looked up and merged together."""
        odd = {i for i, t in enumerate(texts) if self.marked(t) or has_later(t)}
        cut = [[] if i in odd else t.split(" ") for i, t in enumerate(texts)]
        here = self._stretches(set().union(*(c[1:] for c in cut)))
        out = []
        for text, (head, *rest) in zip(texts, (c or [""] for c in cut)):
            try:
                if not head or head.strip() != head:
                    raise KeyError
                out.append(self._pieces(head) + b"".join(map(here.__getitem__, rest)))
            except KeyError:  # a stretch that the pattern does not cut alone
                out.append(self.packed(text))
        return out

    def _stretches(self, wanted: set[str]) -> dict[str, bytes]:
        """Ids of stretches between spaces, each with the space before it.

        A stretch between two spaces is independent of the others if it neither is empty nor has
        white space at an end: the pattern gives the space before it to its first word. Others, and
        very long ones, are left out. Stretches seen lately are remembered in two generations.
        """
        recent = self.recent
        new = wanted.difference(recent)
        again = new.intersection(self.older)
        recent.update((s, self.older[s]) for s in again)
        cut = [s for s in new - again if s and len(s) <= LONG_WORD and s.strip() == s]
        if cut:
            words = _PIECES.findall(" " + " ".join(cut))
            known = self._merged(set(words))
            # Within a stretch no word begins with a space, so each space begins the next stretch.
            ids = list(map(known.__getitem__, words))
            begins = [i for i, w in enumerate(words) if w[0] == " "]
            ends = begins[1:] + [len(words)]
            recent.update(zip(cut, [ids[i] if j == i + 1 else b"".join(ids[i:j]) for i, j in zip(begins, ends)]))
        if len(recent) > CACHE_STRETCHES:
            self.older, self.recent = recent, {}
        return recent

    def _merged(self, wanted: set[str]) -> dict[str, bytes]:
        """Ids of words, at least the wanted ones. A word not met for a generation is forgotten."""
        known, older = self.words, self.older_words
        new = wanted.difference(known)
        again = new.intersection(older)
        known.update((w, older[w]) for w in again)
        fresh = list(new - again)
        known.update(zip(fresh, self.merge_many(fresh)))
        self._age_words()
        return known

    def _age_words(self) -> None:
        if len(self.words) > CACHE_WORDS:
            self.older_words, self.words = self.words, {}

    def marked(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def _merge_long(self, parts: list[int]) -> list[int]:
        pairs, n = self.pairs, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p, i, parts[i], parts[i + 1]) for i in range(n - 1)
                if (p := pairs.get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = rank & ID_MASK, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := pairs.get(parts[k] << 32 | parts[after[k]])) is not None:
                    heapq.heappush(heap, (p, k, parts[k], parts[after[k]]))
        return [p for p in parts if p >= 0]

    def packed(self, text: str) -> bytes:
        """The ids as consecutive four-byte integers, which is how words are remembered."""
        if self.marked(text):
            return b"".join(self.special[c].to_bytes(4, sys.byteorder) if c in self.special else self._pieces(c)
                            for c in self.split.split(text))
        return self._pieces(text)

    def _pieces(self, text: str) -> bytes:
        out = []
        for word in pieces(text):
            got = self.words.get(word)
            if got is None:
                got = self.older_words.get(word) or array.array("i", self.merge(word)).tobytes()
                if len(word) <= LONG_WORD:
                    self.words[word] = got
                    self._age_words()
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return array.array("i", self.packed(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        return joined(self.bytes_of, ids)


def joined(bytes_of: dict[int, bytes], ids: list[int]) -> str:
    return b"".join(map(bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def decoded_rows(names: np.ndarray, lists: pa.ListArray) -> Iterator[str]:
    """The text of each list of ids. ``names`` holds the byte string of each id; a null list is the empty text."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    row = low = 0
    while row < len(ends):
        # Whole lists of at most DECODE_TOKENS ids, or one longer list.
        last = max(row + 1, int(np.searchsorted(ends, low + DECODE_TOKENS, "right")))
        high = int(ends[last - 1])
        parts, start = names[ids[low:high]].tolist(), 0
        for end in (ends[row:last] - low).tolist():
            yield b"".join(parts[start:end]).decode("utf-8", "replace")
            start = end
        row, low = last, high


@functools.lru_cache(maxsize=2)
def vocabulary(source: str) -> Vocabulary:
    return Vocabulary(source)


def _spread_vocabulary(df: DataFrame, path: str):
    # A vocabulary file is about two megabytes whatever the input; it is read where the driver is.
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def bpe_encode(df: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` without ``text`` and with ``ids``: the token ids of the whole text."""
    keep = [c for c in without(df, [ids]) if c != text]
    source = _spread_vocabulary(df, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(source.value)
        for batch in batches:
            for start in range(0, batch.num_rows, GROUP):
                part = batch.slice(start, GROUP)
                made = words.packed_many([v or "" for v in part.column(text).to_pylist()])
                ends = np.cumsum([0, *(len(m) // 4 for m in made)])
                flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(made))])
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), column], names=[*keep, ids])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, vocabulary_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with ``text``: the text of the token ids, special tokens included."""
    keep = without(df, [text])
    with open(vocabulary_path, encoding="utf-8") as file:
        # Only the byte strings travel, about a megabyte.
        spread = df.sparkSession.sparkContext.broadcast(Vocabulary(file.read()).bytes_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.empty(max(spread.value) + 1, object)
        for i, name in spread.value.items():
            names[i] = name
        for batch in batches:
            for start in range(0, batch.num_rows, GROUP):
                part = batch.slice(start, GROUP)
                made = pa.array(decoded_rows(names, part.column(ids)), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), made], names=[*keep, text])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), T.StructField(text, T.StringType())]))
