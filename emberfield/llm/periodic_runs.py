"""Periodic runs of words by seed and extend along diagonals.

A run is a maximal stretch of words with smallest period q whose length is at least
``max(min_length, min_exponent * q)``. Shifted by q it agrees with itself over
``max(min_length - q, (min_exponent - 1) * q)`` words, never fewer than the guaranteed overlap of all
periods, so every run shows up as a repeated k-gram of that many words: the seed. Longer periods guarantee
longer overlaps, so k doubles from band to band, and the band of k looks for the lags above k/2 up to k
(the first band for all lags up to k). Inside a run of period q <= k, a k-gram recurs after exactly q words
and never earlier, so only neighbouring occurrences of a k-gram are paired: the pairs of a band are at
most as many as the words, however often a passage repeats.

Pairs are taken along their diagonals (one lag each, by position). A table with one entry per lag holds
how far the extensions of that lag have covered the document; a pair below that mark lies in a match that
was extended before. Every other pair is extended word by word to both sides. Words are compared by number,
so seeds and extensions are exact. A stretch whose first period is itself a power of a shorter word
sequence is left to the band of the shorter period.

Many documents are indexed together, as numpy arrays over the words of up to ``WORDS_AT_ONCE`` words (a
longer document alone): words are numbered per document, so no k-gram spans two of them or recurs in
another one.

Defined results: null or empty text, or text without words, has no run, an empty collapsed text and the
digest of an empty list; a null doc_id and repeated rows are documents of their own; very long texts are
taken whole; of runs with equal exponent the earliest, then the shortest period is the strongest; an empty
table gives an empty result. Only the text column is read, all columns of the table stay, and a column whose
name clashes with a result column is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberfield.llm.common import WORD, bounded_slices, document_bytes, to_arrow, without

#: Words of documents that are indexed together.
WORDS_AT_ONCE = 200_000


@dataclass(frozen=True)
class Shape:
    """What counts as a run. From three periods on, a run guarantees an overlap of two, as the bands need."""

    min_length: int = 24
    min_exponent: int = 3

    def __post_init__(self) -> None:
        if self.min_length < 1 or self.min_exponent < 3:
            raise ValueError("a run needs a positive length and at least three periods")

    def overlap(self) -> int:
        """Least number of words on which a run and its copy one period later agree, over all periods."""
        return min(max(self.min_length - q, (self.min_exponent - 1) * q) for q in range(1, self.min_length + 1))

    def first_gram(self) -> int:
        """Length of the seeds of the first band: a power of two within the guaranteed overlap."""
        return 1 << (self.overlap().bit_length() - 1)


RUNS = Shape()


def _ranks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each value, and how often it occurs."""
    _, rank, count = np.unique(codes, return_inverse=True, return_counts=True)
    return rank, count[rank]


def neighbour_pairs(ids: np.ndarray, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, lags) of neighbouring occurrences of k-grams, band by band, by lag and position.

    ``ids`` are word numbers that differ between documents. A k-gram goes on to 2k only where both of
    its halves recur, so positions without any repetition drop out early.
    """
    n = len(ids)
    name, count = _ranks(ids)
    at = np.flatnonzero(count > 1)
    # Name of the k-gram at each position; -1 where it occurs once.
    names = np.where(count > 1, name, -1)
    k, first = 1, shape.first_gram()
    while len(at):
        if k >= first:
            order = np.lexsort((at, names[at]))
            here, name = at[order], names[at][order]
            lag = np.diff(here)
            wanted = (name[1:] == name[:-1]) & (lag <= k) & ((lag > k // 2) | (k == first))
            place, lag = here[:-1][wanted], lag[wanted]
            order = np.lexsort((place, lag))
            yield place[order], lag[order]
        at = at[at + 2 * k <= n]
        second = names[at + k]
        at, second = at[second >= 0], second[second >= 0]
        if not len(at):
            return
        rank, count = _ranks(names[at].astype(np.int64) * (n + 1) + second)
        names = np.full(n, -1)
        names[at[count > 1]] = rank[count > 1]
        at = at[count > 1]
        k *= 2


def _agree(ids: np.ndarray, a: int, b: int, most: int, step: int) -> int:
    """Words that agree from positions ``a`` and ``b`` on, forward or backward, ``most`` at most."""
    done, width = 0, 32
    while done < most:
        width = min(2 * width, most - done)
        if step > 0:
            x, y = ids[a + done:a + done + width], ids[b + done:b + done + width]
        else:
            x = ids[a - done - width + 1:a - done + 1][::-1]
            y = ids[b - done - width + 1:b - done + 1][::-1]
        differ = x != y
        if differ.any():
            return done + int(differ.argmax())
        done += width
    return done


def _primitive(unit: np.ndarray) -> bool:
    """Whether a word sequence is not a shorter one repeated: no rotation by n/p leaves it, p prime."""
    n = rest = len(unit)
    p = 2
    while p * p <= rest:
        if rest % p == 0:
            while rest % p == 0:
                rest //= p
            if np.array_equal(np.roll(unit, n // p), unit):
                return False
        p += 1
    return rest == 1 or not np.array_equal(np.roll(unit, n // rest), unit)


def runs_of(ids: np.ndarray, starts: np.ndarray, shape: Shape = RUNS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each document, by start and period.

    Document d has the words ``ids[starts[d]:starts[d + 1]]``; word numbers differ between documents.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(starts) - 1)]
    for places, lags in neighbour_pairs(ids, shape):
        if not len(places):
            continue
        document = np.searchsorted(starts, places, side="right") - 1
        # The first pair of each unbroken stretch on a diagonal; the others are below its furthest mark.
        new = np.ones(len(places), bool)
        new[1:] = (lags[1:] != lags[:-1]) | (places[1:] != places[:-1] + 1)
        furthest: dict[int, int] = {}
        for place, lag, d in zip(places[new].tolist(), lags[new].tolist(), document[new].tolist()):
            if place < furthest.get(lag, 0):
                continue
            low, high = int(starts[d]), int(starts[d + 1])
            right = place + _agree(ids, place, place + lag, high - place - lag, 1)
            left = place - _agree(ids, place - 1, place + lag - 1, place - low, -1)
            furthest[lag] = right
            length = right - left + lag
            if length >= max(shape.min_length, shape.min_exponent * lag) and _primitive(ids[left:left + lag]):
                found[d].append((left - low, length, lag))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact exponent; of equal ones the earliest, then the shortest period."""
    def compare(x: tuple[int, int, int], y: tuple[int, int, int]) -> int:
        more = y[1] * x[2] - x[1] * y[2]
        return more or (x[0] - y[0]) or (x[2] - y[2])
    return min(runs, key=cmp_to_key(compare)) if runs else None


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay when every run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


#: Of each document: all runs, the strongest one (nulls without any), and what stays of the text.
_RESULT = T.StructType([
    T.StructField("n_runs", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("period", T.LongType()), T.StructField("exponent_milli", T.LongType()),
    T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())])
_RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
_TEXTS = T.StructType([T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])


def _result(words: list[bytes], runs: list[tuple[int, int, int]], texts: bool) -> tuple:
    best = strongest(runs)
    chosen = (*best, 1000 * best[1] // best[2]) if best else (None, None, None, None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = words if not runs else [w for w, stays in zip(words, kept_words(len(words), runs).tolist()) if stays]
    collapsed = b" ".join(kept)
    row = (len(runs), *chosen, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())
    if not texts:
        return row
    return *row, [dict(zip(("start", "length", "period"), r)) for r in runs], collapsed.decode("utf-8")


def _results(documents: Iterable[list[bytes]], shape: Shape, texts: bool) -> Iterator[tuple]:
    """One result per document. All words of a group are numbered in one table, then apart by document."""
    def flush(group: list[list[bytes]]) -> Iterator[tuple]:
        number: dict[bytes, int] = {}
        sizes = np.array([0, *map(len, group)])
        starts = np.cumsum(sizes)
        flat = np.fromiter((number.setdefault(w, len(number)) for words in group for w in words), np.int64, int(starts[-1]))
        ids = flat + np.repeat(np.arange(len(group)), sizes[1:]) * (len(number) + 1)
        for words, runs in zip(group, runs_of(ids, starts, shape)):
            yield _result(words, runs, texts)

    group: list[list[bytes]] = []
    held = 0
    for words in documents:
        if group and held + len(words) > WORDS_AT_ONCE:
            yield from flush(group)
            group, held = [], 0
        group.append(words)
        held += len(words)
    if group:
        yield from flush(group)


def find_runs(df: DataFrame, text: str = "text", shape: Shape = RUNS, texts: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``df`` with the number of runs, its strongest run, the digests of the list of runs and of the text
    without repetitions, and with ``texts`` also the runs and that text themselves.

    A word is left out if any run holds it after that run's first period.
    """
    added = T.StructType([*_RESULT.fields, *(_TEXTS.fields if texts else [])])
    keep = without(df, added.names) if keep is None else keep
    sent = df.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*[sent.schema[c] for c in keep], *added.fields])
    kinds = to_arrow(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # The words of a batch of long texts are not held at once.
            for batch in bounded_slices(whole, ["__text"]):
                documents = (document_bytes(x.as_py()).split() for x in batch.column("__text"))
                made = list(zip(*_results(documents, shape, texts)))
                arrays = [batch.column(c) for c in keep] + [pa.array(v, kind) for v, kind in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *added.names])

    return sent.mapInArrow(run, schema)


def plant_repetition(doc_id: Column, text: Column) -> Column:
    """Text whose end repeats, for every tenth document by the checksum of its number.

    With h the checksum, g = floor(h / 10), a = g mod n and p = 1 + floor((n - a) / (3 + g mod 8)), each
    word i >= a becomes the word a + (i - a) mod p. Other texts, also those of a null number, stay as they are.
    """
    checksum = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(checksum / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1).cast("long") + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        source = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
        return F.array_join(F.transform(source, lambda i: F.get(words, i.cast("int"))), " ")

    # A one-element array names the words once, so that the text is cut only once.
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    planted = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(text))[0]
    return F.when((checksum % 10 == 0) & text.isNotNull(), planted).otherwise(text)

