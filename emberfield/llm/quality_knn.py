"""Text quality by votes of the nearest labelled documents.

A text becomes counts of language-independent terms: word shapes (letters as x or X, digits as 9,
runs collapsed, punctuation kept), short words, and markers for words and lines that repeat. Inverse
document frequency and a truncated singular value decomposition of the labelled sample turn them into
latent-semantic vectors. The labelled vectors, at most ``2 * SAMPLE_PER_CLASS`` of ``DIMENSIONS`` numbers,
are broadcast; every document is compared with all of them in exact blocked cosine products, and the
nearest vote with the power of their similarity as weight.

Defined results: a text without terms has the zero vector and gets the share of label 1; repeated rows
score alike; without any labelled row every score is 0.5. No input but the text is used for a score.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberfield.llm.common import document_bytes, per_row, without

SAMPLE_PER_CLASS = 2000
TERMS, DIMENSIONS, NEIGHBOURS, SHARPNESS = 1024, 48, 15, 8
BLOCK = 512
_SHAPE = bytes(ord("X") if 65 <= b <= 90 else ord("x") if 97 <= b <= 122 or b >= 128 else ord("9") if 48 <= b <= 57 else b
               for b in range(256))
_RUNS = re.compile(rb"x{2,}|X{2,}|9{2,}")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@functools.lru_cache(maxsize=200_000)
def _place(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) % TERMS


def terms_of(text: str | None) -> Counter[int]:
    """Hashed term counts of the whole text."""
    raw = document_bytes(text)
    words = raw.translate(_LOWER).split()
    out: Counter[int] = Counter()
    for shape, n in Counter(_RUNS.sub(lambda m: m[0][:1], raw.translate(_SHAPE)).split()).items():
        out[_place(b"s" + shape)] += n
    counts = Counter(words)
    for word, n in counts.items():
        if len(word) <= 3:
            out[_place(b"w" + word)] += n
    if words:
        pairs = Counter(zip(words, words[1:]))
        again = sum(n for n in pairs.values() if n > 2)
        lines = [line for line in raw.split(b"\n") if line.strip()]
        out[_place(b"repeated")] += again
        out[_place(b"lines again")] += (len(lines) - len(set(lines))) * len(words) // max(1, len(lines))
        out[_place(b"one word")] += max(0, max(counts.values()) - len(words) // 8)
    return +out


def rows_matrix(counts: list[Counter[int]]) -> np.ndarray:
    """Square-root damped shares of the terms, one row per text."""
    matrix = np.zeros((len(counts), TERMS), np.float32)
    for row, c in zip(matrix, counts):
        if c:
            row[list(c.keys())] = np.fromiter(c.values(), np.float32, len(c))
    total = matrix.sum(1, keepdims=True)
    return np.sqrt(matrix / np.maximum(total, 1))


@dataclass(frozen=True)
class Neighbours:
    """Everything that is broadcast; the arrays are bounded by the sample."""

    weight: np.ndarray  # inverse document frequency
    basis: np.ndarray   # TERMS x DIMENSIONS
    vectors: np.ndarray  # sample x DIMENSIONS, unit length
    labels: np.ndarray
    mass: np.ndarray    # rows of the label that one sampled row stands for
    share: float

    def project(self, matrix: np.ndarray) -> np.ndarray:
        latent = (matrix * self.weight) @ self.basis
        length = np.linalg.norm(latent, axis=1, keepdims=True)
        return np.where(length > 1e-9, latent / np.maximum(length, 1e-9), 0)

    def score(self, counts: list[Counter[int]]) -> np.ndarray:
        out = np.full(len(counts), self.share)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for start in range(0, len(counts), BLOCK):
            latent = self.project(rows_matrix(counts[start:start + BLOCK]))
            cosine = latent @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** SHARPNESS * self.mass[near]
            total = weight.sum(1)
            voted = (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-12)
            out[start:start + BLOCK] = np.where(total > 1e-12, np.clip(voted, 0, 1), self.share)
        return out


def fit_neighbours(sample: list[tuple[list[int], list[int], int]], counts: dict[int, int]) -> Neighbours:
    """From (terms, their counts, label) of the labelled sample and the rows of each label."""
    labels = np.array([s[2] for s in sample], np.float32)
    matrix = rows_matrix([Counter(dict(zip(s[0], s[1]))) for s in sample])
    weight = np.log((1 + len(sample)) / (1 + (matrix > 0).sum(0))).astype(np.float32) + 1
    weighted = (matrix * weight).astype(np.float64)
    _, directions = np.linalg.eigh(weighted.T @ weighted)
    basis = directions[:, ::-1][:, :DIMENSIONS].astype(np.float32)
    held = {v: max(1, int((labels == v).sum())) for v in (0, 1)}
    mass = np.array([counts.get(int(v), 0) / held[int(v)] for v in labels], np.float32)
    everything = sum(counts.values())
    empty = Neighbours(weight, basis, np.zeros((0, DIMENSIONS), np.float32), labels, mass,
                       counts.get(1, 0) / everything if everything else 0.5)
    return Neighbours(weight, basis, empty.project(matrix).astype(np.float32), labels, mass, empty.share)


def collect_terms(sample: DataFrame) -> list[tuple[list[int], list[int], int]]:
    """Term counts of a bounded labelled sample (doc_id, text, label), in the order of the ids."""
    added = T.StructType([T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])

    def run(values: Iterator[tuple]) -> Iterator[tuple]:
        for (text,) in values:
            c = terms_of(text)
            yield list(c.keys()), list(c.values())

    rows = per_row(sample, ["text"], added, run, keep=["doc_id", "label"]).collect()
    return [(r.terms, r.times, r.label) for r in sorted(rows, key=lambda r: (r.doc_id, r.terms))]


def score_quality(df: DataFrame, model: Neighbours, text: str = "text", score: str = "score") -> DataFrame:
    """``df`` without ``text`` and with ``score``, from 0 to 1."""
    keep = [c for c in without(df, [score]) if c != text]
    spread = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.column(text).slice(start, BLOCK)
                scores[start:start + BLOCK] = spread.value.score([terms_of(v.as_py()) for v in part])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores)], names=[*keep, score])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(score, T.DoubleType())])
    return df.mapInArrow(run, schema)


def predicted(score: str = "score"):
    return F.when(F.col(score) >= 0.5, 1).otherwise(0)
