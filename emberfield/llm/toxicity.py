"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are single signals that mark a text: words of a fixed lexicon, words and word beginnings that
the labelled training rows associate with the mark, each also from the second occurrence on, and
style patterns. The label model explains all votes of the training sample by one hidden class: it
estimates every voter's rates for both classes by expectation maximisation, and correlations between
voters that remain when the class is known, by which it discounts voters that repeat each other. The
given label enters as one more voter, whose noise is estimated too. The posterior of the hidden class
is the target of a logistic regression on signal counts, which scores every document.

Defined results: an empty or null text has no signals and gets the base score; repeated rows score
alike; without labelled rows the lexicon alone votes. Only the text is an input of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberfield.llm.common import per_row, without

SAMPLE_PER_CLASS = 4000
#: Signals kept as features, and those of them that vote.
SIGNALS, VOTERS = 400, 64
LENGTHS = range(3, 9)
LEAST_SUPPORT = 3
KNOWN_WORDS = 200_000
#: Bounds for the rates at which the given label marks texts of the hidden classes 1 and 0.
GIVEN_HIT, GIVEN_FALSE = (0.9, 0.999), (1e-4, 0.02)
# Common insults in four languages, lower case.
LEXICON = ("idiot moron stupid loser scum trash pathetic worthless disgusting clown dumb jerk bastard "
           "idiota estúpido imbécil basura asqueroso inútil payaso perdedor "
           "imbécile stupide ordure dégoûtant minable crétin abruti "
           "dumm trottel abschaum widerlich wertlos versager müll ekelhaft").split()
STYLE = ("~shout", "~exclaim", "~you")
_WORDS = re.compile(r"[^\W\d_]+")


class Signals:
    """Which signals a text shows and how often; words are looked up once and remembered."""

    def __init__(self, names: Sequence[str]):
        self.names = list(names)
        self.place = {n: i for i, n in enumerate(self.names)}
        self.known: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            place = self.place
            got = tuple(place[s] for s in word_signals(word) if s in place)
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            self.known[word] = got
        return got

    def count(self, text: str | None) -> Counter[int]:
        out: Counter[int] = Counter()
        if not text:
            return out
        words = _WORDS.findall(text.lower())
        known = self.known
        for word in words:
            hits = known.get(word)
            if hits is None:
                hits = self.of_word(word)
            for hit in hits:
                out[hit] += 1
        for name in style_signals(text, words):
            if name in self.place:
                out[self.place[name]] += 1
        return out


def word_signals(word: str) -> list[str]:
    """The word itself, and its beginnings."""
    return ["=" + word, *(word[:n] for n in LENGTHS if n <= len(word))]


def style_signals(text: str, words: list[str]) -> list[str]:
    out = []
    if len(words) >= 20 and text.isupper():
        out.append("~shout")
    if "!!!" in text:
        out.append("~exclaim")
    insults = [i for i, w in enumerate(words) if w in _INSULTS]
    if any(w in ("you", "your", "du", "tu", "vous", "usted") for i in insults for w in words[max(0, i - 3):i]):
        out.append("~you")
    return out


_INSULTS = frozenset(LEXICON)


def mine_signals(sample: DataFrame, counts: dict[int, int] | None = None) -> list[str]:
    """The signals most associated with the mark, in (doc_id, text, label) rows of the training sample."""
    size = {int(r[0]): r[1] for r in sample.groupBy("label").count().collect()}
    if not size.get(1) or not size.get(0):
        return ["=" + w for w in LEXICON]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                for s in {s for w in set(_WORDS.findall((text or "").lower())) for s in word_signals(w)}:
                    found.setdefault(s, [0, 0])[label] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array([v[0] for v in found.values()], pa.int64()),
             pa.array([v[1] for v in found.values()], pa.int64())], names=["signal", "clean", "marked"])

    seen = sample.select("text", "label").mapInArrow(run, "signal string, clean long, marked long")
    seen = seen.groupBy("signal").agg(F.sum("clean").alias("clean"), F.sum("marked").alias("marked"))
    p = (F.col("marked") + 0.5) / (size[1] + 1)
    q = (F.col("clean") + 0.5) / (size[0] + 1)
    # Expected log-likelihood gain over all marked texts: rare or unspecific signals gain little.
    ranked = seen.where(F.col("marked") >= LEAST_SUPPORT).withColumn("gain", F.col("marked") * F.log(p / q)).where(p > 3 * q)
    top = ranked.orderBy(F.desc("gain"), F.desc(F.length("signal")), "signal").limit(10 * SIGNALS).collect()
    names = unlike([(r.signal, r.clean, r.marked) for r in top])[:SIGNALS]
    return [*dict.fromkeys([*names, *("=" + w for w in LEXICON)]), *STYLE]


def unlike(ranked: list[tuple[str, int, int]]) -> list[str]:
    """Signals without those nested with a chosen one that are neither more precise nor far more frequent.

    ``ranked`` has (signal, clean texts, marked texts), best first; of nested signals with equal counts
    the longest comes first and stays.
    """
    chosen: dict[str, tuple[float, int]] = {}
    for signal, clean, marked in ranked:
        share, word = (clean + 0.5) / marked, signal.lstrip("=")
        near = [s for s in chosen if word.startswith(s.lstrip("=")) or s.lstrip("=").startswith(word)]
        if not near or share < 0.5 * min(chosen[s][0] for s in near) or marked > 2 * max(chosen[s][1] for s in near):
            chosen[signal] = (share, marked)
    return list(chosen)


@dataclass(frozen=True)
class LabelModel:
    prior: float
    hit: np.ndarray   # rate of each voter's vote in the hidden class 1
    false: np.ndarray  # and in class 0
    discount: np.ndarray  # 1 for an independent voter, less for one that repeats others
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        yes, no = np.log(self.hit / self.false), np.log((1 - self.hit) / (1 - self.false))
        odds = np.log(self.prior / (1 - self.prior)) + (votes * yes + (1 - votes) * no) @ self.discount
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_label_model(votes: np.ndarray, start: np.ndarray, weight: np.ndarray, turns: int = 25) -> LabelModel:
    """Expectation maximisation from the posterior ``start``; ``weight`` is what a sampled row stands for.

    The last voter is the given label: it is not discounted, and its rates stay within the bounds.
    """
    q, n = start.astype(float), weight / weight.sum()
    model = None
    for _ in range(turns):
        one, zero = n * q, n * (1 - q)
        prior = float(np.clip(one.sum(), 1e-3, 1 - 1e-3))
        hit = np.clip((one @ votes) / max(one.sum(), 1e-9), 1e-3, 1 - 1e-3)
        false = np.clip((zero @ votes) / max(zero.sum(), 1e-9), 1e-4, 1 - 1e-3)
        hit[-1], false[-1] = np.clip(hit[-1], *GIVEN_HIT), np.clip(false[-1], *GIVEN_FALSE)
        expected = np.outer(q, hit) + np.outer(1 - q, false)
        rest = (votes - expected) * np.sqrt(n)[:, None]
        cov = rest.T @ rest
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        correlation = np.clip(cov / np.outer(scale, scale), -1, 1)
        shared = np.maximum(correlation, 0)
        shared[shared < 0.1] = 0
        np.fill_diagonal(shared, 0)
        discount = 1 / (1 + shared.sum(1))
        discount[-1] = 1.0
        model = LabelModel(prior, hit, false, discount, correlation)
        q = model.posterior(votes)
    return model


@dataclass(frozen=True)
class ToxicityModel:
    names: list[str]
    weight: np.ndarray
    bias: float

    def score(self, counts: Counter[int]) -> float:
        odds = self.bias + sum(self.weight[i] * np.log1p(n) for i, n in counts.items())
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def fit_linear(matrix: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 3e-4,
               turns: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by accelerated gradient steps."""
    x = np.hstack([matrix, np.ones((len(matrix), 1))])
    n = weight / weight.sum()
    step = 1 / (0.25 * np.linalg.eigvalsh((x * n[:, None]).T @ x)[-1] + ridge)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 0
    w, ahead = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for turn in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - step * (x.T @ (n * (p - target)) + penalty * ahead)
        ahead = new + turn / (turn + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def fit_toxicity(sample: DataFrame, counts: dict[int, int]) -> ToxicityModel:
    """Voters, label model and classifier from the bounded training sample (doc_id, text, label)."""
    names = mine_signals(sample)
    added = T.StructType([T.StructField("signals", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])

    def run(values: Iterator[tuple]) -> Iterator[tuple]:
        signals = Signals(names)
        for (text,) in values:
            c = signals.count(text)
            yield list(c.keys()), list(c.values())

    rows = sorted(per_row(sample, ["text"], added, run, keep=["doc_id", "label"]).collect(),
                  key=lambda r: (r.doc_id, r.signals))
    if not rows:
        weight = np.array([4.0 if n[1:] in _INSULTS else 0.0 for n in names])
        return ToxicityModel(names, weight, -3.0)
    times = np.zeros((len(rows), len(names)))
    for row, r in zip(times, rows):
        row[r.signals] = r.times
    label = np.array([r.label for r in rows], float)
    held = {v: max(1.0, float((label == v).sum())) for v in (0, 1)}
    stands = np.array([counts[int(v)] / held[int(v)] for v in label])
    # The best separated signals vote, once for their presence and once for their return.
    gain = (label @ (times > 0)) / held[1] - ((1 - label) @ (times > 0)) / held[0]
    chosen = np.argsort(-gain, kind="stable")[:VOTERS]
    votes = np.hstack([times[:, chosen] > 0, times[:, chosen] > 1, label[:, None] > 0]).astype(float)
    model = fit_label_model(votes, np.clip(label, 0.05, 0.95), stands)
    weight, bias = fit_linear(np.log1p(times), model.posterior(votes), stands)
    return ToxicityModel(names, weight, bias)


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``df`` without ``text`` and with ``score``, from 0 to 1."""
    keep = [c for c in without(df, [score]) if c != text]
    spread = df.sparkSession.sparkContext.broadcast(model)
    added = T.StructType([T.StructField(score, T.DoubleType())])

    def run(values: Iterator[tuple]) -> Iterator[tuple]:
        model = spread.value
        signals = Signals(model.names)
        for (value,) in values:
            yield (model.score(signals.count(value)),)

    return per_row(df, [text], added, run, keep=keep)
