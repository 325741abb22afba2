"""Quality rules applied as a short-circuit cascade.

Each rule either rejects a document or lets it pass on. What a rule costs and how often it rejects is
measured on a bounded sample, and the rules are ordered by rejections per second among the documents
that earlier rules let pass. The verdict is a conjunction, so the order changes the time, never the
result. Features are computed when a rule first asks for them and then shared.

Defined results: a null text has no words; a repeated row gets the same verdict each time; an empty
table gives an empty result; an input column named like an added one is replaced.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberfield.llm.common import per_row, without

#: Rows on which cost and selectivity are measured; affects the order of the rules only.
SAMPLE_ROWS = 500
MIN_WORDS = 50
BLANK = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


class Document:
    """One text with features that are computed on first use."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANK))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines that hold a word."""
        return [line for line in self.text.split("\n") if line.strip(BLANK)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def upper(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _UPPER))

    @cached_property
    def lower(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _LOWER))

    @cached_property
    def counts(self) -> Counter[bytes]:
        return Counter(self.words)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside three-word windows that occur at least twice in the text."""
        n = self.n_words
        if n < 4:
            return 0
        number = {w: i for i, w in enumerate(self.counts)}
        ids = np.fromiter(map(number.__getitem__, self.words), np.int64, n)
        pairs = ids[:-1] * len(number) + ids[1:]
        if len(number) > 1_000_000:  # keeps the product of three numbers below 2**63
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * len(number) + ids[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        if not same.any():
            return 0
        repeated = np.zeros(n - 2, bool)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift:n - 2 + shift] |= repeated
        return int(covered.sum())

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > 50 * self.n_words


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Document], bool]


RULES = (
    Rule("symbols", lambda d: 10 * d.n_symbols > 3 * d.n_words),
    Rule("repeated_lines", lambda d: 100 * d.n_dup_lines > 60 * len(d.lines)),
    Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 15 * d.n_words),
    Rule("shouting", lambda d: 2 * d.upper > d.upper + d.lower),
    Rule("exclamation", lambda d: 2 * d.text.count("!") > d.n_words),
    Rule("one_word", lambda d: d.n_words > 0 and 10 * max(d.counts.values()) > 3 * d.n_words),
    Rule("wordless", lambda d: 2 * sum(w.isdigit() for w in d.words) > d.n_words),
)


def passes(document: Document, rules: Sequence[Rule]) -> bool:
    return not any(rule.rejects(document) for rule in rules)


def measure_rules(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text",
                  rows: int = SAMPLE_ROWS) -> list[tuple[list[float], list[bool]]]:
    """Seconds and rejections of every rule, each from a fresh document, for at most ``rows`` rows."""
    added = T.StructType([T.StructField("seconds", T.ArrayType(T.DoubleType())),
                          T.StructField("rejected", T.ArrayType(T.BooleanType()))])

    def run(values: Iterator[tuple]) -> Iterable[tuple]:
        for (value,) in values:
            seconds, rejected = [], []
            for rule in rules:
                document, start = Document(value), time.perf_counter()
                rejected.append(bool(rule.rejects(document)))
                seconds.append(time.perf_counter() - start)
            yield seconds, rejected

    sample = df.select(F.col(text).alias("text")).limit(rows)
    return [(r[0], r[1]) for r in per_row(sample, ["text"], added, run, keep=[]).collect()]


def order_rules(measured: Sequence[tuple[list[float], list[bool]]], rules: Sequence[Rule] = RULES) -> list[Rule]:
    """Greedy order: most rejections per second among the sampled documents still unrejected."""
    left, alive, ordered = list(range(len(rules))), list(measured), []
    while left:
        def gain(i: int) -> float:
            cost = sum(s[i] for s, _ in alive)
            return sum(r[i] for _, r in alive) / cost if cost else 0.0
        best = max(left, key=lambda i: (gain(i), -i))
        ordered.append(rules[best])
        left.remove(best)
        alive = [m for m in alive if not m[1][best]]
    return ordered


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def apply_quality_rules(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text",
                        statistics: bool = True, keep_text: bool = True) -> DataFrame:
    """Add ``base_failed`` and ``kept`` (and the base statistics); every row stays.

    Without ``statistics`` a document that is too short is not examined further.
    """
    ordered = order_rules(measure_rules(df, rules, text), rules)
    names = STATISTICS if statistics else ()
    added = T.StructType([*(T.StructField(n, T.LongType()) for n in names),
                          T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def run(values: Iterator[tuple]) -> Iterable[tuple]:
        for (value,) in values:
            d = Document(value)
            failed = d.base_failed
            yield (*(getattr(d, n) for n in names), failed, not failed and passes(d, ordered))

    keep = [c for c in without(df, added.names) if keep_text or c != text]
    return per_row(df, [text], added, run, keep=keep)


def keep_good(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows that pass the base conditions and every rule, with their columns as they are."""
    judged = apply_quality_rules(df.select(F.struct(*df.columns).alias("row"), F.col(text).alias("judged_text")),
                                 rules, "judged_text", statistics=False, keep_text=False)
    return judged.where("kept").select("row.*")
