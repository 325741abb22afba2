"""Personal data in texts, with built-in functions only.

Regular expressions propose spans, checksums and value rules confirm them, and words near a span move
its score. Splitting a text by an expression and extracting its matches alternate, so the lengths of
both give every match its place in code points without any position function. Expressions are
possessive and start at the first character of a run, so they run in linear time without recursion on
long texts.

The four base kinds are certain: a match that passes its check is a span, whatever its score. The
added kinds become spans only from ``LEAST_SCORE`` on, which most reach only next to a fitting word.

Defined results: a null text has no spans; a repeated row gets the same spans each time; an input
column named like an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.llm.common import without

LEAST_SCORE = 0.5
CONTEXT_BEFORE = 40
#: Matches handled by one inner pass; keeps the running sum from copying a long list per match.
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """``probe`` must occur in a text for ``pattern`` to match; ``valid`` confirms a match."""

    name: str
    pattern: str
    probe: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    base: bool = True
    whole: bool = False  # no letter or digit may touch the match


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the check digit fits: every second digit from the right is doubled."""
    turned = F.reverse(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda sum_, i: sum_ + _luhn_digit(
        F.substring(turned, i, F.lit(1)).cast("int"), i))
    return total % 10 == 0


def _luhn_digit(digit: Column, place: Column) -> Column:
    return F.when(place % 2 == 1, digit).when(digit > 4, 2 * digit - 9).otherwise(2 * digit)


def mod97(match: Column) -> Column:
    """True if the account number, four characters rotated and letters as numbers, leaves 1 by 97."""
    plain = F.replace(match, F.lit(" "))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        c = F.substring(turned, i, F.lit(1))
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _small_parts(match: Column) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.try_to_number(p, F.lit("999")), F.lit(0)) <= 255))


def _n_digits(low: int, high: int) -> Callable[[Column], Column]:
    return lambda match: F.length(digits_of(match)).between(low, high)


def _card(low: int, high: int) -> Callable[[Column], Column]:
    return lambda match: F.when(_n_digits(low, high)(match), luhn(digits_of(match))).otherwise(False)


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         lambda m: F.lit(True), 0.8, r"mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", _small_parts, 0.6, r"\bip\b|address|host|server"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]", _card(16, 19), 0.7, r"card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", _n_digits(8, 15), 0.7, r"phone|tel|call|mobile|fax"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)", r"[A-Z]{2}[0-9]{2}",
         lambda m: F.when(F.length(F.replace(m, F.lit(" "))).between(15, 34), mod97(m)).otherwise(False),
         0.7, r"iban|account|bank", base=False, whole=True),
    Kind("national_id", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]-[0-9]",
         lambda m: ~m.rlike(r"^(000|666|9)|-00-|-0000$"), 0.3, r"ssn|social security|tax id", base=False, whole=True),
    Kind("card_short", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]", _card(13, 15), 0.3, r"card|visa|amex|credit", base=False, whole=True),
    Kind("phone_local", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", r"[0-9]{3}",
         lambda m: F.lit(True), 0.3, r"phone|tel|call|mobile|fax", base=False, whole=True),
)
BASE_KINDS = tuple(k.name for k in KINDS if k.base)
CONTEXT_GAIN = 0.3
_SPAN = "array<struct<kind:string,start:int,end:int,score:double,text:string>>"


def _pieces(kind: Kind, text: Column) -> tuple[Column, Column]:
    """Matches and the gaps around them; null where the probe says there is none."""
    there = text.contains(kind.probe) if kind.probe == "@" else text.rlike(kind.probe)
    return (F.when(there, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))),
            F.when(there, F.split(text, kind.pattern, -1)))


def _spans(kind: Kind, matches: Column, gaps: Column) -> Column:
    def add(state: Column, i: Column) -> Column:
        gap, match = F.get(gaps, i), F.get(matches, i)
        start = state["at"] + F.length(gap)
        end = start + F.length(match)
        fine = F.coalesce(kind.valid(match), F.lit(False))
        if kind.whole:
            fine = fine & ~gap.rlike("[A-Za-z0-9]$") & ~F.get(gaps, i + 1).rlike("^[A-Za-z0-9]")
        score = F.lit(kind.score) + F.when(
            F.right(gap, F.lit(CONTEXT_BEFORE)).rlike("(?i)" + kind.context), CONTEXT_GAIN).otherwise(0.0)
        if not kind.base:
            fine = fine & (score >= LEAST_SCORE)
        span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"),
                        score.alias("score"), match.alias("text"))
        return F.struct(end.alias("at"), F.when(fine, F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"))

    none = F.array().cast(_SPAN)

    def block(state: Column, first: Column) -> Column:
        last = F.least(first + BLOCK, F.size(matches)) - 1
        made = F.aggregate(F.sequence(first, last), F.struct(state["at"].alias("at"), none.alias("out")), add)
        return F.aggregate(F.array(made), state, lambda _, m: F.struct(
            m["at"].alias("at"), F.array_append(state["out"], m["out"]).alias("out")))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    found = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1, F.lit(BLOCK)), empty, block)
    return F.when(F.size(matches) > 0, F.flatten(found["out"])).otherwise(none)


def find_pii(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Add ``spans``: (kind, start, end, score, text) by kind as in ``KINDS``, then by start.

    Added kinds that overlap a base span are left out.
    """
    rest = without(df, [spans])
    held = df.select(F.struct(*rest).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    cut = held.select("row", *[c.alias(f"{part}{i}") for i, k in enumerate(KINDS)
                               for part, c in zip(("m", "g"), _pieces(k, F.col("t")))])
    found = cut.select("row", *[_spans(k, F.col(f"m{i}"), F.col(f"g{i}")).alias(f"s{i}") for i, k in enumerate(KINDS)])
    base = found.select("row", F.concat(*[f"s{i}" for i, k in enumerate(KINDS) if k.base]).alias("base"),
                        F.concat(*[f"s{i}" for i, k in enumerate(KINDS) if not k.base]).alias("more"))
    free = F.filter("more", lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    return base.select("row.*", F.concat("base", free).alias(spans))


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask_pii(df: DataFrame, text: str = "text", spans: str = "spans", mark: str = "[{}]") -> DataFrame:
    """The text with every span replaced by a mark of its kind, spans that overlap an earlier one merged."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    mark = F.lit(mark)
    done = F.aggregate(ordered, start, lambda state, s: F.when(s["start"] < state["at"], F.struct(
        F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out"))).otherwise(F.struct(
            s["end"].alias("at"), F.concat(state["out"], F.substring(F.col(text), state["at"] + 1, s["start"] - state["at"]),
                                           F.replace(mark, F.lit("{}"), s["kind"])).alias("out"))))
    return df.withColumn("_masked", done).withColumn(
        text, F.when(F.col(text).isNotNull(), F.concat(
            F.col("_masked.out"), F.substr(F.col(text), F.col("_masked.at") + 1)))).drop("_masked")
