"""Number expressions: lenient casts, guards, rounding, rates, bins, flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberfield.constants import CODE_BIN_LABELS


def to_number(c: Column) -> Column:
    """Double, or null when the value is no number (NaN counts as missing)."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def to_number_or_zero(c: Column) -> Column:
    return F.coalesce(to_number(c), F.lit(0.0))


def sentinel_to_null(c: Column, floor: float) -> Column:
    """Values below ``floor`` mean "not available"."""
    return F.when(c >= floor, c)


def within_range(c: Column, low: float, high: float) -> Column:
    """Values outside ``low..high`` (both included) become null."""
    return F.when(c.between(low, high), c)


def round_even(c: Column, digits: int = 0) -> Column:
    """Round half to even on the double; ``F.round`` rounds half up."""
    if digits == 0:
        return F.rint(c)
    scale = float(10 ** digits)
    return F.rint(c * scale) / scale


def to_whole(c: Column) -> Column:
    """Nearest whole number as nullable integer."""
    return F.rint(c).try_cast("long")


def truncate(c: Column) -> Column:
    """Integer part, null when the value does not fit."""
    return c.try_cast("long")


def safe_ratio(num: Column, den: Column, scale: float = 100.0, digits: int = 2) -> Column:
    """``num / den * scale`` rounded; null when the denominator is missing or not positive."""
    d = to_number(den)
    return round_even(to_number(num) / F.when(d > 0, d) * scale, digits)


def member_flag(c: Column, values: Sequence[str]) -> Column:
    """1 when the value is in the set; null counts as not in it."""
    return F.coalesce(c.isin(list(values)), F.lit(False)).cast("int")


def below_flag(c: Column, limit: float) -> Column:
    return F.coalesce(c < limit, F.lit(False)).cast("int")


def code_bin_rank(code: Column) -> Column:
    """1 for codes 100-199 up to 7 for 700-799; other codes null."""
    inside = (code >= 100) & (code < 100 * (len(CODE_BIN_LABELS) + 1))
    return F.when(inside, F.floor(code / 100)).cast("int")


def code_bin(code: Column) -> Column:
    """Label of the hundred a code falls into; below 100 and from 800 on null."""
    return F.elt(code_bin_rank(code), *[F.lit(name) for name in CODE_BIN_LABELS])


def nearest_year(year: Column, years: Sequence[int]) -> Column:
    """The listed year closest to ``year``; a tie goes to the earlier one, a null year stays null."""
    ordered = sorted(years)
    pick = F.lit(ordered[-1])
    for low, high in reversed(list(zip(ordered, ordered[1:]))):
        pick = F.when(year * 2 <= low + high, F.lit(low)).otherwise(pick)
    return F.when(year.isNotNull(), pick).cast("int")


def significance_stars(p: Column) -> Column:
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")
            .when(p < 0.1, ".").otherwise(" "))


def completeness_grade(pct_missing: Column) -> Column:
    return F.when(pct_missing > 50, "sparse").when(pct_missing > 10, "partial").otherwise("complete")


def flame_spread_recode(c: Column) -> Column:
    """Mixed flag to 1 / 0: yes-forms, no-forms, everything else (numbers included) null."""
    v = F.upper(F.btrim(c))
    return F.when(v.isin("Y", "YES"), 1).when(v.isin("N", "NO"), 0).cast("int")
