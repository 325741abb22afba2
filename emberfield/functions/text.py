"""Text expressions: names, ids, codes, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every Unicode blank and the control characters that count as blanks.
BLANK = r"[\p{Z}\t-\r\x1c-\x1f\x85]"


def strip(c: Column) -> Column:
    """Blanks of any kind taken off both ends."""
    return F.regexp_replace(c, rf"^{BLANK}++|(?<!{BLANK}){BLANK}++$", "")


def title_case(c: Column) -> Column:
    """Strip, then capitalise every letter that follows a non-letter and lower the rest.

    ``initcap`` only knows blanks as word borders. A marker plus blank put after every other
    non-letter makes it see those borders too; the pair is taken out again afterwards.
    """
    marked = F.regexp_replace(strip(c), r"([^\p{L} ])", "$1\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def clean_text(c: Column) -> Column:
    """Null becomes empty, then strip."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def zero_pad(c: Column, width: int) -> Column:
    """Left-pad with zeros up to ``width``; longer ids stay whole (``lpad`` alone would cut them)."""
    s = c.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def composite_key(*parts: Column) -> Column:
    """Concatenate key parts; any null part makes the key null."""
    return F.concat(*[p.cast("string") for p in parts])


def leading_code(c: Column) -> Column:
    """The three digits a text starts with as a number, null if it does not start with them."""
    return F.regexp_extract(c, r"^(\d{3})", 1).try_cast("double")


def short_label(c: Column, width: int) -> Column:
    return F.substring(c.cast("string"), 1, width)


def null_tokens(c: Column, tokens: list[str]) -> Column:
    return F.when(~c.isin(tokens), c)
