"""Time expressions on zone-free timestamps, so no result depends on the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberfield.constants import ISO_MILLIS_PATTERN, MONTH_NAMES, WEEKDAY_NAMES


def _elapsed(start: Column, end: Column) -> Column:
    """Interval in seconds. Subtracting keeps zone-free timestamps as they are, whereas
    ``timestampdiff`` would move them into the session zone and its clock changes."""
    return (end.cast("timestamp_ntz") - start.cast("timestamp_ntz")).cast("interval second")


def elapsed_minutes(start: Column, end: Column) -> Column:
    """Minutes between two instants, fractions of a second kept."""
    return _elapsed(start, end).cast("decimal(18,6)").cast("double") / F.lit(60.0)


def elapsed_whole_minutes(start: Column, end: Column) -> Column:
    """Minutes between two instants, elapsed time first cut to whole seconds."""
    return _elapsed(start, end).cast("long") / F.lit(60.0)


def parse_time(c: Column) -> Column:
    """Lenient parse; text that is no timestamp becomes null."""
    return c.try_cast("timestamp_ntz")


def parse_iso_millis(c: Column) -> Column:
    """Strict ``yyyy-MM-ddTHH:mm:ss.SSS`` parse; any other form becomes null."""
    return F.when(c.rlike(ISO_MILLIS_PATTERN), c.try_cast("timestamp_ntz"))


def is_weekend(weekday: Column) -> Column:
    """1 for Saturday and Sunday, with Monday = 0."""
    return F.coalesce(weekday.isin(5, 6), F.lit(False)).cast("int")


def is_night(hour: Column) -> Column:
    """1 from 22:00 to 05:59."""
    return F.coalesce((hour >= 22) | (hour <= 5), F.lit(False)).cast("int")


def month_name(ts: Column) -> Column:
    return F.elt(F.month(ts), *[F.lit(name) for name in MONTH_NAMES])


def weekday_name(ts: Column) -> Column:
    return F.elt(F.weekday(ts) + 1, *[F.lit(name) for name in WEEKDAY_NAMES])


def shift_date(ts: Column, start_hour: int = 8) -> Column:
    """Date of the duty shift that runs from ``start_hour`` to the same hour of the next day."""
    return F.to_date(ts - F.make_dt_interval(hours=F.lit(start_hour)))
