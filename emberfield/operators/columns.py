"""Optional columns, resolved against ``df.columns`` while the plan is built."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    return [c for c in names if c in df.columns]


def with_absent_columns(df: DataFrame, names: Iterable[str], dtype: str) -> DataFrame:
    """Add every column that is not there yet as typed null."""
    return df.withColumns({c: F.lit(None).cast(dtype) for c in names if c not in df.columns})


def require_columns(df: DataFrame, names: Iterable[str], hint: str = "") -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}. {hint}".strip())
    return df
