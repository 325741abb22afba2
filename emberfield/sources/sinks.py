"""Writers. Output stays in as many files as there are partitions; nothing is pulled together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV with header; a quote inside a value is doubled, as most readers expect."""
    df.write.mode("overwrite").csv(path, header=True, sep=sep, quote='"', escape='"')


def sample_rows(df: DataFrame, key: Sequence[str], n: int = 100) -> DataFrame:
    """The first ``n`` rows by key."""
    return df.orderBy(*key).limit(n)


def write_sample(df: DataFrame, path: str, key: Sequence[str], n: int = 100) -> None:
    write_csv(sample_rows(df, key, n), path)


def hash_sample(df: DataFrame, key: Sequence[str], n: int = 5, seed: int = 42) -> DataFrame:
    """``n`` rows that look random but are the same on every run: the smallest seeded key hashes."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key])
    return df.orderBy(F.md5(text.cast("binary")), *key).limit(n)


def write_statistics(stats: DataFrame, path: str) -> None:
    """The long statistics table (section, item, metric, value)."""
    write_csv(stats.orderBy("section", "item", "metric"), path)
