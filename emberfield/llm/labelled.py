"""Bounded, reproducible samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.session import materialize


def fold(doc_id: Column, folds: int) -> Column:
    """Remainder of crc32 of the id as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int,
                    name: str) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` training texts of each label, and how many rows of each label there are.

    Rows of the held-out fold and rows without a label are never read. The sample takes the smallest
    hashes of the id, hence depends on nothing but the rows; with at most two labels it has at most
    ``2 * per_class`` rows, which bounds everything that is fitted on it.
    """
    known = labels.where((fold(F.col("doc_id"), folds) != held_out) & F.col(label).isin(0, 1)).select(
        "doc_id", F.col(label).alias("label"))
    counts = {int(r[0]): r[1] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("label") == v).orderBy(order, "doc_id").limit(per_class) for v in (0, 1)]
    # Proven bound: 2 * per_class rows of two numbers.
    sample = F.broadcast(picked[0].union(picked[1]))
    return materialize(docs.select("doc_id", "text").join(sample, "doc_id"), name), counts
