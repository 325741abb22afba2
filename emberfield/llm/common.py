"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` without arguments parts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def document_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8")


def per_row(df: DataFrame, columns: list[str], added: T.StructType,
            function: Callable[[Iterator[tuple]], Iterable[tuple]], keep: list[str] | None = None) -> DataFrame:
    """Add columns that ``function`` derives from ``columns``, one output tuple per input tuple.

    Rows stay in their partition and move as Arrow batches; ``function`` sees a slice of bounded bytes
    at a time as an iterator of tuples. ``keep`` names the input columns of the result (all by default);
    only needed columns are sent to Python.
    """
    keep = df.columns if keep is None else keep
    sent = df.select(*dict.fromkeys([*keep, *columns]))
    schema = T.StructType([*[sent.schema[c] for c in keep], *added.fields])
    names, kinds = added.names, to_arrow(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded_slices(whole, columns):
                rows = list(function(zip(*(batch.column(c).to_pylist() for c in columns))))
                made = list(zip(*rows)) if rows else [[] for _ in names]
                arrays = [batch.column(c) for c in keep] + [pa.array(v, kind) for v, kind in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])

    return sent.mapInArrow(run, schema)


#: Bytes of the text columns of a slice; a longer row is a slice of its own.
SLICE_BYTES = 4 << 20


def bounded_slices(batch: pa.RecordBatch, columns: list[str], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch, of about ``most`` bytes in the string columns among ``columns``."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        if pa.types.is_string(batch.schema.field(c).type):
            size += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        if high > low:
            yield batch.slice(low, high - low)


_ARROW = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(),
          T.StringType: pa.string(), T.BinaryType: pa.binary(), T.BooleanType: pa.bool_()}


def to_arrow(schema: T.StructType) -> list[pa.DataType]:
    def kind(t: T.DataType) -> pa.DataType:
        if isinstance(t, T.ArrayType):
            return pa.list_(kind(t.elementType))
        if isinstance(t, T.StructType):
            return pa.struct([(f.name, kind(f.dataType)) for f in t])
        return _ARROW[type(t)]
    return [kind(f.dataType) for f in schema]


def without(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Columns of ``df`` that clash with none of ``names``; Spark compares names without case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def drop_unkept(df: DataFrame, judged: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``df`` that ``judged`` keeps; ``judged`` has (doc_id, print, kept), one row per row of ``df``.

    ``print`` is ``text_print`` of the text. Rows that agree in both are told apart only by number:
    if some of them stay and some go, as many stay as are kept.
    """
    held = df.select(F.struct(*df.columns).alias("held"), F.col(doc_id).alias("i"), text_print(F.col(text)).alias("p"))

    def same(other: DataFrame) -> Column:
        return held.i.eqNullSafe(other.doc_id) & (held.p == other.print)

    go = judged.where("not kept").select("doc_id", "print").distinct()
    stay = judged.where("kept").groupBy("doc_id", "print").agg(F.count("*").alias("n"))
    left = go.alias("g").join(stay.alias("s"), F.col("g.doc_id").eqNullSafe(F.col("s.doc_id")) & (
        F.col("g.print") == F.col("s.print")), "left_semi")
    if left.isEmpty():
        return held.join(go, same(go), "left_anti").select("held.*")
    number = F.row_number().over(Window.partitionBy("i", "p").orderBy("p"))
    rows = held.withColumn("k", number)
    return rows.join(stay, rows.i.eqNullSafe(stay.doc_id) & (rows.p == stay.print)).where("k <= n").select("held.*")


def text_print(text: Column) -> Column:
    """64-bit hash that tells texts of one doc_id apart; null differs from empty."""
    return F.xxhash64(text.isNull(), text)
