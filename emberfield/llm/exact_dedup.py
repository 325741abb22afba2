"""Exact duplicates through content-defined chunk recipes.

A normalised text is cut where a hash of the last eight bytes says so, hence equal stretches are cut
alike wherever they stand. Chunks with equal hashes are compared by content once: the distinct
(hash, content) pairs give each chunk a verified identifier, and a document becomes its recipe, the
ordered list of identifiers. Documents are then grouped by recipe, so the long texts move at most
once, after copies within a task are already merged, and all later shuffles move only recipes.

Defined results: null counts as the empty text, and empty texts equal each other. Rows repeated with
one doc_id count as rows of their group, and exactly one of them stays. A null doc_id never wins over
one that is set. An input column named like an added one is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.session import materialize

#: Chunks end where the top bits of the window hash are zero: about 1,024 bytes apart, within limits.
CUT_BITS, LEAST_CHUNK, MOST_CHUNK = 10, 256, 16_384
KEY_BYTES = 16
_BLANK = b" \t\n\v\f\r"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalised(raw: bytes | None) -> bytes:
    """Every run of blanks as one space."""
    if not raw:
        return b""
    head = b" " if raw[0] in _BLANK else b""
    words = raw.split()
    return head + b" ".join(words) + (b" " if words and raw[-1] in _BLANK else b"")


def chunks(body: bytes) -> list[bytes]:
    """Content-defined pieces whose concatenation is ``body``."""
    n = len(body)
    if n <= LEAST_CHUNK:
        return [body]
    windows = np.ndarray((n - 7,), "<u8", buffer=body, strides=(1,))
    cuts = np.flatnonzero((windows * _MIX) >> np.uint64(64 - CUT_BITS) == 0) + 8
    out, start = [], 0
    for cut in (*cuts.tolist(), n):
        while cut - start > MOST_CHUNK:
            out.append(body[start:start + MOST_CHUNK])
            start += MOST_CHUNK
        if cut - start >= LEAST_CHUNK or cut == n:
            if cut > start:
                out.append(body[start:cut])
            start = cut
    return out


def chunk_key(chunk: bytes, key_bytes: int = KEY_BYTES) -> bytes:
    return xxhash.xxh3_128_digest(chunk)[:key_bytes]


def _bodies(batch: pa.RecordBatch) -> Iterator[bytes]:
    for value in batch.column("text").cast(pa.binary()):
        yield normalised(value.as_py())


def _recipes(df: DataFrame, key_bytes: int) -> DataFrame:
    """(row, doc_id, text_sha256, recipe): one small row per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, recipes = [], []
            for body in _bodies(batch):
                shas.append(hashlib.sha256(body).hexdigest())
                recipes.append(b"".join(chunk_key(c, key_bytes) for c in chunks(body)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(shas, pa.string()), pa.array(recipes, pa.binary())],
                names=["doc_id", "text_sha256", "recipe"])

    kind = df.schema["doc_id"].dataType.simpleString()
    made = df.mapInArrow(run, f"doc_id {kind}, text_sha256 string, recipe binary")
    return made.withColumn("row", F.monotonically_increasing_id())


def _distinct_chunks(df: DataFrame, key_bytes: int) -> DataFrame:
    """Distinct (key, chunk): the only step that moves texts, merged within each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = list(dict.fromkeys(c for body in _bodies(batch) for c in chunks(body)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk_key(c, key_bytes) for c in pieces], pa.binary()), pa.array(pieces, pa.binary())],
                names=["key", "chunk"])

    return df.select("text").mapInArrow(run, "key binary, chunk binary").distinct()


def _resolve(df: DataFrame, recipes: DataFrame, clashes: DataFrame, key_bytes: int) -> DataFrame:
    """Recipes with verified identifiers where one key stands for several contents.

    Only documents that hold such a key are cut again; their identifiers get the number of the
    content among those of its key. ``clashes`` is empty unless two contents share a hash.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, places, pieces, docs = [], [], [], []
            for i, body in enumerate(_bodies(batch)):
                sha = hashlib.sha256(body).hexdigest()
                for place, piece in enumerate(chunks(body)):
                    shas.append(sha), places.append(place), pieces.append(piece), docs.append(i)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(shas, pa.string()),
                 pa.array(places, pa.int64()), pa.array([chunk_key(c, key_bytes) for c in pieces], pa.binary()),
                 pa.array(pieces, pa.binary())], names=["doc_id", "text_sha256", "place", "key", "chunk"])

    kind = df.schema["doc_id"].dataType.simpleString()
    cut = df.mapInArrow(run, f"doc_id {kind}, text_sha256 string, place long, key binary, chunk binary")
    cut = cut.join(clashes, ["key", "chunk"], "left")
    ids = F.collect_list(F.struct("place", F.concat("key", F.encode(F.coalesce("number", F.lit(1)).cast("string"), "utf-8"))))
    # Repeated rows repeat their places; sets keep one of each.
    lists = cut.groupBy("doc_id", "text_sha256").agg(
        F.array_sort(F.array_distinct(ids)).alias("identifiers"), F.max(F.col("number").isNotNull()).alias("odd"))
    lists = lists.where("odd").select("doc_id", "text_sha256", F.to_json("identifiers").cast("binary").alias("verified"))
    left, right = recipes.alias("l"), lists.alias("r")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_sha256") == F.col("r.text_sha256"))
    return left.join(right, same, "left").select(
        "row", "l.doc_id", "l.text_sha256",
        F.when(F.col("verified").isNull(), F.concat(F.lit(b"k"), "recipe"))
        .otherwise(F.concat(F.lit(b"v"), "verified")).alias("recipe"))


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", key_bytes: int = KEY_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``df``."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    recipes = materialize(_recipes(docs, key_bytes), "recipes")
    keys = _distinct_chunks(docs, key_bytes)
    several = materialize(keys.groupBy("key").count().where("count > 1").select("key"), "clashing_keys")
    if not several.isEmpty():
        numbered = _distinct_chunks(docs, key_bytes).join(several, "key").withColumn("number", F.expr(
            "row_number() over (partition by key order by chunk)"))
        recipes = materialize(_resolve(docs, recipes, numbered, key_bytes), "verified_recipes")
    groups = materialize(
        recipes.groupBy("recipe").agg(
            F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"),
            F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("keep_row")).where("group_size > 1"), "groups")
    alone = F.col("group_size").isNull()
    return recipes.join(groups, "recipe", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256")


def drop_exact_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with their columns as they are."""
    judged = materialize(exact_groups(df, doc_id, text), "judged")
    stay, go = judged.where("kept"), judged.where("not kept").select("doc_id").distinct()
    if stay.join(go, stay.doc_id.eqNullSafe(go.doc_id), "left_semi").isEmpty():
        return df.join(go, df[doc_id].eqNullSafe(go.doc_id), "left_anti")
    # Some doc_id names several rows: tell them apart by their text.
    sha = F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(doc_id).alias("id"), sha.alias("sha"))
    rows = rows.join(stay, rows.id.eqNullSafe(stay.doc_id) & (rows.sha == stay.text_sha256), "left_semi")
    return rows.dropDuplicates(["id", "sha"]).select("row.*")
