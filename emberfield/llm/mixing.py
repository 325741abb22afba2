"""Mixing sources to target weights by packed blocks and index permutations.

The words of each source form one stream, in an order given by a hash, which is packed into blocks of
``BLOCK_WORDS`` words. The mix is a row of slots, each holding one block, cut into output shards. Slots
go to sources by a multinomial draw whose totals are fixed to the targets: position ``p`` of the mix
is a pseudorandom permutation of a number line on which every source owns as many places as its
target needs. The slots of a source walk through its blocks by one pseudorandom permutation per pass.
All this is arithmetic on indices; blocks then join slots by index, so no text is sorted or shuffled
to mix it, and a source with most of the rows is spread over its blocks.

Targets: sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ...; a target stops at
``MOST_REPEATS`` times the source's words and the excess goes to the others by weight. As a block is
used once per pass and there are at most that many passes, no document exceeds the bound either.

Defined results: a null or blank text has size 0 and is never taken; a null source is a source; rows
repeated with one doc_id are separate rows; an empty table gives an empty mix. Equal inputs give
equal mixes whatever their order and partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberfield.llm.common import WORD
from emberfield.session import materialize

BLOCK_WORDS = 128
SLOTS_PER_SHARD = 4096
MOST_REPEATS = 3
#: Rows that one stretch of a source's stream holds; running sums are taken inside a stretch.
STRETCH_ROWS = 2_500
#: Slots generated from one row.
SLOT_RUN = 65_536


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, count: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Place of ``index`` in a pseudorandom permutation of ``0..count-1`` that ``seed`` selects.

    A four-round Feistel network permutes the next even power of two; a value outside the range is
    permuted again until it falls inside.
    """
    count, seed = count.astype(np.uint64), _mix64(seed.astype(np.uint64))
    top = np.maximum(count, np.uint64(2)) - np.uint64(1)
    bits = np.frexp(top.astype(np.float64))[1]
    half = np.maximum((bits + 1) // 2, 1).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    value, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = value[todo] >> half[todo], value[todo] & low[todo]
        for turn in range(4):
            mixed = _mix64(right ^ (seed[todo] + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64))))
            left, right = right, (left ^ mixed) & low[todo]
        value[todo] = left << half[todo] | right
        todo = todo[value[todo] >= count[todo]]
    return value.astype(np.int64)


@dataclass(frozen=True)
class Mix:
    """``documents``: every row with its place in the stream; ``sources``: targets; ``slots``: the mix."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    block_words: int

    def pieces(self) -> DataFrame:
        """The stretch of words ``[low, high)`` that each document has in each of its blocks."""
        block, words = F.col("block"), self.block_words
        first, last = F.floor(F.col("start") / words), F.floor((F.col("start") + F.col("size") - 1) / words)
        spread = self.documents.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
        return spread.withColumn("low", F.greatest(block * words - F.col("start"), F.lit(0))).withColumn(
            "high", F.least((block + 1) * words - F.col("start"), F.col("size")))

    def taken(self) -> DataFrame:
        """Every row of the input with its ``taken`` words."""
        uses = self.slots.groupBy("sid", "block").agg(F.count("*").alias("uses"))
        words = self.pieces().join(uses, ["sid", "block"]).groupBy("row").agg(
            F.sum(F.col("uses") * (F.col("high") - F.col("low"))).alias("taken"))
        return self.documents.join(words, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))

    def shard_counts(self) -> DataFrame:
        """How many blocks of each source every output shard holds."""
        return self.slots.groupBy("shard", "sid").agg(F.count("*").alias("blocks"))


def _sources(sizes: DataFrame) -> DataFrame:
    """One row per source: order, weight, target, blocks and slots."""
    everything = Window.partitionBy()
    named = Window.orderBy(F.col("source").asc_nulls_last())
    cap, weight = F.col("source_size") * float(MOST_REPEATS), F.col("weight")
    # Poorest first by words per weight: a source is capped if the level still to share exceeds its cap.
    poor = Window.orderBy(cap / weight, "sid")
    before = poor.rowsBetween(Window.unboundedPreceding, -1)
    table = sizes.groupBy("source").agg(F.sum("source_size").alias("source_size"))
    table = table.withColumn("sid", F.row_number().over(named)).withColumn("weight", (F.col("sid") - 1) % 3 + 1)
    table = table.withColumn("total", F.sum("source_size").over(everything))
    left = F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    table = table.withColumn("capped", left / heavy * weight >= cap)
    shared = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), cap)).over(everything), F.lit(0.0))
    heavy = F.sum(F.when(~F.col("capped"), weight)).over(everything)
    return table.withColumn("target", F.when(F.col("capped"), cap).otherwise(shared * weight / heavy))


def plan_mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
             block_words: int = BLOCK_WORDS, slots_per_shard: int = SLOTS_PER_SHARD, seed: int = 7) -> Mix:
    spark = df.sparkSession
    docs = materialize(df.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        place_hash(F.col(doc_id), F.col(text)).alias("place"), F.monotonically_increasing_id().alias("row")), "sizes")
    stretches = -(-docs.count() // STRETCH_ROWS) or 1
    docs = docs.withColumn("stretch", F.pmod("place", F.lit(stretches)))
    sums = docs.groupBy("source", "stretch").agg(F.sum("size").alias("source_size"))
    table = materialize(
        _sources(sums).withColumn("n", F.ceil(F.col("source_size") / block_words))
        .withColumn("q", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n") / F.col("source_size")))
                    .otherwise(0).cast("long"))
        .withColumn("first", F.sum("q").over(Window.orderBy("sid")) - F.col("q"))
        .withColumn("slots", F.sum("q").over(Window.partitionBy())), "sources")
    own = Window.partitionBy("source").orderBy("stretch")
    begins = sums.withColumn("begin", F.sum("source_size").over(own) - F.col("source_size")).drop("source_size")
    begins = begins.alias("b").join(table.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        F.col("b.source").alias("s"), F.col("stretch").alias("k"), "begin", "sid", "source_size", "target", "n", "q")
    inside = Window.partitionBy("source", "stretch").orderBy("place", "doc_id", "size", "row")
    placed = docs.withColumn("inner", F.sum("size").over(inside) - F.col("size"))
    placed = placed.join(begins, placed.source.eqNullSafe(begins.s) & (placed.stretch == begins.k)).select(
        "row", "doc_id", "source", "place", "size", "sid", "source_size", "target", "n", "q",
        (F.col("begin") + F.col("inner")).alias("start"))
    return Mix(materialize(placed, "placed"), table, _slots(table, slots_per_shard, seed), block_words)


def place_hash(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def _slots(table: DataFrame, slots_per_shard: int, seed: int) -> DataFrame:
    """(shard, place, sid, pass, block), one row per block of the mix."""
    runs = table.where("q > 0").select(
        "sid", "n", "q", "first", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1, F.lit(SLOT_RUN).cast("long"))).alias("begin"))
    runs = runs.repartition("sid", "begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rank = np.arange(r["begin"], min(r["begin"] + SLOT_RUN, r["q"]))
                turn = rank // r["n"]
                every = np.full(len(rank), 1)
                block = permuted(rank % r["n"], every * r["n"], turn * 1_000_003 + r["sid"] * 8_191 + seed)
                place = permuted(rank + r["first"], every * r["slots"], every * seed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in (place // slots_per_shard, place % slots_per_shard,
                                                       every * r["sid"], turn, block)],
                    names=["shard", "place", "sid", "turn", "block"])

    return runs.mapInArrow(run, "shard long, place long, sid long, turn long, block long")


def mixed_blocks(df: DataFrame, mix: Mix, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The mix itself: (shard, place, sid, turn, words), the words of every slot in output order."""
    words = df.select(F.col(doc_id).alias("d"), place_hash(F.col(doc_id), F.col(text)).alias("p"),
                      F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w")).dropDuplicates(["d", "p"])
    pieces = mix.pieces()
    cut = pieces.join(words, pieces.doc_id.eqNullSafe(words.d) & (pieces.place == words.p)).select(
        "sid", "block", "start", "row", F.slice("w", F.col("low").cast("int") + 1, (F.col("high") - F.col("low")).cast("int")).alias("w"))
    blocks = cut.groupBy("sid", "block").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("start", "row", "w"))), lambda x: x["w"])).alias("words"))
    return mix.slots.join(blocks, ["sid", "block"]).select("shard", "place", "sid", "turn", F.array_join("words", " ").alias("words"))


def mix_documents(df: DataFrame, mix: Mix, doc_id: str = "doc_id", text: str = "text",
                  n_chars: str = "n_chars") -> DataFrame:
    """The mix as documents with the columns of ``df``: one row per pass that takes words of a row.

    A pass that takes a whole document repeats it unchanged; one that takes some of its blocks gives
    the words of these, joined by spaces. Rows that the mix never takes drop out.
    """
    last = mix.slots.join(mix.sources.select("sid", F.floor(F.col("q") / F.col("n")).alias("whole")), "sid").where("turn = whole")
    part = mix.pieces().join(last.select("sid", "block"), ["sid", "block"]).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("low", "high"))).alias("ranges"),
        F.sum(F.col("high") - F.col("low")).alias("in_part"))
    whole = F.floor(F.col("q") / F.col("n")) + F.when(F.col("in_part") == F.col("size"), 1).otherwise(0)
    plan = mix.documents.where("size > 0").join(part, "row", "left").select(
        F.col("doc_id").alias("d"), F.col("place").alias("p"), "row", whole.alias("whole"),
        F.when(F.col("in_part") < F.col("size"), F.col("ranges")).alias("ranges")).where("whole > 0 or ranges is not null")
    plan = materialize(plan, "mix_plan")
    held = df.select(F.struct(*df.columns).alias("held"), F.col(doc_id).alias("i"), F.col(text).alias("t"),
                     place_hash(F.col(doc_id), F.col(text)).alias("h"))
    same = held.i.eqNullSafe(plan.d) & (held.h == plan.p)
    if not plan.groupBy("d", "p").count().where("count > 1").isEmpty():
        # Rows that agree in doc_id and text are paired by number.
        held = held.withColumn("k", F.row_number().over(Window.partitionBy("i", "h").orderBy("h")))
        plan = plan.withColumn("k", F.row_number().over(Window.partitionBy("d", "p").orderBy("row")))
        same = held.i.eqNullSafe(plan.d) & (held.h == plan.p) & (held.k == plan.k)
    found = held.join(plan, same).select("held", "t", "whole", "ranges")
    words = F.regexp_extract_all("t", F.lit(WORD), F.lit(0))
    picked = F.when(F.col("ranges").isNotNull(), _picked(words))
    rows = found.withColumn("texts", F.concat(
        F.array_repeat("t", F.col("whole").cast("int")), F.array_compact(F.array(picked))))
    rows = rows.select("held", F.explode("texts").alias("new"))
    columns = [F.col("new").alias(c) if c == text else
               F.length("new").cast(df.schema[c].dataType).alias(c) if c == n_chars else F.col(f"held.{c}") for c in df.columns]
    return rows.select(*columns)


def _picked(words: Column) -> Column:
    # The one-element array holds the words once for all ranges.
    return F.element_at(F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(
        "ranges", lambda r: F.slice(w, r["low"].cast("int") + 1, (r["high"] - r["low"]).cast("int")))), " ")), 1)
