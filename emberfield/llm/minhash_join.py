"""Near-duplicate join of shingle sets over an inverted index of signature coordinates.

Every set has a signature of ``COORDINATES`` values, each the pair of the set's least hashes under two hash
functions, and is posted under each (coordinate, value) pair. Two sets of similarity s collide in each
coordinate with probability s squared, so linked sets collide in far more than ``least_matches`` of them:
with 64 coordinates, 12 needed and a similarity of 0.8 a linked pair falls below with probability 1e-12.
Pairs of hashes keep the lists of frequent shingles short, which would else grow with the corpus. Pairs of
documents above the match threshold are retained and then confirmed on their full sets of shingles.

The merge of the posting lists is a prefix and skip merge. All documents order their lists by length, the
rarest first. The ``least_matches - 1`` longest lists of a document are skipped: a pair that collides
``least_matches`` times also collides in a list that neither of the two skips, namely the rarest it
shares. Skipped lists are not lost for the count: collisions are counted over all coordinates, on one byte
of each value, by bit operations. Equal bytes of different values can only raise the count. Documents whose
lists are all their own post nothing.

Lists are not expanded into all pairs. Sets that are equal are one node. First every list compares its
members with ``CENTRES`` of them. Centres are chosen by hashes that do not depend on the list, so the lists
of one group of copies choose the same few, and what links becomes one component. Lists whose members all
lie in one component are done; in the others members of different components are compared. Members of one
component are not compared again, which loses no link between components. Only pairs above the match
threshold leave a join, and of those only the ones whose shingle parities, a lower bound of the symmetric
difference, allow a link. Candidates are grouped by their centre for the confirmation: its text is sent
once for every ``GROUP`` partners, and a task holds the sets of two documents.

Defined results: a document without words, or with null text, is linked with nothing; a text with fewer
words than a shingle is one shingle; a very long text is one set like any other; rows repeated with one
doc_id are documents of their own with equal sets; of equal texts the smallest doc_id names the
component, a null doc_id only where all its rows have none; an empty table gives an empty result. Only
``doc_id`` and ``text`` are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberfield.llm.common import drop_unkept, per_row, text_print
from emberfield.llm.components import components
from emberfield.llm.parity_join import SKETCH_WORDS, Similarity, bit_sketch, shingle_hashes, shingle_set
from emberfield.session import discard, materialize

PAIRS_OF_WORDS = Similarity(width=2, share=80, whole=100)
#: A multiple of 8: one byte of each value goes into 64-bit words.
COORDINATES = 64
LEAST_MATCHES = 12
#: Members of each list that all others are compared with first.
CENTRES = 4
#: Candidates that one copy of a centre's text serves.
GROUP = 1024
#: Members of a list that one task compares with all members of the list.
LIST_PART = 1024
#: Shingles whose values are computed at once.
BLOCK = 4096
_BYTES = COORDINATES // 8
_FIELDS = ["n", *[f"s{i}" for i in range(_BYTES)], *[f"p{i}" for i in range(SKETCH_WORDS)]]


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Two hash functions for each coordinate: a shingle is hashed by an odd factor and a mask.
_MASK = _scrambled(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64))
_FACTOR = _scrambled(np.arange(1001, 2 * COORDINATES + 1001, dtype=np.uint64)) | np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Posting keys of a non-empty set: its two least hashes in each coordinate, mixed with the coordinate."""
    least = np.full(2 * COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), BLOCK):
        part = hashes[start:start + BLOCK, None] ^ _MASK
        part *= _FACTOR
        np.minimum(least, part.min(axis=0), out=least)
    return _scrambled(_scrambled(least[:COORDINATES] + _MASK[:COORDINATES]) + least[COORDINATES:])


def signature_bytes(keys: np.ndarray) -> np.ndarray:
    """One byte of each key, eight of them in a 64-bit word."""
    return (keys >> np.uint64(56)).astype(np.uint8).view(np.int64)


_ADDED = T.StructType([
    T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()),
    T.StructField("bytes", T.ArrayType(T.LongType())), T.StructField("parity", T.ArrayType(T.LongType())),
    T.StructField("keys", T.ArrayType(T.LongType()))])


def _signed(docs: DataFrame, like: Similarity) -> DataFrame:
    def run(values: Iterator[tuple]) -> Iterable[tuple]:
        for (text,) in values:
            hashes = shingle_hashes(text, like.width)
            if not len(hashes):
                yield 0, b"", None, None, None
                continue
            keys = signature(hashes)
            # 128 bits of the set, whatever the order of its shingles.
            set_key = hashes.sum().tobytes() + np.bitwise_xor.reduce(_scrambled(hashes)).tobytes()
            yield len(hashes), set_key, signature_bytes(keys), bit_sketch(hashes), keys.view(np.int64)

    return per_row(docs, ["text"], _ADDED, run, keep=["doc_id", "print"])


def _flat(doc: Column, prefix: str) -> list[Column]:
    """The fields of a sketch as columns without nulls: a condition on them compiles to a method short enough for the JIT."""
    return [F.coalesce(doc[name], F.lit(0).cast("long")).alias(prefix + name) for name in _FIELDS]


def _flattened(prefix: str) -> dict[str, Column]:
    return {name: F.col(prefix + name) for name in _FIELDS}


def _collisions(a: Mapping[str, Column], b: Mapping[str, Column]) -> Column:
    """Equal bytes of two signatures: every byte that differs is folded onto its lowest bit."""
    def differing(i: int) -> Column:
        x = a[f"s{i}"].bitwiseXOR(b[f"s{i}"])
        for step in (4, 2, 1):
            x = x.bitwiseOR(F.shiftright(x, step))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    return F.lit(COORDINATES) - sum((differing(i) for i in range(_BYTES)), F.lit(0))


def _may_link(a: Mapping[str, Column], b: Mapping[str, Column], like: Similarity, least_matches: int) -> Column:
    """Sizes within the ratio, enough collisions, and differing parities within the bound of the sizes."""
    differing = sum((F.bit_count(a[f"p{i}"].bitwiseXOR(b[f"p{i}"])) for i in range(SKETCH_WORDS)), F.lit(0))
    return ((a["n"] * like.whole >= like.share * b["n"]) & (b["n"] * like.whole >= like.share * a["n"])
            & (_collisions(a, b) >= least_matches)
            & (differing * (like.whole + like.share) <= (a["n"] + b["n"]) * (like.whole - like.share)))


def _posted(nodes: DataFrame, least_matches: int) -> DataFrame:
    """(key, row) of the lists that a document doesn't skip and that hold several documents."""
    lists = materialize(nodes.select("row", F.explode("keys").alias("key")), "lists")
    lengths = materialize(lists.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "list_lengths")
    longest = Window.partitionBy("row").orderBy(F.desc("n"), "key")
    kept = materialize(lists.join(lengths, "key").withColumn("place", F.row_number().over(longest))
                       .where(F.col("place") >= least_matches).select("key", "row"), "kept_lists")
    discard(lists, lengths)
    return kept


def _centre_pairs(members: DataFrame, docs: DataFrame, like: Similarity, least_matches: int) -> DataFrame:
    """(a, b): each list's centres a with its members b, if they may link."""
    # Written, so that a list with many members can be split in the join.
    centres = materialize(members.groupBy("key").agg(F.array_distinct(F.array(*[
        F.min_by("row", F.xxhash64("row", F.lit(i))) for i in range(CENTRES)])).alias("centres")), "centres")
    # The lists of a group of copies name the same pairs, so pairs are merged before sketches join them.
    met = materialize(members.join(centres, "key").select(F.explode("centres").alias("a"), F.col("row").alias("b"))
                      .where("a <> b").distinct(), "met")
    left = docs.select(F.col("row").alias("a"), *_flat(F.col("doc"), "x_"))
    right = docs.select(F.col("row").alias("b"), *_flat(F.col("doc"), "y_"))
    joined = met.hint("merge").join(left, "a").hint("merge").join(right, "b")
    return joined.where(_may_link(_flattened("x_"), _flattened("y_"), like, least_matches)).select("a", "b")


def _open_pairs(members: DataFrame, docs: DataFrame, like: Similarity, least_matches: int) -> DataFrame:
    """(a, b) with a < b: members of one list in different components, if they may link."""
    # The members of a long list meet in several parts: each member is in one, and is compared with all of them.
    lengths = materialize(members.groupBy("key").agg(F.ceil(F.count("*") / LIST_PART).alias("parts")), "list_parts")
    left = materialize(members.hint("merge").join(docs, "row").join(lengths, "key"), "open_members")
    one = left.select("key", F.pmod(F.xxhash64("row"), F.col("parts")).alias("part"), "row", "component", *_flat(F.col("doc"), "x_"))
    all_parts = left.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
                            F.col("row").alias("r"), F.col("component").alias("c"), *_flat(F.col("doc"), "y_"))
    met = one.hint("merge").join(all_parts, ["key", "part"]).where(
        (F.col("row") < F.col("r")) & (F.col("component") != F.col("c"))
        & _may_link(_flattened("x_"), _flattened("y_"), like, least_matches))
    return met.select(F.col("row").alias("a"), F.col("r").alias("b")).distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, like: Similarity) -> DataFrame:
    """Pairs whose full sets of shingles are similar enough. Texts of one group pass through a task one by one."""
    groups = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("parts")), "centre_groups")
    dealt = materialize(pairs.join(groups, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")), "dealt_pairs")
    heads = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    text = texts.select("row", "text").hint("merge")
    sent = heads.join(text, heads.a == text.row).select("a", "part", F.lit(-1).cast("long").alias("b"), "text").union(
        dealt.join(text, dealt.b == text.row).select("a", "part", "b", "text"))
    sent = sent.repartition("a", "part").sortWithinPartitions("a", "part", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: set = set()
        for batch in batches:
            linked: tuple[list, list] = [], []
            for a, b, text in zip(*(batch.column(c) for c in ("a", "b", "text"))):
                own = shingle_set(text.as_py(), like.width)
                if b.as_py() == -1:
                    head = own
                    continue
                both = len(head & own)
                if like.whole * both >= like.share * (len(head) + len(own) - both):
                    linked[0].append(a.as_py())
                    linked[1].append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in linked], names=["a", "b"])

    return sent.mapInArrow(run, "a long, b long")


def near_components(df: DataFrame, like: Similarity = PAIRS_OF_WORDS, doc_id: str = "doc_id", text: str = "text",
                    least_matches: int = LEAST_MATCHES) -> DataFrame:
    """(doc_id, print, n_shingles, component_id, n_links, kept) for every row of ``df``.

    One row of each component is kept. ``n_links`` counts the confirmed links of the row's set, which
    connect its component; a link that other links imply need not be among them.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), text_print(F.col(text)).alias("print"))
    signed = materialize(_signed(docs, like).withColumn("row", F.monotonically_increasing_id()), "signatures")
    rows = signed.select("row", "doc_id", "print", "n_shingles", "set_key")
    classes = materialize(rows.where("n_shingles > 0").groupBy("n_shingles", "set_key").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("least_id"),
        F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("keep_row")), "classes")
    nodes = materialize(signed.join(classes.select(F.col("node").alias("row")).hint("merge"), "row", "left_semi"), "nodes")
    members = _posted(nodes, least_matches)
    posted = materialize(nodes.join(members.select("row").distinct().hint("merge"), "row", "left_semi").select(
        "row", "doc_id", "print", F.struct(
            F.col("n_shingles").alias("n"), *[F.get("bytes", F.lit(i)).alias(f"s{i}") for i in range(_BYTES)],
            *[F.get("parity", F.lit(i)).alias(f"p{i}") for i in range(SKETCH_WORDS)]).alias("doc")), "posted")
    discard(nodes)
    sketches = posted.select("row", "doc")
    named = posted.select("row", F.col("doc_id").alias("i"), F.col("print").alias("p")).hint("merge")
    texts = materialize(docs.join(named, docs.doc_id.eqNullSafe(named.i) & (docs.print == named.p))
                        .select("row", "text").dropDuplicates(["row"]), "texts")

    first = materialize(_centre_pairs(members, sketches, like, least_matches), "retained")
    links = materialize(_confirmed(first, texts, like), "confirmed")
    linked = materialize(components(links, "a", "b"), "linked")
    placed = materialize(members.join(linked.withColumnRenamed("node", "row"), "row", "left").withColumn(
        "component", F.coalesce("component", "row")), "placed")
    # Lists whose members all lie in one component are done.
    several = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    still = materialize(placed.join(several.select("key"), "key"), "open_lists")
    discard(placed, members)
    tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = _open_pairs(still, sketches, like, least_matches).join(tested, ["a", "b"], "left_anti")
    more = materialize(_confirmed(materialize(second, "retained"), texts, like), "confirmed")
    if not more.isEmpty():
        links = links.union(more)
        linked = materialize(components(links, "a", "b"), "linked")
    discard(texts)

    ends = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    grouped = classes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"), F.coalesce(
        F.min_by("keep_row", "least_id"), F.min("keep_row")).alias("stays"))
    labels = materialize(grouped.join(whole, "component").join(ends, "node", "left").select(
        "n_shingles", "set_key", "component_id", "stays", "n_links"), "labels")
    lone = F.col("stays").isNull()
    return rows.join(labels, ["n_shingles", "set_key"], "left").select(
        "doc_id", "print", "n_shingles", F.when(lone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), (lone | (F.col("row") == F.col("stays"))).alias("kept"))


def drop_near_duplicates(df: DataFrame, like: Similarity = PAIRS_OF_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one document of each component, its columns as they are."""
    judged = materialize(near_components(df, like, doc_id, text), "judged")
    return drop_unkept(df, judged, doc_id, text)
