"""Near-duplicate join of shingle sets by parity sketches.

A document is its set of distinct word shingles. Linked sets differ in at most a fixed share of their
summed sizes (a nineteenth for a similarity of 0.9). Every shingle is XOR-hashed into a bit sketch and
into one of the lanes of a wider sketch, whose words are 64 bits: what two sets share cancels, so the
Hamming distance of the bits, and the number of differing lanes, are lower bounds of the symmetric
difference. With more lanes than allowed differences some lane is equal (pigeonhole), so an equi-join
on (size band, lane, word) meets every linked pair. A document joins every band that its least or most
similar partner can be in. Candidates must pass the Hamming bound, then the exact comparison of sets.

There are ``spare`` more lanes than needed, so a linked pair shares at least ``spare + 1`` lanes. Every
document leaves out its ``spare`` lanes whose words are most frequent over all documents (empty lanes,
lanes of a common passage); the rarest lane that a linked pair shares is never among them, because at
least ``spare`` shared ones are more frequent. That bounds no bucket and loses no pair.

Documents with equal sets are merged first. Then every bucket compares its members with ``CENTERS`` of
them, chosen by a hash, which connects groups of copies in as many comparisons as the buckets have
members. Last, buckets that still hold several components compare every pair of different components.
Only pairs within the Hamming bound leave a join. No link between different texts is lost: what is not
compared is connected already.

Defined results: a document without words is linked with nothing; rows repeated with one doc_id are
separate documents with equal sets; a null doc_id names a component only if all its rows have none;
an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberfield.llm.common import document_bytes, drop_unkept, per_row, text_print
from emberfield.llm.components import components
from emberfield.session import discard, materialize



@dataclass(frozen=True)
class Similarity:
    """Sets of ``width``-word shingles link when whole * intersection >= share * union."""

    width: int = 3
    share: int = 90
    whole: int = 100

    def allowed(self, sizes: int) -> int:
        """Most differences that two linked sets of ``sizes`` shingles together can have."""
        return sizes * (self.whole - self.share) // (self.whole + self.share)


DEFAULT = Similarity()
BAND_RATIO = 1.5
#: Lanes beyond the needed ones, as a share of the allowed differences.
SPARE = 0.25
#: Members of each bucket that all others are compared with first.
CENTERS = 2
#: 64-bit words of the bit sketch that is compared inside the bucket join.
SKETCH_WORDS = 16
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case."""
    return document_bytes(text).translate(_LOWER).split()


def shingle_set(text: str | None, width: int = 3) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """One 64-bit hash per distinct shingle; distinctness is decided on word numbers, not hashes."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    span = min(width, len(words))
    code, first = ids[:len(ids) - span + 1], None
    for i in range(1, span):
        if (int(code.max()) + 1) * len(number) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(number) + ids[i:len(ids) - span + 1 + i]
    first = np.unique(code, return_index=True)[1]
    out = np.full(len(first), span, np.uint64)
    for i in range(span):
        out = _mix(out + hashes[ids[first + i]])
    return out


@functools.lru_cache(maxsize=100_000)
def band(size: int) -> tuple[int, int, int]:
    """(number, first size, first size of the next) of the band that holds ``size``."""
    low, number = 1, 0
    while True:
        high = max(low + 1, int(low * BAND_RATIO))
        if size < high:
            return number, low, high
        low, number = high, number + 1


@functools.lru_cache(maxsize=10_000)
def lanes_of(high: int, like: Similarity) -> tuple[int, int]:
    """Lanes of a band whose sizes stay below ``high``, and how many of them are spare."""
    allowed = like.allowed(2 * (high - 1))
    spare = max(2, int(SPARE * allowed)) if allowed else 0
    return allowed + 1 + spare, spare


def bands_of(size: int, like: Similarity) -> list[tuple[int, int]]:
    """(band, its upper end) for each band in which a document of this size meets others."""
    number, _, high = band(size)
    out = [(number, high)]
    while size * like.whole >= like.share * high:
        number, _, high = band(high)
        out.append((number, high))
    return out


def lane_keys(hashes: np.ndarray, number: int, high: int, like: Similarity) -> np.ndarray:
    """One join key per lane of a band: the XOR of what falls into the lane, mixed with its place."""
    parts, _ = lanes_of(high, like)
    lane = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    words = np.zeros(parts, np.uint64)
    np.bitwise_xor.at(words, lane, _mix(hashes))
    return _mix(words + _mix(np.arange(parts, dtype=np.uint64) + np.uint64(number << 32)))


def bit_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall on each bit, in 64-bit words."""
    bits = 64 * SKETCH_WORDS
    count = np.bincount((hashes >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(bool), bitorder="little").view(np.int64)


_LANES = T.StructType([T.StructField("spare", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))])
_ADDED = T.StructType([
    T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()),
    T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("lanes", T.ArrayType(_LANES))])


def _sketched(docs: DataFrame, like: Similarity) -> DataFrame:
    def run(values: Iterator[tuple]) -> Iterable[tuple]:
        for (text,) in values:
            hashes = shingle_hashes(text, like.width)
            size = len(hashes)
            if not size:
                yield 0, b"", None, []
                continue
            lanes = [{"spare": lanes_of(high, like)[1], "keys": lane_keys(hashes, number, high, like).view(np.int64)}
                     for number, high in bands_of(size, like)]
            set_key = hashes.sum().tobytes() + np.bitwise_xor.reduce(_mix(hashes + np.uint64(1))).tobytes()
            yield size, set_key, bit_sketch(hashes), lanes

    return per_row(docs, ["text"], _ADDED, run, keep=["doc_id", "print"])


def _may_link(a: Column, b: Column, like: Similarity) -> Column:
    """Sizes within the ratio, and Hamming distance of the sketches within the bound of the sizes."""
    distance = sum((F.bit_count(a[f"w{i}"].bitwiseXOR(b[f"w{i}"])) for i in range(SKETCH_WORDS)), F.lit(0))
    return ((a["n"] * like.whole >= like.share * b["n"]) & (b["n"] * like.whole >= like.share * a["n"])
            & (distance * (like.whole + like.share) <= (a["n"] + b["n"]) * (like.whole - like.share)))


def _verified(pairs: DataFrame, texts: DataFrame, like: Similarity) -> DataFrame:
    """Pairs whose shingle sets are similar enough, compared word by word."""
    pairs = pairs.hint("merge")
    joined = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a").hint("merge").join(
        texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")

    def run(values: Iterator[tuple]) -> Iterable[tuple]:
        known = functools.lru_cache(maxsize=4)(shingle_set)
        for left, right in values:
            x, y = known(left, like.width), known(right, like.width)
            both = len(x & y)
            yield (like.whole * both >= like.share * (len(x) + len(y) - both),)

    added = T.StructType([T.StructField("linked", T.BooleanType())])
    return per_row(joined, ["text_a", "text_b"], added, run, keep=["a", "b"]).where("linked").select("a", "b")


def _star_pairs(members: DataFrame, like: Similarity) -> DataFrame:
    """(a, b) with a < b: every member of a bucket with ``CENTERS`` of its members, chosen by a hash."""
    chosen = members.groupBy("key").agg(*[
        F.min_by("doc", F.xxhash64("row", "key", F.lit(i))).alias(f"c{i}") for i in range(CENTERS)])
    # Written, so that a bucket with many members can be split in the join.
    chosen = materialize(chosen, "centers")
    met = members.join(chosen, "key").select("doc", F.explode(F.array(*[f"c{i}" for i in range(CENTERS)])).alias("other"))
    return _pairs(met.where("doc.row <> other.row"), like)


def _open_pairs(members: DataFrame, linked: DataFrame, tested: DataFrame, like: Similarity) -> DataFrame:
    """(a, b) with a < b: members of one bucket in different components that were not compared yet."""
    placed = members.join(linked.withColumnRenamed("node", "row"), "row", "left").withColumn(
        "component", F.coalesce("component", "row"))
    placed = materialize(placed, "placed")
    discard(members)
    wide = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    left = materialize(placed.join(wide.select("key"), "key"), "open_lanes")
    discard(placed)
    right = left.select("key", F.col("doc").alias("other"), F.col("component").alias("c"))
    met = left.join(right, "key").where("doc.row < other.row and component <> c")
    return _pairs(met, like).join(tested, ["a", "b"], "left_anti")


def _pairs(met: DataFrame, like: Similarity) -> DataFrame:
    close = met.where(_may_link(F.col("doc"), F.col("other"), like))
    return close.select(F.least("doc.row", "other.row").alias("a"), F.greatest("doc.row", "other.row").alias("b")).distinct()


def near_groups(df: DataFrame, like: Similarity = DEFAULT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print, n_shingles, component_id, kept) for every row of ``df``; one row of each component is kept."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), text_print(F.col(text)).alias("print"))
    sketched = materialize(_sketched(docs, like).withColumn("row", F.monotonically_increasing_id()), "sketches")
    # The lanes are by far the largest column; their table goes as soon as they are dealt out.
    lean = materialize(sketched.drop("lanes"), "lean_sketches")
    rows = lean.select("row", "doc_id", "print", "n_shingles", "set_key")
    classes = materialize(rows.where("n_shingles > 0").groupBy("n_shingles", "set_key").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("least_id"),
        F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("keep_row")), "classes")
    # Only one document of each class goes on.
    # The merge hints keep the plan of the large joins alike at every size.
    nodes = sketched.select("row", "lanes").join(classes.select(F.col("node").alias("row")).hint("merge"), "row", "left_semi")
    lanes = materialize(nodes.select("row", F.explode("lanes").alias("l")).select(
        "row", F.col("l.spare").alias("spare"), F.explode("l.keys").alias("key")), "lanes")
    discard(sketched)
    busy = materialize(lanes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "busy_lanes")
    # A band has its own number of spare lanes, so the bands of a document stay apart.
    frequent = Window.partitionBy("row", "spare").orderBy(F.desc("n"), "key")
    busy_rows = materialize(lanes.join(busy, "key").withColumn("place", F.row_number().over(frequent))
                            .where("place > spare").select("key", "row"), "busy_rows")
    discard(lanes, busy)
    met = busy_rows.select("row").distinct().hint("merge")
    candidates = materialize(lean.join(met, "row", "left_semi").select("row", "doc_id", "print", F.struct(
        "row", F.col("n_shingles").alias("n"), *[F.get("sketch", F.lit(i)).alias(f"w{i}") for i in range(SKETCH_WORDS)]
    ).alias("doc")), "candidates")
    members = materialize(busy_rows.join(candidates.select("row", "doc"), "row"), "members")
    # Large tables go as soon as nothing reads them again.
    rows = materialize(rows, "rows")
    discard(busy_rows, lean)
    named = candidates.select("row", F.col("doc_id").alias("i"), F.col("print").alias("p")).hint("merge")
    texts = materialize(docs.join(named, docs.doc_id.eqNullSafe(named.i) & (docs.print == named.p))
                        .select("row", "text").dropDuplicates(["row"]), "candidate_texts")
    discard(candidates)

    first = materialize(_star_pairs(members, like), "star_pairs")
    links = materialize(_verified(first, texts, like), "links")
    linked = materialize(components(links, "a", "b"), "linked")
    second = materialize(_open_pairs(members, linked, first, like), "open_pairs")
    more = materialize(_verified(second, texts, like), "links")
    if not more.isEmpty():
        linked = materialize(components(links.union(more), "a", "b"), "linked")
    discard(texts)

    grouped = classes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"), F.coalesce(
        F.min_by("keep_row", "least_id"), F.min("keep_row")).alias("stays"))
    labels = materialize(grouped.join(whole, "component").select("n_shingles", "set_key", "component_id", "stays"), "labels")
    lone = F.col("stays").isNull()
    return rows.join(labels, ["n_shingles", "set_key"], "left").select(
        "doc_id", "print", "n_shingles", F.when(lone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (lone | (F.col("row") == F.col("stays"))).alias("kept"))


def drop_near_copies(df: DataFrame, like: Similarity = DEFAULT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one document of each component, its columns as they are."""
    judged = materialize(near_groups(df, like, doc_id, text), "judged")
    return drop_unkept(df, judged, doc_id, text)
