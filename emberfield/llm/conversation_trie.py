"""Trie of conversation prefixes by van Emde Boas recursion.

A conversation is its sequence of turns. A node of the trie is a distinct sequence of first turns; its
members are the conversations that start with it. The trie is built without walking down turn by turn:
a trie of height 2h is cut at half depth. The distinct first h turns are the *cut prefixes*, which get
names. They form the upper trie; what follows a cut prefix forms the lower trie under its name. Both have
height h, and all upper and lower tries of a step are cut again in one Spark job, so there are as many
steps as the longest conversation has binary digits. Equal sequences of one trie are merged in every step
by sums and minima, combined before the shuffle, so copies and common first turns cost one row per task.

At height 1 a trie is a named parent with its children, which gives the nodes. Totals of subtrees are then
grafted upward and handed down along the same cuts. Upward: the total of a trie of height 2h is the total
of its upper trie and those of its lower ones. Downward: what lies below a cut prefix is the total of its
lower trie and what lies below that one's deepest nodes, known from the step before. The step of height
2^k has rows only for nodes whose depth is a multiple of 2^k.

A turn enters as 128 bits of the SHA-256 of its role and text, a cut prefix as 128 bits of the SHA-256 of
the name it hangs on and the turns since; texts are read once and never shuffled. A conversation is one row
of 24 bytes a turn, as a document is one row.

Defined results: turns go by number, null first, and turns of one number by role and digest; repeated
rows are turns of their own; null role or text is empty; very long texts count as one turn like any other;
rows without a conversation number belong to none; an empty table has no node, not even the root. Only the
named columns are read, so further columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.llm.common import WORD
from emberfield.session import discard, materialize

#: Hex digits of a turn: 32 of its digest, 16 of the number of its words; bytes are half as many.
DIGEST, COUNT = 32, 16
TURN = (DIGEST + COUNT) // 2
#: Conversation numbers that are joined to one text before a digest is taken over such texts.
NUMBERS = 4096
_ROOT = b"root"


def turn_digest(role: Column, text: Column) -> Column:
    """Hex digest that tells turns apart: of the length of the role, the role and the text."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def sequences(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
              shared: int = 0, family: int = 20) -> DataFrame:
    """(conv, seq): every conversation as one binary of fixed-width turns.

    With ``shared`` > 0 conversations are rebuilt: the first h turns come from the conversation
    ``conv - conv % family`` (all it has if fewer, none if there is no such conversation), then follow
    the conversation's own turns after its first h; h is the checksum of its number modulo ``shared``.
    """
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(WORD)).cast("long")), COUNT, "0")
    one = F.concat(F.substring(turn_digest(role, text), 1, DIGEST), words)
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.struct(F.col(turn).alias("turn"), role.alias("role"), one.alias("code")).alias("t"))
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv", F.col("t.code").alias("codes"))
    if shared:
        whole = materialize(whole, "conversations")
        first = whole.where(F.col("conv") % family == 0).select(
            F.col("conv").alias("base"), F.slice("codes", 1, shared - 1).alias("lead"))
        h = F.crc32(F.col("conv").cast("string").cast("binary")) % shared
        whole = whole.withColumn("base", F.col("conv") - F.col("conv") % family).withColumn("h", h.cast("int")).join(
            first, "base", "left").select("conv", F.concat(
                F.slice(F.coalesce("lead", F.array().cast("array<string>")), F.lit(1), F.col("h")),
                F.slice("codes", F.col("h") + 1, F.size("codes"))).alias("codes"))
    return whole.select("conv", F.unhex(F.array_join("codes", "")).alias("seq"))


def _name(trie: Column, seq: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(trie, seq), 256)), 1, DIGEST // 2)


def _cut(items: DataFrame, half: int) -> DataFrame:
    """Items of tries of height ``2 * half`` as items of their upper and lower tries.

    An item is a sequence in a trie: (trie, depth of its root, seq, name of its last node, n members,
    conv smallest member, ends whole sequence that ends there). An item that fills its new trie ends in
    a cut prefix and gets its name there.
    """
    bytes_ = half * TURN
    head = F.substring("seq", 1, bytes_)
    cut = _name(F.col("trie"), head)

    def item(trie, depth, seq, name, ends) -> Column:
        return F.struct(trie.alias("trie"), depth.alias("depth"), seq.alias("seq"), name.alias("name"),
                        F.col("n"), F.col("conv"), ends.alias("ends"))

    nothing = F.lit(None).cast("binary")
    same = item(F.col("trie"), F.col("depth"), F.col("seq"),
                F.when(F.length("seq") == bytes_, cut).otherwise(F.col("name")), F.col("ends"))
    upper = item(F.col("trie"), F.col("depth"), head, cut, nothing)
    rest = F.substring(F.col("seq"), F.lit(bytes_ + 1), F.length("seq") - bytes_)
    fills = F.length("seq") == 2 * bytes_
    # The last node of a full item was named one step before.
    lower = item(cut, F.col("depth") + half, rest, F.when(fills, F.col("name")), F.col("ends"))
    pieces = items.select(F.explode(F.when(F.length("seq") > bytes_, F.array(upper, lower)).otherwise(F.array(same))).alias("i"))
    pieces = pieces.select("i.*")
    # A piece that fills its lower trie without a name of its own ends there: it is a cut prefix as well.
    filled = F.when(F.length("seq") == bytes_, F.coalesce("name", _name(F.col("trie"), F.col("seq")))).otherwise(F.col("name"))
    return pieces.withColumn("name", filled).groupBy("trie", "depth", "seq").agg(
        F.max("name").alias("name"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max("ends").alias("ends"))


@dataclass
class Trie:
    """Nodes below the root, and for each step the nodes that fill a trie of height 2^k with its root."""

    nodes: DataFrame
    links: list[DataFrame]


def build(seqs: DataFrame) -> Trie:
    """Cut the sequences of (conv, seq) until all tries have height 1."""
    items = materialize(seqs.where(F.length("seq") > 0).groupBy("seq").agg(F.count("*").alias("n"), F.min("conv").alias("conv")).select(
        F.lit(_ROOT).alias("trie"), F.lit(0).cast("long").alias("depth"), "seq", F.lit(None).cast("binary").alias("name"), "n", "conv",
        _key(F.col("seq")).alias("ends")), "items")
    longest = (items.agg(F.max(F.length("seq"))).first()[0] or 0) // TURN
    links: list[DataFrame] = []
    for k in reversed(range(max(1, (max(longest, 1) - 1).bit_length()))):
        cut = materialize(_cut(items, 1 << k), "cut_items")
        discard(items)
        items = cut
        links.insert(0, materialize(items.where(F.length("seq") == (TURN << k)).select("name", "trie", F.col("depth").alias("from_depth")), "links"))
    nodes = items.select(
        "name", F.col("trie").alias("parent"), (F.col("depth") + 1).alias("depth"), "conv", "n", "ends",
        F.conv(F.hex(F.substring("seq", DIGEST // 2 + 1, COUNT // 2)), 16, 10).cast("long").alias("words"))
    return Trie(nodes, links)


def _key(seq: Column) -> Column:
    return F.unhex(F.sha2(seq, 256))


_SUMS = ("n_children", "n_leaves", "saved_tokens")


def totals(trie: Trie) -> DataFrame:
    """(name, n_children, n_leaves, saved_tokens) of what lies strictly below each inner node."""
    own = trie.nodes.join(trie.nodes.select(F.col("parent").alias("name")).distinct(), "name", "left_anti").select(
        "name", F.lit(1).alias("leaf"))
    marked = trie.nodes.select("name", "parent", "depth", ((F.col("n") - 1) * F.col("words")).alias("saved")).join(own, "name", "left")
    total = materialize(marked.groupBy(F.col("parent").alias("name")).agg(
        F.min(F.col("depth") - 1).alias("depth"), F.count("*").alias("n_children"),
        F.count("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")), "totals")
    # Upward: a trie of twice the height is its upper trie and the lower ones, which hang on its cut prefixes.
    steps = [total.select("name", "depth", "n_leaves", "saved_tokens")]
    for k, link in enumerate(trie.links):
        hung = link.where(F.col("from_depth") % (2 << k) == 0).select("name", "trie", "from_depth")
        grafted = steps[-1].join(hung, "name", "left").select(
            F.coalesce("trie", "name").alias("name"), F.coalesce("from_depth", "depth").alias("depth"), "n_leaves", "saved_tokens")
        steps.append(materialize(grafted.groupBy("name").agg(
            F.min("depth").alias("depth"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")), "grafted"))
    # Downward: below a cut prefix lies its lower trie, and what lies below the deepest nodes of that.
    below = steps[-1].where("depth = 0").select("name", "n_leaves", "saved_tokens")
    known = below.where("false")
    parts = [below]
    for k in reversed(range(len(trie.links))):
        odd = F.col("depth") % (2 << k) != 0
        inner = steps[k].where(odd).select("name", "n_leaves", "saved_tokens")
        under = known.join(trie.links[k].where(F.col("from_depth") % (2 << k) != 0).select("name", "trie"), "name").select(
            F.col("trie").alias("name"), "n_leaves", "saved_tokens")
        now = materialize(inner.union(under).groupBy("name").agg(
            F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")), "below")
        parts.append(now)
        known = known.union(now)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return total.select("name", "n_children").join(whole, "name")


def number_digests(rows: DataFrame) -> DataFrame:
    """(key, sha256) of the comma-joined numbers of each key in (key, conv), ascending.

    Numbers are joined by ranges of ``NUMBERS`` on all tasks. What is left to one task of a key is a
    digest over these texts in order, which passes through it one by one.
    """
    texts = rows.groupBy("key", F.floor(F.col("conv") / NUMBERS).alias("range")).agg(
        F.sort_array(F.collect_list("conv")).alias("convs"))
    texts = texts.select("key", "range", F.array_join(F.col("convs").cast("array<string>"), ",").alias("listed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done: tuple[list, list] = [], []
            for key, listed in zip(batch.column("key").to_pylist(), batch.column("listed")):
                if key == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        done[0].append(now)
                        done[1].append(digest.hexdigest())
                    now, digest = key, hashlib.sha256()
                digest.update(listed.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], names=["key", "sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "sha256"])

    return texts.repartition("key").sortWithinPartitions("key", "range").mapInArrow(run, "key binary, sha256 string")


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """One row per node of the trie over (conv, seq): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    A node is named by its depth and its smallest member. ``saved_tokens`` adds up, over the subtree, the
    words of a node's last turn for all members but one; ``ends_sha256`` is over the members that end here.
    """
    seqs = materialize(seqs, "sequences")
    trie = build(seqs)
    nodes = materialize(trie.nodes, "nodes")
    trie.nodes = nodes
    below = materialize(totals(trie), "subtrees")
    root = seqs.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).where("n > 0").select(
        F.lit(_ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"),
        "conv", "n", _key(F.lit(b"")).alias("ends"), F.lit(0).cast("long").alias("words"))
    every = materialize(root.unionByName(nodes), "all_nodes")
    ended = materialize(number_digests(seqs.select(_key(F.col("seq")).alias("key"), "conv")), "ends")
    # Written, so that the children of a hot node can be split in the join.
    parents = materialize(every.join(nodes.select(F.col("parent").alias("name")).distinct(), "name", "left_semi").select(
        F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id")), "parents")
    nothing = hashlib.sha256(b"").hexdigest()
    return every.join(below, "name", "left").join(ended.withColumnRenamed("key", "ends"), "ends", "left").join(parents, "parent", "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        (F.coalesce("saved_tokens", F.lit(0)) + (F.col("n") - 1) * F.col("words")).alias("saved_tokens"),
        F.coalesce("sha256", F.lit(nothing)).alias("ends_sha256"))
