"""Prefix trie of conversations, totalled by leaf-peeling messages.

A node is a distinct sequence of first d turns (role and text) of any conversation; the root has none. A sequence's key is the
XOR of 128-bit hashes of its turns with their places, so keys of all prefixes are running XORs: kept within blocks of
``BLOCK`` turns and carried from block to block, and a conversation of any length is dealt over many tasks.

Totals of subtrees: each node holds the number of its children that aren't complete and the XOR of their keys. In each round
complete nodes send their totals to their parents, which add them, count down and take the senders' keys out of their XOR; a
node that waits for one child therefore knows its key. Such nodes also pass over one another: one that waits for another
waiting node adds that one's part and then waits for its child, so that a path of any length halves in each round. Rounds
grow with the logarithm of the number of nodes, whatever the trie's shape, and end when the root is complete.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise, release

#: Turns in a block: a power of two (its exponent), as is the number of conversation ids in a piece of a node's list.
BLOCK_BITS, PIECE_BITS = 10, 12


def ordered_turns(conversations: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Turns as (c, block, i, r1, r2, bytes): place ``i`` (from 1) within a block of turn numbers, hashes, bytes of the text.

    Order: turn (null first), then role and text. A null role or text counts as empty; rows without conv_id belong to no
    conversation and go; repeated rows are turns of their own.
    """
    own = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("role", "text")))
    own = own.withColumn("block", F.coalesce(F.shiftright("turn", block_bits), F.lit(-(1 << 63))))
    place = F.row_number().over(Window.partitionBy("c", "block").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    return own.select("c", "block", place.alias("i"), *(F.xxhash64(F.lit(s), "role", "text").alias(f"r{s}") for s in (1, 2)), F.octet_length("text").alias("bytes"))


def rebuilt(conversations: DataFrame, group: int = 5, heads: int = 9, block_bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Each conversation c with the first h = crc32(c's digits) % ``heads`` turns of conversation c - c % ``group`` (what there is
    of them) in place of its own first h: turns (c, d, r1, r2, bytes, length), members (c, length), and what to release."""
    turns = materialise(ordered_turns(conversations, block_bits), "turns")
    blocks = turns.groupBy("c", "block").agg(F.max("i").alias("n"))
    sizes = blocks.groupBy("c").agg(F.sum("n").alias("n"))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % heads
    known = sizes.select("c", "n", (F.col("c") - F.col("c") % group).alias("base"), h.alias("h"))
    known = known.join(sizes.select(F.col("c").alias("base"), F.col("n").alias("n_base")), "base", "left")
    known = known.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    members = materialise(known.select("c", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "members")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select("c", "block", before.alias("before"))
    first = turns.join(placed.where(F.col("before") < heads - 1), ["c", "block"]).withColumn("d", F.col("before") + F.col("i")).where(F.col("d") < heads)
    first = first.select(F.col("c").alias("base"), "d", "r1", "r2", "bytes").join(members.where("taken > 0"), "base").where(F.col("d") <= F.col("h"))
    rest = turns.join(placed.join(members, "c"), ["c", "block"]).withColumn("d", F.col("before") + F.col("i")).where(F.col("d") > F.col("h")).withColumn("d", F.col("d") - F.col("h") + F.col("taken"))
    columns = ["c", "d", "r1", "r2", "bytes", "length"]
    return first.select(columns).unionByName(rest.select(columns)), members.select("c", "length"), [turns, members]


def prefix_keys(turns: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Turns with the key (k1, k2) of the prefix that ends there and (p1, p2) of the one before."""
    own = turns.select("c", "d", "bytes", "length", F.shiftright(F.col("d") - 1, block_bits).alias("block"), F.xxhash64("d", "r1", "r2").alias("e1"), F.xxhash64("r2", F.lit(7), "d", "r1").alias("e2"))
    so_far = Window.partitionBy("c", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = own.where(F.col("length") > 1 << block_bits).groupBy("c", "block").agg(*(F.bit_xor(e).alias(e) for e in ("e1", "e2")))
    carried = whole.select("c", "block", *(F.expr(f"bit_xor({e})").over(earlier).alias(f"b{i}") for i, e in ((1, "e1"), (2, "e2"))))
    keyed = own.withColumns({f"k{i}": F.bit_xor(f"e{i}").over(so_far) for i in (1, 2)}).join(carried, ["c", "block"], "left")
    keyed = keyed.withColumns({f"k{i}": F.col(f"k{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))) for i in (1, 2)})
    return keyed.select("c", "d", "bytes", "length", "k1", "k2", *(F.col(f"k{i}").bitwiseXOR(F.col(f"e{i}")).alias(f"p{i}") for i in (1, 2)))


_STATE = ["k1", "k2", "p1", "p2", "open", "x1", "x2", "leaves", "saved"]


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])


def _added(joined: DataFrame, m: str, **columns) -> DataFrame:
    """Rows of ``_STATE`` with the totals ``m``leaves and ``m``saved of a left join added."""
    totals = {c: F.col(c) + F.coalesce(m + c, F.lit(0)) for c in ("leaves", "saved")}
    return joined.withColumns(totals | columns).select(_STATE)


def peel(state: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(k1, k2, leaves, saved) of every node's subtree, from nodes (``_STATE``) with their own values and the count (open) and
    XOR (x1, x2) of their children; and the tables to release."""
    active, done = materialise(state, "active"), []
    while True:
        ready, waiting = active.where("open = 0"), active.where("open > 0")
        done.append(materialise(ready.select("k1", "k2", "leaves", "saved"), "complete"))
        if waiting.isEmpty():
            release(active)
            return reduce(DataFrame.unionByName, done), done
        sent = ready.groupBy("p1", "p2").agg(F.count("*").alias("n"), F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        branches = waiting.where("open > 1").join(_renamed(sent, "m_"), (F.col("k1") == F.col("m_p1")) & (F.col("k2") == F.col("m_p2")), "left")
        branches = _added(branches, "m_", open=F.col("open") - F.coalesce("m_n", F.lit(0)), **{f"x{i}": F.col(f"x{i}").bitwiseXOR(F.coalesce(f"m_k{i}", F.lit(0))) for i in (1, 2)})
        only_child = (F.col("x1") == F.col("m_k1")) & (F.col("x2") == F.col("m_k2"))
        chains = waiting.where("open = 1").join(_renamed(ready.select("k1", "k2", "leaves", "saved"), "m_"), only_child, "left")
        chains = materialise(_added(chains, "m_", open=F.when(F.col("m_k1").isNotNull(), 0).otherwise(F.col("open"))), "chains")
        still = chains.where("open = 1")
        passed = still.join(_renamed(still.select("k1", "k2", "x1", "x2", "leaves", "saved"), "m_"), only_child, "left")
        passed = _added(passed, "m_", **{f"x{i}": F.coalesce(f"m_x{i}", f"x{i}") for i in (1, 2)})
        after = materialise(branches.unionByName(chains.where("open = 0")).unionByName(passed), "active")
        release(active, chains)
        active = after


def _digests(batches):
    """SHA-256 of each node's pieces, which follow one another in order."""
    key, digest, found = None, None, []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "sha"])

    for b in batches:
        for k1, k2, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if key != (k1, k2):
                if key:
                    found.append((*key, digest.hexdigest()))
                key, digest = (k1, k2), hashlib.sha256(ids.encode())
            else:
                digest.update(("," + ids).encode())
        if found:
            yield out()
            found = []
    if key:
        found.append((*key, digest.hexdigest()))
        yield out()


def end_digests(ends: DataFrame, piece_bits: int = PIECE_BITS) -> DataFrame:
    """(k1, k2, sha) of the ids that end at each node (k1, k2, c), ascending and joined by commas.

    Ids are put together in pieces of bounded size; one task then reads a node's pieces in order, holding one batch.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("k1", "k2", F.shiftright("c", piece_bits).alias("piece")).agg(text.alias("ids"))
    return pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "piece").select("k1", "k2", "ids").mapInArrow(_digests, "k1 long, k2 long, sha string")


def trie(turns: DataFrame, members: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Nodes of the prefix trie of ``turns`` (c, d from 1, r1, r2, bytes, length) of the conversations ``members`` (c, length).

    Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    No members: no rows, not even a root.
    """
    prefixes = materialise(prefix_keys(turns, block_bits), "prefixes")
    grouped = prefixes.groupBy("k1", "k2").agg(F.min("c").alias("conv_id"), F.min("d").alias("depth"), F.count("*").alias("n_convs"), *(F.min(c).alias(c) for c in ("p1", "p2", "bytes")))
    none = F.lit(None).cast("long")
    root = members.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", none.alias("p1"), none.alias("p2"), F.lit(0).alias("bytes"))
    nodes = materialise(grouped.select(F.col("depth").cast("long").alias("depth"), *(c for c in root.columns if c != "depth")).unionByName(root), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("open"), F.bit_xor("k1").alias("x1"), F.bit_xor("k2").alias("x2"))
    state = nodes.join(children, ["k1", "k2"], "left").select("k1", "k2", "p1", "p2", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("open", "x1", "x2")), F.when(F.col("open").isNull(), 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    totals, held = peel(state)
    ends = prefixes.where(F.col("d") == F.col("length")).select("k1", "k2", "c").unionByName(members.where("length = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "c"))
    # every conversation is a member of the root, so a child of the root has the smallest id of all as its parent's
    top = nodes.where("depth = 0").select("conv_id").first()
    parents = nodes.where("depth > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    found = nodes.join(children.select("k1", "k2", "open"), ["k1", "k2"], "left").join(totals, ["k1", "k2"]).join(end_digests(ends), ["k1", "k2"], "left").join(parents, ["p1", "p2"], "left")
    above = F.when(F.col("depth") == 1, F.lit(top.conv_id if top else None).cast("long")).otherwise(F.col("above"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    out = materialise(found.select("conv_id", "depth", above.alias("parent_conv_id"), "n_convs", F.coalesce("open", F.lit(0)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", empty).alias("ends_sha256")), "trie")
    release(prefixes, nodes, *held)
    return out


def conversation_trie(conversations: DataFrame, group: int = 5, heads: int = 9, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The trie of the rebuilt conversations (see ``rebuilt`` and ``trie``).

    Null roles and texts count as empty, null turns come first, ties go by role and text; rows with a null conv_id go; other
    columns are ignored; a table without conversations gives no rows. Equal sequences are one node whatever their number.
    """
    turns, members, held = rebuilt(conversations, group, heads, block_bits)
    out = trie(turns, members, block_bits)
    release(*held)
    return out
