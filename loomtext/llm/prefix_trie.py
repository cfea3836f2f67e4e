"""Prefix trie of conversations by vertical bitmaps (operator 12).

Conversations are dealt to shards of ``CONVERSATIONS`` ids and ``TURNS`` turns.
A shard indexes (position, turn) to the set of its conversations that have that
turn there, as one bit a conversation.  Depth first, a node's set is cut with
the postings of the next position: what is left is the child, its bits are its
members, and those that go no further are its end list.  Equal nodes of
different shards have equal keys and are added up.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.spark_tools import checkpointed
from loomtext.llm.words import SEPARATOR

CONVERSATIONS = 1024  # ids in a shard: bits in a set
TURNS = 128  # positions in a shard
KEY_BYTES = 16
NODE_TYPE = "key binary, depth int, words bigint, shard bigint, members array<bigint>, ends array<bigint>"


def turn_keys(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, digest, words): turns without their texts.  Equal (role,
    text) have equal digests; null role or text counts as empty."""
    said, who = (F.coalesce(F.col(name), F.lit("")) for name in (text, role))
    digest = F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256)
    words = F.size(F.filter(F.split(said, SEPARATOR), lambda word: word != "")).cast("bigint")
    return conversations.select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.unhex(F.substring(digest, 1, 2 * KEY_BYTES)).alias("digest"), words.alias("words")
    ).where(F.col("conv_id").isNotNull())


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, place, digest, words): turns by number, null first; equal numbers
    by digest.  A conversation passes its task as a sorted stream."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return turns.select("conv_id", (F.row_number().over(order) - 1).alias("place"), "digest", "words")


def _starts(rows: DataFrame) -> DataFrame:
    """(conv_id, block, start, next, more) for the blocks of conversations of
    ``TURNS`` turns or more: keys of the nodes where a block begins and ends.

    They are made of the digests of whole blocks, added by exclusive or with
    their numbers, so no block waits for the one before.
    """
    long = rows.where(F.col("place") >= TURNS - 1).select("conv_id").distinct()
    block = F.floor(F.col("place") / TURNS).alias("block")
    # At most TURNS small rows meet in a list.
    blocks = rows.join(long, "conv_id").groupBy("conv_id", block).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("place", F.hex("digest").alias("digest")))).alias("turns")
    )
    whole = F.sha2(F.concat_ws(",", F.col("block").cast("string"), F.concat_ws("", F.transform("turns", lambda t: t.digest))), 256)
    halves = [F.conv(F.substring(whole, 1 + 15 * k, 15), 16, 10).cast("bigint") for k in range(2)]
    order = Window.partitionBy("conv_id").orderBy("block")
    parts = blocks.select("conv_id", "block", "n", halves[0].alias("x"), halves[1].alias("y"))

    def key(x: Column, y: Column) -> Column:
        return F.unhex(F.substring(F.sha2(F.concat_ws(",", F.lit("block"), x.cast("string"), y.cast("string")), 256), 1, 2 * KEY_BYTES))

    upto = parts.select("conv_id", "block", "n", F.bit_xor("x").over(order).alias("x"), F.bit_xor("y").over(order).alias("y"))
    return upto.select(
        F.col("conv_id").alias("conv_id"), F.col("block").alias("block"), F.lag(key(F.col("x"), F.col("y"))).over(order).alias("start"),
        F.when(F.col("n") == TURNS, key(F.col("x"), F.col("y"))).alias("next"), F.lead("block").over(order).isNotNull().alias("more"),
    )


def _child_key(parent: bytes, digest: bytes) -> bytes:
    return hashlib.sha256(parent + digest).digest()[:KEY_BYTES]


def _shard_nodes(rows: pa.Table, starts: pa.Table) -> pa.Table:
    """The nodes of one shard and block: (conv_id, place, digest, words) rows, a
    place of -1 for the root, and the keys of long conversations."""
    block = rows["block"][0].as_py()
    # Bits in order of id, so the lowest bit is the smallest member.
    ids = sorted(set(rows["conv_id"].to_pylist()))
    bit = {name: 1 << i for i, name in enumerate(ids)}
    known = {row["conv_id"]: row for row in starts.to_pylist()}
    postings: dict[tuple[int, bytes], int] = defaultdict(int)
    turn_at: list[dict[int, bytes]] = [{} for _ in range(TURNS)]  # by position: bit -> turn
    words: dict[bytes, int] = {}
    stops = [0] * (TURNS + 1)  # conversations of that many turns in this block
    length: dict[int, int] = defaultdict(int)
    for name, place, digest, n in zip(*(rows[column].to_pylist() for column in ("conv_id", "place", "digest", "words")), strict=True):
        own = bit[name]
        if place >= 0:
            at = place - block * TURNS
            postings[at, digest] |= own
            turn_at[at][own] = digest
            words[digest] = n
            length[own] += 1
    for name, own in bit.items():
        if name not in known or not known[name]["more"]:
            stops[length[own]] |= own
    roots: dict[bytes, int] = defaultdict(int)
    for name, own in bit.items():
        roots[known[name]["start"] if block else b""] |= own

    def members(bits: int) -> list[int]:
        result = []
        while bits:
            low = bits & -bits
            result.append(ids[low.bit_length() - 1])
            bits ^= low
        return result

    nodes = []
    stack = [(key, 0, bits, 0) for key, bits in roots.items()]
    while stack:
        key, at, bits, n = stack.pop()
        ended = bits & stops[at]
        if at or not block:  # later blocks begin at nodes that the block before has
            nodes.append((key, block * TURNS + at, n, members(bits), members(ended)))
        rest = bits & ~ended if at < TURNS else 0
        while rest:
            low = rest & -rest
            digest = turn_at[at][low]
            child = rest & postings[at, digest]
            rest ^= child
            below = _child_key(key, digest) if at + 1 < TURNS else known[ids[low.bit_length() - 1]]["next"]
            stack.append((below, at + 1, child, words[digest]))
    key, depth, n, inside, ends = zip(*nodes, strict=True) if nodes else ((), (), (), (), ())
    several = pa.list_(pa.int64())
    return pa.table({
        "key": pa.array(key, pa.binary()), "depth": pa.array(depth, pa.int32()), "words": pa.array(n, pa.int64()),
        "shard": pa.array([rows["shard"][0].as_py()] * len(nodes), pa.int64()), "members": pa.array(inside, several), "ends": pa.array(ends, several),
    })


def _end_hashes(local: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes where conversations end.  A SHA-256 takes
    its text in order, so a node's ends pass one task, shard by shard, and none
    is held longer than that."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for own, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = own, hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            yield _hash_rows(done)
        if key is not None:
            yield _hash_rows([(key, state.hexdigest())])

    ends = local.where(F.size("ends") > 0).select("key", "shard", F.concat_ws(",", F.transform("ends", lambda x: x.cast("string"))).alias("ends"))
    streamed = ends.repartition("key").sortWithinPartitions("key", "shard").select("key", "ends")
    return streamed.mapInArrow(hashed, "key binary, ends_sha256 string")


def _hash_rows(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    keys, hashes = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], names=["key", "ends_sha256"])


def trie_nodes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, place, digest, words), places from 0
    without gaps, and of the ids ``conversations``, which may lack turns.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256) of each node; conv_id is the smallest member.

    A node's owner is its smallest member, and each step down keeps or raises
    it.  So what a subtree sums up is the sum, over the node's members, of what
    each of them owns from that depth on: one running sum a conversation and one
    sum a node, however deep the trie is.
    """
    spread = {"shard": F.floor(F.col("conv_id") / CONVERSATIONS), "block": F.floor(F.col("place") / TURNS)}
    rows = checkpointed(turns.select("conv_id", "place", "digest", "words"))
    present = conversations.select("conv_id", F.lit(-1).alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("bigint").alias("words"))
    shards = rows.union(present).withColumns(spread | {"block": F.greatest(spread["block"], F.lit(0))})
    starts = _starts(rows).withColumn("shard", spread["shard"])
    local = shards.groupBy("shard", "block").cogroup(starts.groupBy("shard", "block")).applyInArrow(_shard_nodes, NODE_TYPE)
    local = checkpointed(local)
    nodes = local.groupBy("key").agg(
        F.sum(F.size("members")).cast("bigint").alias("n_convs"), F.min(F.col("members")[0]).alias("owner"),
        F.min("words").alias("words"), F.sum(F.size("ends")).cast("bigint").alias("n_ends"),
    )
    # Every conversation has the root, and one opening may have a third of them.
    # A key of another name gives both sides exchanges of their own, so that
    # adaptive execution can split a hot key.
    apart = F.concat(F.lit(b"n"), "key").alias("node")
    on_path = local.select("key", apart, "depth", F.explode("members").alias("conv_id")).join(nodes.select("*", apart).drop("key"), "node")
    owned = F.col("conv_id") == F.col("owner")
    below = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    from_here = below.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = on_path.select(
        "key", "depth", "conv_id", "owner", "n_convs", owned.alias("owned"),
        F.lead("owner").over(below).alias("above"), F.coalesce(F.lag(owned).over(below), F.lit(False)).alias("child"),
        F.sum(F.when(owned & (F.col("depth") > 0), (F.col("n_convs") - 1) * F.col("words")).otherwise(0)).over(from_here).alias("saved"),
        F.sum(F.when(owned & (F.col("n_ends") == F.col("n_convs")), 1).otherwise(0)).over(from_here).alias("leaves"),
    )
    found = summed.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").cast("bigint").alias("depth"), F.max(F.when(F.col("owned"), F.col("above"))).alias("parent_conv_id"),
        F.min("n_convs").alias("n_convs"), F.count_if("child").alias("n_children"), F.sum("leaves").cast("bigint").alias("n_leaves"),
        F.sum("saved").cast("bigint").alias("saved_tokens"),
    )
    nothing = hashlib.sha256(b"").hexdigest()
    return found.join(_end_hashes(local), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes (``trie_nodes``) of all conversations as they are.

    A null role or text is empty; null turn numbers come first, equal ones in
    the order of a digest of role and text.  Rows with a null id belong to no
    conversation.  Repeated rows are turns of their own.  An empty table has no
    node, not even a root; other columns are not read.
    """
    keys = turn_keys(conversations, conv_id, turn, role, text)
    return trie_nodes(numbered(keys), keys.select("conv_id").distinct())


def spliced(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place, digest, words) and all ids, rebuilt: the first h
    turns of the conversation at the start of its group of ``group`` ids (all, if
    it has fewer), then its own after its first h; h = crc32(id) % ``heads``."""
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    first = F.col("conv_id") - F.pmod("conv_id", F.lit(group))
    ids = turns.select("conv_id").distinct()
    # At most heads - 1 turns of a conversation meet in a list.
    of_base = turns.where((F.col("conv_id") == first) & (F.col("place") < heads - 1)).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("head")
    )
    named = ids.select("conv_id", h.alias("h"), first.alias("base")).join(of_base, "base", "left").select(
        "conv_id", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<place:int,digest:binary,words:bigint>>")), F.lit(1), F.col("h")).alias("head")
    )
    named = checkpointed(named)
    opening = named.select("conv_id", F.inline("head")).select("conv_id", "place", "digest", "words")
    short = named.where(F.size("head") < F.col("h")).select("conv_id", (F.col("h") - F.size("head")).alias("short"))
    own = turns.where(F.col("place") >= h).join(short, "conv_id", "left").select(
        "conv_id", (F.col("place") - F.coalesce("short", F.lit(0))).alias("place"), "digest", "words"
    )
    return opening.union(own), named.select("conv_id")
