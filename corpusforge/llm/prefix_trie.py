"""Prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations that start
with it, and it is owned by the smallest of them.  Along a conversation the members of a node
only get fewer, so what a conversation owns is a suffix of its path, and (owner, depth) names a
node.  With that every total over a subtree is a sum over the members of its top:

* children: members that own the node one turn deeper,
* leaves: members that own their last node, if nobody continues it,
* saved tokens: what the members hold from this depth on, less what they own of it.

So two groupings by prefix are enough, both summed before the shuffle: one finds the owners,
windows over each path mark what is owned and add it up from the end, and one prefix group-by
sums occurrences, owned tokens and leaf flags.

Distribution: texts stay in the scan, where a turn becomes a digest and a length.  A prefix is
named by its depth and two 64-bit exclusive-ors of hashes of (depth, digest).  A prefix that
very many conversations share (the root, a common first turn) is a hot key only where owners
are joined back to paths; ``join_skewed`` sends those owners to the rows instead.  Windows are
by conversation, which is as long as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_skewed

#: Fixed by contract: a conversation takes its first turns from that at the last multiple of
#: SHARED_BY, as many as the crc32 of its id modulo MOST_SHARED says.
SHARED_BY, MOST_SHARED = 100, 6

_PREFIX = ("depth", "k1", "k2")


def _digest(role: Column, text: Column) -> Column:
    """16 bytes that name a turn; the length of the role keeps role and text apart."""
    return F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary")))


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` to (conv_id, place, digest, size): turns
    numbered from 1, nulls of turn first; turns of equal number by their digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    small = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", _digest(role, text).alias("digest"), F.length(text).cast("long").alias("size"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return small.select("conv_id", F.row_number().over(order).alias("place"), "digest", "size")


def share_first_turns(turns: DataFrame, shared_by: int = SHARED_BY, most: int = MOST_SHARED) -> DataFrame:
    """(conv_id, depth, digest, size) of rebuilt conversations, depth from 1: the first h turns
    of conversation ``c - c % shared_by`` and the own ones after the first h, where h is the crc32
    of the id modulo ``most``.  A conversation left without turns gives a row of depth 0."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("n")).select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % shared_by).alias("base"))
    # At most ``most - 1`` rows a base, and twice ``shared_by`` conversations that ask for them.
    heads = turns.where(F.col("place") < most).where(F.col("conv_id") % shared_by == 0).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "size"))).alias("head"))
    asked = convs.join(heads, "base", "left").withColumn("head", F.expr("slice(coalesce(head, array()), 1, h)")).select("conv_id", "n", "h", "head", F.size("head").alias("taken"))
    first = asked.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.place").alias("depth"), "t.digest", "t.size")
    own = turns.join(asked.select("conv_id", "h", "taken"), "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "digest", "size")
    none = asked.where("taken = 0 and n <= h").select("conv_id", F.lit(0).alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("size"))
    return first.unionByName(own).unionByName(none)


def _paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, size, last): a row a conversation and depth from 0; ``last`` is
    true where the conversation ends."""
    key = lambda salt: F.when(F.col("depth") > 0, F.xxhash64(F.lit(salt), F.col("depth"), F.col("digest"))).otherwise(F.lit(0).cast("long"))
    path = Window.partitionBy("conv_id").orderBy("depth")
    upto = path.rowsBetween(Window.unboundedPreceding, 0)
    placed = turns.select("conv_id", "depth", F.bit_xor(key(1)).over(upto).alias("k1"), F.bit_xor(key(2)).over(upto).alias("k2"), "size", F.lead("depth").over(path).isNull().alias("last"))
    root = F.struct(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("last"))
    row = F.struct(*_PREFIX, "size", "last")
    # The first turn brings the root with it, so every conversation passes it once.
    return placed.select("conv_id", F.explode(F.when(F.col("depth") == 1, F.array(root, row)).otherwise(F.array(row))).alias("r")).select("conv_id", "r.*")


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, depth, ids) to a digest a (conv_id, depth); holds one chunk at a time."""
    now, state = None, None
    for batch in batches:
        convs, depths, digests = [], [], []
        for conv, depth, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            part = ",".join(map(str, ids)).encode()
            if (conv, depth) == now:
                state.update(b"," + part)
                continue
            if now is not None:
                convs.append(now[0]), depths.append(now[1]), digests.append(state.hexdigest())
            now, state = (conv, depth), hashlib.sha256(part)
        yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(depths, pa.int32()), pa.array(digests, pa.string())], names=["conv_id", "depth", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int32()), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "depth", "ends_sha256"])


#: Width of the ranges of ids that are packed into one row on their way to the list's digest.
PACKED = 4096


def _ends(marked: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of nodes where conversations end.

    A digest of a list is serial, so one task sees all ids of a node.  They come in rows of up
    to PACKED ids and are hashed as a stream.
    """
    chunks = marked.where("last").groupBy(F.col("owner").alias("conv_id"), "depth", F.floor(F.col("conv_id") / PACKED).alias("part")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    return chunks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part").select("conv_id", "depth", "ids").mapInArrow(_hash_lists, "conv_id long, depth int, ends_sha256 string")


def trie_of(turns: DataFrame, scope: Scratch) -> DataFrame:
    """``turns(conv_id, depth, digest, size)`` to one row a node: conv_id (owner), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``depth`` counts from 1 without gaps in each conversation; one without turns has one row of
    depth 0.  Sizes are code points of the texts.
    """
    paths = scope.write(_paths(turns), "paths")
    owners = paths.groupBy(*_PREFIX).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.bool_and("last").alias("childless"))
    owners = scope.write(owners, "owners")
    joined = join_skewed(paths, owners.withColumnRenamed("n_convs", "n_rows"), list(_PREFIX))
    path = Window.partitionBy("conv_id").orderBy("depth")
    rest = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    owned = F.col("owner") == F.col("conv_id")
    marked = joined.select(
        "conv_id",
        "depth",
        "owner",
        F.lag("owner").over(path).alias("parent"),
        "last",
        F.coalesce(F.lead(owned).over(path), F.lit(False)).alias("child"),
        F.sum("size").over(rest).alias("held"),
        F.sum(F.when(owned, F.col("size")).otherwise(F.lit(0))).over(rest).alias("owned"),
        F.max(owned & F.col("last") & F.col("childless")).over(rest).alias("leaf"),
    )
    marked = scope.write(marked, "marked")
    nodes = marked.groupBy(F.col("owner").alias("conv_id"), "depth").agg(
        F.min("parent").alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.count_if("child").alias("n_children"),
        F.count_if("leaf").alias("n_leaves"),
        F.sum(F.col("held") - F.col("owned")).alias("saved_tokens"),
    )
    empty = hashlib.sha256(b"").hexdigest()
    return nodes.join(_ends(marked), ["conv_id", "depth"], "left").withColumns({"depth": F.col("depth").cast("long"), "ends_sha256": F.coalesce("ends_sha256", F.lit(empty))})


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt ``conversations(conv_id, turn, role, text)``.

    Edge cases: null roles and texts count as empty; null turns come first, equal ones in the
    order of a digest of role and text; repeated rows are turns like others; rows without
    conv_id belong to no conversation and are left out; an empty table gives no node, not even
    the root; further columns are ignored.  The result reads tables that belong to the caller.
    """
    spark = conversations.sparkSession
    with Scratch(spark) as scope:
        turns = scope.write(turns_of(conversations), "turns")
        return scope.write(trie_of(share_first_turns(turns), scope), "trie", keep=True)
