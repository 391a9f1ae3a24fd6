"""Operator 12: the trie of conversation prefixes, with subtree totals by parallel tree contraction.

Turns are numbered within their conversation, and a prefix is known by its
length and 128 bits: two exclusive ors of 64-bit hashes of its turns, each with
its place.  So a prefix needs no walk along its conversation: slices of a long
one are added up side by side, and a turn knows its parent's key from its own.
Counting turns by key makes the nodes.

Totals of subtrees come from contraction.  Rounds alternate between rake, in
which all leaves hand their sums to their parents, and compress, in which every
node with a single child that beats both its neighbours leaves a chain: its
parent takes over its sums and its child.  Neighbours compare a binary digit of
their depths first, another digit in each round, so a plain chain halves.  A
node carries the number of its children and the exclusive or of their keys:
with one child left, that is the child's key, and no node ever lists its
children.  At the end the nodes that left come back in the opposite order: a
raked one has its total, and a compressed one adds the total of the child that
it had when it left.  Rounds grow with the logarithm of the nodes; each is a
join by unique keys, and messages to one parent are added up before they move.

Defined results: rows without a conversation id are left out; turns with equal
numbers stand in the order of a hash of role and text, so reruns agree; equal
turns count as often as they stand there; other columns are not read; without
rows there are no conversations and no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_facts, numbered, stored, table

#: A conversation takes up to HEADS - 1 first turns from the first one of its FAMILY.
HEADS, FAMILY = 6, 100

#: What tells a node: the length of its prefix and two hashes.
KEY = ["depth", "p1", "p2"]
UP, KID = [f"up_{k}" for k in KEY], [f"kid_{k}" for k in KEY]
_SLICE = ["conv_id", "_part"]
#: Turns of a conversation that are hashed together.
PART = 100_000


def _heads(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("long")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, depth, t1, t2, before1, before2, n_chars) and all conversations (conv_id, n_turns).

    t1 and t2 are hashes of the turn and its place, before1 and before2 those of all turns before it.
    Texts are hashed where they are read and don't move.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), role, text).alias("h2"), F.char_length(text).cast("long").alias("n_chars"))
    turns = stored(numbered(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2")], "place").withColumn("_part", F.expr(f"(place - 1) div {PART}")))

    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n_own")).withColumn("base", F.expr(f"conv_id - conv_id % {FAMILY}")).withColumn("h", _heads(F.col("conv_id")))
    sizes = stored(sizes)
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = sizes.join(sizes.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base")), "base", "left")
    convs = stored(convs.select("conv_id", "base", "h", taken.alias("n_taken"), (taken + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns")))

    def hashed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("t1", F.xxhash64("depth", "h1")).withColumn("t2", F.xxhash64("depth", "h2", "h1"))

    def so_far(rows: DataFrame, by: list[str]) -> DataFrame:
        earlier = Window.partitionBy(*by).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({f"before{i}": F.coalesce(F.bit_xor(f"t{i}").over(earlier), F.lit(0)) for i in (1, 2)})

    # The first turns of each family, a few rows each.
    first = turns.where(f"place < {HEADS} AND conv_id % {FAMILY} = 0").withColumn("depth", F.col("place"))
    first = stored(so_far(hashed(first), ["conv_id"]).select(F.col("conv_id").alias("base"), "depth", "t1", "t2", "before1", "before2", "n_chars"))
    borrowed = convs.join(first, "base").where("depth <= n_taken").select("conv_id", "depth", "t1", "t2", "before1", "before2", "n_chars")

    # Own turns by parts of a conversation: facts of a part come by its key, and sums of the parts before it are added.
    slices = turns.select(*_SLICE).distinct().join(convs.select("conv_id", "h", "n_taken"), "conv_id")
    own = turns.join(slices, _SLICE).where("place > h").withColumn("depth", F.col("place") - F.col("h") + F.col("n_taken"))
    own = stored(hashed(own).select(*_SLICE, "depth", "t1", "t2", "n_chars"))
    whole = borrowed.groupBy("conv_id").agg(F.bit_xor("t1").alias("b1"), F.bit_xor("t2").alias("b2"))
    sums = own.groupBy(*_SLICE).agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2")).join(whole, "conv_id", "left")
    parts = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*_SLICE, *(F.coalesce(f"b{i}", F.lit(0)).bitwiseXOR(F.coalesce(F.bit_xor(f"s{i}").over(parts), F.lit(0))).alias(f"earlier{i}") for i in (1, 2)))
    own = so_far(own, _SLICE).join(sums, _SLICE).withColumns({f"before{i}": F.col(f"before{i}").bitwiseXOR(F.col(f"earlier{i}")) for i in (1, 2)})
    return borrowed.unionByName(own.select(*borrowed.columns)), convs.select("conv_id", "n_turns")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and id -> (node, first id, ids joined by commas), some thousand ids each."""
    for batch in batches:
        *keys, ids = (c.to_pylist() for c in batch.columns)
        nodes = list(zip(*keys))
        cuts = [i for i in range(len(ids)) if i == 0 or nodes[i] != nodes[i - 1]]
        rows = [(*nodes[i], ids[i], ",".join(map(str, ids[i:j]))) for i, j in zip(cuts, [*cuts[1:], len(ids)])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], [*KEY, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and first id -> (node, SHA-256 of all its pieces); one piece is in memory at a time."""
    node = state = None
    for batch in batches:
        done = []
        for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if key != node:
                if state:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], [*KEY, "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*node, state.hexdigest())], [*KEY, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256): the digest of the ids (conv_id) that end at each node.

    Ids are range-sorted, so a node at which many end is joined by many tasks.  A
    SHA-256 can't be put together from parts: its joined pieces, a row for
    thousands of ids, pass one task as a stream.
    """
    node = "depth long, p1 long, p2 long"
    pieces = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_ends, f"{node}, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, f"{node}, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """(depth, p1, p2, up_depth, up_p1, up_p2, conv_id, n_convs, n_children, parent_conv_id, own_saved, ends_sha256): a row for each node."""
    turns, convs = rebuilt_turns(conversations)
    p1, p2 = (F.col(f"before{i}").bitwiseXOR(F.col(f"t{i}")) for i in (1, 2))
    members = stored(turns.select("conv_id", "depth", p1.alias("p1"), p2.alias("p2"), "before1", "before2", "n_chars"))
    zero = F.lit(0).cast("long")
    parent = [F.any_value(c).alias(u) for c, u in zip((F.col("depth") - 1, F.col("before1"), F.col("before2")), UP)]
    nodes = members.groupBy(*KEY).agg(*parent, F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.any_value("n_chars").alias("n_chars"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*(zero.alias(k) for k in KEY), *(F.lit(None).cast("long").alias(u) for u in UP), "conv_id", "n_convs", zero.alias("n_chars"))
    nodes = nodes.unionByName(root).withColumn("own_saved", (F.col("n_convs") - 1) * F.col("n_chars")).drop("n_chars")

    turnless = convs.where("n_turns = 0").select("conv_id", *(zero.alias(k) for k in KEY))
    last = members.join(convs.select("conv_id", F.col("n_turns").alias("depth")), ["conv_id", "depth"], "left_semi")
    digests = end_digests(last.select("conv_id", *KEY).unionByName(turnless))
    nodes = stored(nodes.join(digests, KEY, "left").fillna({"ends_sha256": hashlib.sha256(b"").hexdigest()}))

    below = nodes.where("depth > 0").groupBy(*UP).agg(F.count("*").alias("n_children"), *(F.bit_xor(k).alias(x) for k, x in zip(KEY, KID)))
    below = below.withColumnsRenamed(dict(zip(UP, KEY)))
    nodes = stored(nodes.join(below, KEY, "left").fillna(0, ["n_children", *KID]))
    # Children of one node may be many: the rows of such a parent stay where they are.
    facts = nodes.where("n_children > 0").select(*(F.col(k).alias(u) for k, u in zip(KEY, UP)), F.col("n_children").alias("n"), F.col("conv_id").alias("parent_conv_id"))
    named = join_facts(nodes.where("depth > 0"), facts, UP).drop("n")
    return named.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))


def _beats(one: list[Column], other: list[Column], step: int) -> Column:
    """Whether a node goes before another in a round: by a digit of the depth, then by hash, then by key."""
    order = lambda key: F.struct(F.shiftright(key[0], step % 40).bitwiseAND(F.lit(1)), F.xxhash64(F.lit(step), *key), *key)
    return order(one) > order(other)


def _told(live: DataFrame, messages: DataFrame, sums: list[str]) -> DataFrame:
    """Nodes after messages (to a node: what to add, what to put into or take from its children, a new parent)."""
    to = messages.groupBy(*(F.col(f"to_{k}").alias(k) for k in KEY)).agg(
        *(F.sum(s).alias(f"m_{s}") for s in sums), F.sum("n_kids").alias("m_kids"), *(F.bit_xor(k).alias(f"m_{k}") for k in KID), *(F.max(u).alias(f"m_{u}") for u in UP)
    )
    old = lambda c: F.coalesce(F.col(c), F.lit(0))
    return live.join(to, KEY, "left").select(
        *KEY, *(F.coalesce(f"m_{u}", u).alias(u) for u in UP), (F.col("n_kids") + old("m_kids")).alias("n_kids"),
        *(F.col(k).bitwiseXOR(old(f"m_{k}")).alias(k) for k in KID), *((F.col(s) + old(f"m_{s}")).alias(s) for s in sums),
    )


def subtree_sums(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """(depth, p1, p2 and the sums): each column summed over the subtree of every node.

    nodes needs the keys of a node, of its parent (null at the root) and the
    exclusive or of its children's, their number n_kids, and the columns, never null.
    """
    live, rounds, step = stored(nodes.select(*KEY, *UP, "n_kids", *KID, *sums)), [], 0
    not_root = F.col("up_depth").isNotNull()
    none = [F.lit(None).cast("long").alias(u) for u in UP]
    key, up, kid = ([F.col(c) for c in cs] for cs in (KEY, UP, KID))
    while live.where(not_root).limit(1).count():
        leaf = (F.col("n_kids") == 0) & not_root
        raked = live.where(leaf).select(*KEY, *sums)
        messages = live.where(leaf).select(*(F.col(u).alias(f"to_{k}") for k, u in zip(KEY, UP)), *sums, F.lit(-1).cast("long").alias("n_kids"), *(F.col(k).alias(x) for k, x in zip(KEY, KID)), *none)
        live = stored(_told(live.where(~leaf), messages, sums))

        leaves = not_root & (F.col("n_kids") == 1) & _beats(key, up, step) & _beats(key, kid, step)
        compressed = live.where(leaves).select(*KEY, *KID, *sums)
        to_parent = live.where(leaves).select(*(F.col(u).alias(f"to_{k}") for k, u in zip(KEY, UP)), *sums, F.lit(0).cast("long").alias("n_kids"), *(F.col(k).bitwiseXOR(F.col(x)).alias(x) for k, x in zip(KEY, KID)), *none)
        nothing = [F.lit(0).cast("long").alias(c) for c in (*sums, "n_kids", *KID)]
        to_child = live.where(leaves).select(*(F.col(x).alias(f"to_{k}") for k, x in zip(KEY, KID)), *nothing, *UP)
        live = stored(_told(live.where(~leaves), to_parent.unionByName(to_child), sums))
        rounds.append((raked, compressed))
        step += 1

    # Nodes come back last out, first in; a compressed one asks only those that left after it.
    totals = live.select(*KEY, *sums)
    for raked, compressed in reversed(rounds):
        theirs = totals.select(*(F.col(k).alias(x) for k, x in zip(KEY, KID)), *(F.col(s).alias(f"kid_{s}") for s in sums))
        back = compressed.join(theirs, KID).select(*KEY, *((F.col(s) + F.col(f"kid_{s}")).alias(s) for s in sums))
        totals = stored(totals.unionByName(back).unionByName(raked))
    return totals


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node of the trie.

    conversations needs conv_id, turn, role and text.
    """
    nodes = stored(trie(conversations))
    own = nodes.withColumn("n_kids", F.col("n_children")).withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", F.col("own_saved"))
    totals = subtree_sums(own, ["n_leaves", "saved_tokens"])
    return nodes.join(totals, KEY).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
