"""Prefix trie of rebuilt conversations, merged family first.

A family is the conversations with one base id.  Turns are dealt by base id and stream through a
task family by family, the base conversation first: its first turns open the other members'
rebuilt conversations, so base and members are cogrouped without being held.  A node
is named by the chained digest of its turns.  Each family's small trie is built in the task,
and only its combined nodes (digest, parent, depth, members, ...) are shuffled and merged
globally; texts never are, as turns go by their digests.

Sums over subtrees need distinct nodes, so they come after the merge: by pointer doubling, each
round adds the sums of nodes 1, 2, 4, ... turns below, so long conversations take logarithmically
many rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, staged

#: A family's nodes are passed on when there are so many; the rest of the family follows as further partial nodes.
MOST_HELD = 20_000
#: Conversation ids that end at a node are gathered by ranges of so many ids.
RANGE = 256

_ROOT = hashlib.blake2b(b"root", digest_size=16).digest()
_NODES = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("bytes", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("ends", pa.list_(pa.int64()))])


def prefix_length(conv_id: Column, modulus: int = 9) -> Column:
    """How many turns a rebuilt conversation takes from its base: crc32 of the decimal id, modulo ``modulus``."""
    return F.crc32(conv_id.cast("string").cast("binary")) % modulus


def turns(conversations: DataFrame, *, family: int = 5) -> DataFrame:
    """(base, conv_id, h, turn, role, digest, bytes) of the turns; rows without conv_id belong to no conversation.

    The digest is of role and text (null: empty) with the role's length before it; bytes are the text's.
    """
    own = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    conv = F.col("conv_id")
    return own.select((conv - conv % family).alias("base"), "conv_id", prefix_length(conv).alias("h"), "turn", "role", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


def family_nodes(batches: Batches) -> Batches:
    """Combined nodes of families whose turns come in order: by base, the base conversation first, by conversation, by turn."""
    held: dict[bytes, list] = {}

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            rows = [(k, *v) for k, v in held.items()]
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _NODES)], schema=_NODES)

    def visit(node: bytes, parent: bytes | None, depth: int, size: int, conv: int) -> None:
        v = held.get(node)
        if v is None:
            held[node] = [parent, depth, size, conv, 1, []]
        else:
            v[2] = size
            v[3] = min(v[3], conv)
            v[4] += 1

    base = conv = None
    opening: list[tuple[bytes, int]] = []  # the base's first turns; h never asks for more than 8
    node, depth, nth, h = _ROOT, 0, 0, 0

    def step(digest: bytes, size: int) -> None:
        nonlocal node, depth
        parent, node, depth = node, hashlib.blake2b(node + digest, digest_size=16).digest(), depth + 1
        visit(node, parent, depth, size, conv)

    def end() -> None:
        if conv is not None:
            held[node][5].append(conv)

    for b in batches:
        for own_base, own, own_h, digest, size in zip(*(b[c].to_pylist() for c in ("base", "conv_id", "h", "digest", "bytes"))):
            if own != conv:
                end()
                conv = None
                if own_base != base:
                    base, opening = own_base, []
                if len(held) >= MOST_HELD:
                    yield from out()
                conv, node, depth, nth, h = own, _ROOT, 0, 0, own_h
                visit(_ROOT, None, 0, 0, conv)
                if own != base:
                    for d, s in opening[:h]:
                        step(d, s)
            nth += 1
            if own == base:
                if len(opening) < 8:
                    opening.append((digest, size))
                step(digest, size)
            elif nth > h:
                step(digest, size)
            if len(held) >= 2 * MOST_HELD:  # inside a very long conversation: its last node stays, to be its end
                last = held.pop(node)
                yield from out()
                held[node] = last
    end()
    yield from out()


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``nodes`` (node, parent, depth, and ``values``), each value summed over the node's subtree.

    Round k adds the sums of the nodes 2**k turns below; every round is a pre-aggregated sum and joins by a key that
    is unique on one side, staged in the shared folder.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    at = nodes.select("node", F.col("parent").alias("up"), *values)
    reach = 1
    while reach <= deepest:
        below = at.where("up IS NOT NULL").groupBy("up").agg(*(F.sum(v).alias(f"_{v}") for v in values)).withColumnRenamed("up", "_up")
        added = at.join(below, F.col("node") == F.col("_up"), "left").select("node", "up", *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values))
        if 2 * reach <= deepest:
            above = at.where("up IS NOT NULL").select(F.col("node").alias("_node"), F.col("up").alias("_above"))
            added = added.join(above, F.col("up") == F.col("_node"), "left").select("node", F.col("_above").alias("up"), *values)
        at = staged(added, "sums")
        reach *= 2
    return at.select("node", *values)


def end_digests(nodes: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes at which conversations end: SHA-256 of the ids, ascending, comma-joined.

    Ids are gathered by (node, range of ids), which bounds a group; a node's ranges then stream in order through the
    hash, which keeps no more than one of them.
    """
    ends = nodes.where(F.size("ends") > 0).select("node", F.explode("ends").alias("id"))
    ranged = ends.groupBy("node", F.floor(F.col("id") / F.lit(RANGE)).alias("range")).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))

    def run(batches: Batches) -> Batches:
        node, h = None, None
        for b in batches:
            done: list[tuple[bytes, str]] = []
            for own, ids in zip(b["node"].to_pylist(), b["ids"].to_pylist()):
                if own != node:
                    if node is not None:
                        done.append((node, h.hexdigest()))
                    node, h = own, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()], pa.string())], ["node", "ends_sha256"])

    return ranged.repartition("node").sortWithinPartitions("node", "range").select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, *, family: int = 5) -> DataFrame:
    """The trie of all rebuilt ``conversations`` (conv_id, turn, role, text), one row per node.

    Conversation c is rebuilt from the first h turns of conversation c - c % ``family`` and its own
    turns after its first h (h = crc32 of its id, % 9).  Turns are in order of turn, null first; equal ones by
    role, then by the digest of role and text; repeated rows are turns of their own.  Null role or text is empty, and rows without
    conv_id are left out.  An empty table has no node; otherwise the root has every conversation, with turns or not.

    Returns node (digest) and parent (null for the root), conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.  A family is one task's work, as a stream: what is held is
    its base's first eight turns and at most ``MOST_HELD`` or so of its nodes, however long its conversations.
    """
    dealt = turns(conversations, family=family).repartition("base")
    ordered = dealt.sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "role", "digest").select("base", "conv_id", "h", "digest", "bytes")
    parts = staged(ordered.mapInArrow(family_nodes, "node binary, parent binary, depth long, bytes long, conv_id long, n_convs long, ends array<long>"), "family-nodes")
    merged = parts.groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("bytes").alias("bytes"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    merged = staged(merged, "nodes")
    children = merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("_parent")).agg(F.count("*").alias("n_children"))
    known = merged.join(children, F.col("node") == F.col("_parent"), "left").drop("_parent").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = known.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes"))
    known = staged(known, "trie")
    sums = subtree_sums(known, ["n_leaves", "saved_tokens"])
    ends = end_digests(parts)
    above = known.select(F.col("node").alias("_above"), F.col("conv_id").alias("parent_conv_id"))
    out = known.drop("n_leaves", "saved_tokens", "bytes").join(sums, "node").join(ends, "node", "left").join(above, F.col("parent") == F.col("_above"), "left")
    nothing = F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256")
    return out.select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", nothing)
