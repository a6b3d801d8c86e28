"""Conversation prefix trie: nodes of turn sequences, found by fixed-length block digests and refined where siblings diverge.

A conversation is cut into blocks of ``BLOCK`` turns. A block's digest is chained to that of the blocks before it, so equal digests
are equal prefixes: conversations are grouped by them, some turns at a time. Where all members of a prefix go on with one block,
its turns are nodes as they stand; only blocks with siblings are opened, and their turns grouped again one by one. Turns travel as
digests (128 bits of role and text) and lengths, never as text.

No rounds over depth: a node is owned by its smallest member, a conversation owns the end of its path from some depth on, and a
subtree is the paths of its members. So whatever is summed over a subtree is a sum over members: leaves, of members that
own a childless end; saved tokens, of what members that own nothing there share with others, less what lies above the node.

Defined results: a null role or text is empty; a null conv_id names no conversation and takes no part; rows of one turn follow by
role, then digest; repeated rows are turns of their own; an empty table has no node, the root included; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, written

#: Turns of a block.
BLOCK = 4
#: Key of the textless root, and of the hash of no members.
ROOT = b"\x00" * 16
NO_ENDS = hashlib.sha256().hexdigest()
#: The contract's rule for shared heads: hundreds of conversations, and the first (hash mod SPREAD) turns of their first one.
HUNDRED, SPREAD = 100, 6

BLOCKS = "conv_id long, depth long, parent binary, node binary, digests binary, points array<long>, above long, ends boolean"
_BLOCKS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent", pa.binary()), ("node", pa.binary()), ("digests", pa.binary()),
                     ("points", pa.list_(pa.int64())), ("above", pa.int64()), ("ends", pa.bool_())])
OUT = 4096


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest (of role and text), points (code points of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"), F.length(text).cast("long").alias("points"))


def blocks(rows: DataFrame, family: Column | None = None, shared: Column | None = None) -> DataFrame:
    """The blocks of every conversation of ``turns``: ``BLOCKS``.

    With ``family`` (the conv_id whose first turns are shared, or the own one) and ``shared`` (how many), a conversation's first
    ``shared`` turns are those of the head of its family, and its own follow after its first ``shared``. A conversation without
    turns has one empty block at the root. Every family is one stream, the head first; a few turns of it are held.
    """
    family = F.col("conv_id") if family is None else family
    shared = F.lit(0) if shared is None else shared
    rows = rows.select(family.alias("family"), "conv_id", shared.cast("int").alias("shared"), "turn", "role", "digest", "points")
    rows = rows.repartition("family").withColumn("tail", F.col("conv_id") != F.col("family"))
    rows = rows.sortWithinPartitions("family", "tail", "conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
    return rows.select("family", "conv_id", "shared", "digest", "points").mapInArrow(_cut, BLOCKS)


def _cut(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    family = conv = None
    head: list[tuple[bytes, int]] = []  # the first turns of the family's head
    own = depth = above = 0
    parent, held = ROOT, []

    def put(ends: bool) -> None:
        nonlocal parent, depth, above, held
        digests = b"".join(d for d, _ in held)
        node = hashlib.md5(parent + digests, usedforsecurity=False).digest() if held else ROOT
        out.append((conv, depth, parent, node, digests, [p for _, p in held], above, ends))
        parent, depth, above, held = node, depth + len(held), above + sum(p for _, p in held), []

    def take(turn: tuple[bytes, int]) -> None:
        if len(held) == BLOCK:
            put(False)
        held.append(turn)

    for batch in part:
        for f, c, shared, digest, points in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            if conv is None or c != conv or f != family:
                if conv is not None:
                    put(True)
                if f != family:
                    family, head = f, []
                conv, own, depth, above, parent, held = c, 0, 0, 0, ROOT, []
                if shared > SPREAD:
                    raise ValueError(f"{shared} shared turns, {SPREAD} at most are held")
                if c != f:
                    for turn in head[:shared]:
                        take(turn)
            if c == f and len(head) < SPREAD:
                head.append((digest, points))
            if c == f or own >= shared:
                take((digest, points))
            own += 1
            if len(out) >= OUT:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), _BLOCKS, strict=True)], schema=_BLOCKS)
                out.clear()
    if conv is not None:
        put(True)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), _BLOCKS, strict=True)], schema=_BLOCKS)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """The blocks of the conversations rebuilt with heads shared by hundreds."""
    conv = F.col("conv_id")
    return blocks(turns(conversations), conv - conv % HUNDRED, F.crc32(conv.cast("string")) % SPREAD)


def _opened(found: DataFrame) -> DataFrame:
    """(block, key, before, j) of every turn of the distinct blocks ``found``: its node's key, that of the node before, its number from 1."""
    key = lambda j: F.when(j == 0, F.col("parent")).otherwise(F.unhex(F.md5(F.concat("parent", F.substring("digests", F.lit(1), 16 * j)))))
    j = F.col("j")
    return found.withColumn("j", F.explode(F.sequence(F.lit(1), F.size("points")))).select("*", key(j).alias("key"), key(j - 1).alias("before"))


def prefix_trie(parts: DataFrame) -> DataFrame:
    """Every node of the conversations whose ``blocks`` these are: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    parts = written(parts, "blocks")
    total = parts.where("depth = 0").agg(F.count(F.lit(1)), F.min("conv_id")).first()
    if not total[0]:
        return parts.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    # distinct blocks: equal digests are equal prefixes
    found = written(parts.where("size(points) > 0").groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("conv_id", F.col("ends").alias("ends"))).alias("owner"), F.first("parent").alias("parent"),
        F.first("digests").alias("digests"), F.first("points").alias("points"), F.first("depth").alias("depth"), F.first("above").alias("above")), "distinct")
    siblings = written(found.groupBy("parent").agg(F.count(F.lit(1)).alias("siblings")), "siblings")
    found = written(attach(found, siblings, "parent", "siblings", found.count()), "families")
    opened = _opened(found).select(
        "node", "siblings", "key", "before", F.col("n"), (F.col("depth") + F.col("j")).alias("depth"), F.element_at("points", F.col("j")).alias("last"),
        # code points above the turn's own
        (F.col("above") + F.aggregate(F.slice("points", F.lit(1), F.col("j") - 1), F.lit(0).cast("long"), lambda a, x: a + x)).alias("above"),
        F.struct(F.col("owner.conv_id").alias("conv_id"), (~(F.col("owner.ends") & (F.col("j") == F.size("points")))).alias("goes_on")).alias("owner"))
    lone = opened.where("siblings = 1").select("key", "before", "n", "depth", "above", "owner")
    split = opened.where("siblings > 1").groupBy("key").agg(
        F.first("before").alias("before"), F.sum("n").alias("n"), F.first("depth").alias("depth"), F.first("above").alias("above"), F.min("owner").alias("owner"))
    nodes = lone.unionByName(split.select(lone.columns)).select("key", "before", "n", "depth", "above", F.col("owner.conv_id").alias("conv_id"), F.col("owner.goes_on").alias("goes_on"))
    nodes = written(nodes, "nodes")
    # where each conversation branches off, i.e. the first node it owns, and how many do at a node
    branch = written(nodes.where(F.col("conv_id") != total[1]).groupBy("conv_id").agg(F.min(F.struct("depth", "key", "before", "above")).alias("b")).select("conv_id", "b.*"), "branches")
    offs = branch.groupBy(F.col("before").alias("key")).agg(F.count(F.lit(1)).alias("offs"))
    first = parts.where("depth = 0 and conv_id = %d" % total[1]).select((F.size("points") > 0).alias("goes_on"))
    root = first.select(F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("before"), F.lit(total[0]).cast("long").alias("n"), F.lit(0).cast("long").alias("depth"),
                        F.lit(0).cast("long").alias("above"), F.lit(total[1]).cast("long").alias("conv_id"), "goes_on")
    nodes = written(nodes.unionByName(root).join(offs, "key", "left").withColumn("offs", F.coalesce("offs", F.lit(0)))
                    .withColumn("n_children", F.col("offs") + F.col("goes_on").cast("long")), "children")
    # a branch hangs on its parent's owner; a node many branch from is hot
    hung = attach(branch.select("key", "before"), nodes.where("offs > 0").select(F.col("key").alias("before"), F.col("conv_id").alias("parent_conv"), "offs"), "before", "offs", total[0])
    # what each member adds to the sums of every node on its path
    ends = parts.where("ends").select("conv_id", "node", (F.col("above") + F.aggregate("points", F.lit(0).cast("long"), lambda a, x: a + x)).alias("whole"))
    leaf = nodes.where("n_children = 0").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    adds = written(ends.join(branch.select("conv_id", "above"), "conv_id", "left").join(leaf, "conv_id", "left").select(
        "conv_id", F.when(F.col("conv_id") == total[1], F.lit(0)).otherwise(F.coalesce("above", "whole")).alias("above"),
        F.coalesce("leaf", F.lit(0)).alias("leaf")), "adds")
    several = parts.where("size(points) > 0").select("conv_id", "node").join(found.where("n > 1").select(F.col("node"), "n"), "node").select("conv_id", "node")
    several = written(several, "shared")
    held = several.groupBy("conv_id").agg(F.count(F.lit(1)).alias("blocks"))
    share = attach(several, written(adds.join(held, "conv_id"), "adds-of-shared"), "conv_id", "blocks", several.count())
    per_block = share.groupBy("node").agg(F.sum("above").alias("above"), F.sum("leaf").alias("leaf"), F.min(F.struct("conv_id", F.col("above"))).alias("owner"))
    alone = found.where("n = 1 and siblings > 1").select("node", F.col("owner.conv_id").alias("conv_id")).join(adds, "conv_id").select(
        "node", "above", "leaf", F.struct("conv_id", "above").alias("owner"))
    sums = _opened(found.where("n > 1 or siblings > 1")).select("node", "key").join(per_block.unionByName(alone), "node").groupBy("key").agg(
        F.sum("above").alias("sum_above"), F.sum("leaf").alias("n_leaves"), F.min("owner").alias("owner"))
    top = adds.agg(F.sum("above").alias("sum_above"), F.sum("leaf").alias("n_leaves")).select(
        F.lit(ROOT).alias("key"), "sum_above", "n_leaves", F.struct(F.lit(total[1]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("above")).alias("owner"))
    sums = sums.unionByName(top).select("key", (F.col("sum_above") - F.col("owner.above")).alias("others"), "n_leaves")
    out = (nodes.join(sums, "key", "left").join(hung.select("key", "parent_conv"), "key", "left").join(_ended(ends), "key", "left"))
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv", "conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.when(F.col("n") > 1, F.col("others") - (F.col("n") - 1) * F.col("above")).otherwise(F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def _ended(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): the digest of the conv_ids that end at a node, one sorted stream per node."""
    rows = ends.select(F.col("node").alias("key"), "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    return rows.mapInArrow(_hash_ids, "key binary, ends_sha256 string")


def _hash_ids(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, out, now, sha = ["key", "ends_sha256"], [], None, None
    for batch in part:
        for key, conv in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            if key != now:
                if sha is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(str(conv).encode())
            else:
                sha.update(f",{conv}".encode())
        if len(out) >= OUT:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], names)
            out = []
    if sha is not None:
        out.append((now, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], names)
