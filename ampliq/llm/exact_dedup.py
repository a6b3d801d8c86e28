"""Exact duplicates by a minimal perfect hash over historical distinct digests.

The history's distinct digests are dealt over shards; each shard holds a minimal perfect hash (levels of bit arrays: a
digest lives in the first level where it alone hits its bit; its rank among set bits is its slot) and, by slot, the full
digest and the locator of its winner. A row looks up its slot and compares all bytes, so a stranger that lands on a
slot is found out. Rows that are no members are grouped among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, partitions, text_or_empty, written

#: The white space that normalisation deletes: blank and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: Digests of a shard: a shard's slots stay near 4 MB.
SHARD_DIGESTS = 65_536
#: Bits per remaining digest on each level.
GAMMA = 2.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_points): SHA-256 of the text without white space, and the original's code points."""
    text = text_or_empty(text_col)
    bare = text
    for c in BLANKS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(bare.cast("binary"), 256).alias("digest"),
                       F.char_length(text).cast("long").alias("n_points"))


def winners(rows: DataFrame) -> DataFrame:
    """Per digest the row that stays (most code points, then smallest doc_id) and the group's size; a partial aggregate, so no group meets in one task."""
    best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("neg")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", (-F.col("best.neg")).alias("keep_id"), F.col("best.n_points").alias("keep_points"), "group_size")


def _shard(n: int):
    return F.pmod(F.conv(F.substring("digest", 1, 12), 16, 10).cast("long"), F.lit(n)).cast("int")


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of two digest words for a level."""
    with np.errstate(over="ignore"):
        x = keys[:, 0] ^ (keys[:, 1] + np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & (2**64 - 1)))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def build_levels(digests: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of the minimal perfect hash of distinct digests, given as rows of four 64-bit words."""
    levels, left = [], digests
    while len(left):
        size = max(8, int(len(left) * GAMMA))
        at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at]]
    return levels


def slots_of(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """Slot of each digest: members get their own; others get any slot or -1."""
    out = np.full(len(digests), -1, np.int64)
    open_, before = np.arange(len(digests)), 0
    for k, bits in enumerate(levels):
        if not len(open_):
            break
        at = (_mix(digests[open_], k) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at]
        out[open_[hit]] = before + np.cumsum(bits)[at[hit]] - 1
        before += int(bits.sum())
        open_ = open_[~hit]
    return out


def _words(hexes: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(hexes)), ">u8").astype(np.uint64).reshape(-1, 4)


INDEX = "shard int, sizes binary, bits binary, digests binary, keep_id array<long>, keep_points array<long>, group_size array<long>"


def _index_shard(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One index row per shard from rows sorted by shard; a shard is bounded by SHARD_DIGESTS on average."""
    held: dict[str, list] = {}
    now = None

    def row():
        digests = _words(held["digest"])
        levels = build_levels(digests)
        order = np.argsort(slots_of(levels, digests))
        pick = lambda c: [[held[c][i] for i in order]]
        return pa.RecordBatch.from_arrays([
            pa.array([now], pa.int32()), pa.array([np.array([len(b) for b in levels], np.int64).tobytes()]),
            pa.array([np.packbits(np.concatenate(levels)).tobytes()]), pa.array([digests[order].tobytes()]),
            pa.array(pick("keep_id"), pa.list_(pa.int64())), pa.array(pick("keep_points"), pa.list_(pa.int64())), pa.array(pick("group_size"), pa.list_(pa.int64()))],
            names=["shard", "sizes", "bits", "digests", "keep_id", "keep_points", "group_size"])

    for batch in part:
        cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        for i, s in enumerate(cols["shard"]):
            if s != now:
                if now is not None:
                    yield row()
                now, held = s, {c: [] for c in ("digest", "keep_id", "keep_points", "group_size")}
            for c in held:
                held[c].append(cols[c][i])
    if now is not None:
        yield row()


def build_index(history: DataFrame) -> DataFrame:
    """The index over ``history`` (digest, keep_id, keep_points, group_size; distinct digests), written: one row per shard."""
    spark = history.sparkSession
    shards = max(8 * partitions(spark), -(-history.count() // SHARD_DIGESTS), 1)
    rows = history.withColumn("shard", _shard(shards)).repartition(partitions(spark), "shard").sortWithinPartitions("shard")
    return written(rows.mapInArrow(_index_shard, INDEX), "mph").withColumn("shards", F.lit(shards))


def _look_up(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams (shard, salt) groups in which the index row comes first; memory holds one shard and one batch."""
    names = ["doc_id", "digest", "n_points", "member", "keep_id", "keep_points", "group_size"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
    shard = levels = slots = None
    for batch in part:
        key = batch.column("shard").to_numpy()
        is_row = batch.column("is_row").to_numpy(zero_copy_only=False).astype(bool)
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (is_row[1:] != is_row[:-1]), True])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if not is_row[lo]:
                entry = batch.slice(lo, 1).to_pylist()[0]
                sizes = np.frombuffer(entry["sizes"], np.int64)
                bits = np.unpackbits(np.frombuffer(entry["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
                shard, levels = entry["shard"], np.split(bits, np.cumsum(sizes)[:-1])
                slots = (np.frombuffer(entry["digests"], np.uint64).reshape(-1, 4), entry["i_keep_id"], entry["i_keep_points"], entry["i_group_size"])
                continue
            rows = batch.slice(lo, hi - lo)
            found = [None] * (hi - lo)
            if shard == key[lo]:
                words = _words(rows.column("digest").to_pylist())
                at = slots_of(levels, words)
                same = (at >= 0) & (slots[0][np.maximum(at, 0)] == words).all(axis=1)  # every byte is compared
                found = [int(a) if ok else None for a, ok in zip(at, same, strict=True)]
            pick = lambda k: [None if a is None else slots[k][a] for a in found]  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("digest"), rows.column("n_points"), pa.array([a is not None for a in found], pa.bool_()),
                                              *(pa.array(pick(k), pa.int64()) for k in (1, 2, 3))], schema=pa.schema(list(zip(names, types, strict=True))))


def look_up(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``rows`` (doc_id, digest, n_points) with member and the winner found. Shards that many rows ask for are read by several tasks."""
    spark = rows.sparkSession
    first = index.select("shards").first()
    shards = first[0] if first else 1
    keyed = rows.withColumn("shard", _shard(shards))
    asked = written(keyed.groupBy("shard").count(), "asked")
    total = asked.agg(F.sum("count")).first()[0] or 0
    each = max(1, -(-total // (8 * partitions(spark))))
    copies = F.broadcast(asked.select("shard", F.ceil(F.col("count") / each).cast("int").alias("copies")))  # one row per shard
    left = keyed.join(copies, "shard").select(
        "shard", F.pmod(F.xxhash64("doc_id", "digest"), F.col("copies")).cast("int").alias("salt"), F.lit(1).alias("is_row"), "doc_id", "digest", "n_points",
        *[F.lit(None).cast(t).alias(c) for c, t in (("sizes", "binary"), ("bits", "binary"), ("digests", "binary"), ("i_keep_id", "array<long>"), ("i_keep_points", "array<long>"), ("i_group_size", "array<long>"))])
    right = index.join(copies, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("is_row"),
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("n_points"),
        "sizes", "bits", "digests", F.col("keep_id").alias("i_keep_id"), F.col("keep_points").alias("i_keep_points"), F.col("group_size").alias("i_group_size"))
    return (left.unionByName(right).repartition(partitions(spark), "shard", "salt").sortWithinPartitions("shard", "salt", "is_row")
            .mapInArrow(_look_up, "doc_id long, digest string, n_points long, member boolean, keep_id long, keep_points long, group_size long"))


def dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    ``history`` (digest, keep_id, keep_points, group_size) holds the distinct digests and winners of earlier data, as
    ``winners(fingerprints(...))`` gives them; without one, the documents' own distinct digests are the history. A row in a group of the history is
    compared with the historical winner by the same order. Groups count historical rows too. Null and empty texts are one
    text. Rows repeated with one doc_id: each is a row of the group, and all with the winner's id are kept. A null doc_id loses to others.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    own = history is None
    index = build_index(written(winners(rows), "winners") if own else history)
    found = look_up(rows, index)
    if not own:
        found = written(found, "looked")
        groups = written(winners(found.where("member")), "repeats").select("digest", F.col("keep_id").alias("k"), F.col("keep_points").alias("p"), F.col("group_size").alias("g"))
        new = written(winners(found.where("not member")), "strangers")
        ours = attach(found.where("member"), groups, "digest", "g", found.count())
        first = F.struct("p", (-F.col("k")).alias("n")) > F.struct(F.col("keep_points").alias("p"), (-F.col("keep_id")).alias("n"))
        ours = ours.select("doc_id", "digest", F.when(first, F.col("k")).otherwise(F.col("keep_id")).alias("keep_id"), (F.col("group_size") + F.col("g")).alias("group_size"))
        strangers = attach(found.where("not member").select("doc_id", "digest"), new, "digest", "group_size", found.count())
        found = ours.unionByName(strangers.select("doc_id", "digest", "keep_id", "group_size"))
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
