"""Jaccard self-join of documents on word n-grams by chosen paths.

Equal shingle sets are one record. A record's tokens are the 128 (coordinate, minimum hash) pairs of its minhash embedding, whose
overlap estimates Jaccard. Each run splits records recursively: a node of the tree samples coordinates by a hash of its path, and
records that share the token there go on to the same child. Small buckets are compared by brute force, buckets that stay
large at the last level too, in blocks. Runs are added until a pair at the threshold is met with the target recall.
Records met are grouped, and within groups every pair of texts is verified on its exact shingle sets, in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, bounded, components, groups, partitions, short_batches, text_or_empty, written

#: Coordinates of the embedding, bucket size up to which a bucket is compared as a whole, and the last level of splitting.
COORDS, BUCKET, LEVELS = 128, 512, 3
#: Records of a block when a group is verified.
BLOCK = 128
#: Estimates this far below the threshold still count as met: four deviations of 128 coordinates.
MARGIN = 0.14
SEED = 0x5EED
REMEMBERED = 100_000
_U = np.uint64
_rng = np.random.default_rng(SEED)
_MULT = _rng.integers(1, 2**63, COORDS, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(0, 2**63, COORDS, dtype=np.uint64)
_words: dict[str, int] = {}


def word_hashes(words: list[str]) -> np.ndarray:
    global _words
    if len(_words) > REMEMBERED:
        _words = {}
    known = _words
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def shingles(text: str, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of n words; a text of fewer words is one shingle, one without words none."""
    words = text.split()
    if not words:
        return np.empty(0, np.uint64)
    h, k = word_hashes(words), min(n, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix64(out * _U(0x9E3779B97F4A7C15) + h[i:len(h) - k + 1 + i])
    return np.unique(out)


def embed(s: np.ndarray) -> np.ndarray:
    """Minimum hash by coordinate, 32 bits each; the set must not be empty."""
    best = np.full(COORDS, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 2048):
            best = np.minimum(best, (s[at:at + 2048, None] * _MULT + _ADD).min(axis=0))
    return (best >> _U(32)).astype(np.uint32)


def set_hash(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def children(paths: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, int]]:
    """(positions, coordinate) sampled by each node: a coordinate is chosen with probability 1 / (threshold * COORDS)."""
    cut = _U(int(2**64 / (threshold * COORDS)))
    for i in range(COORDS):
        with np.errstate(over="ignore"):
            at = np.flatnonzero(mix64(paths ^ _U(0xD6E8FEB86659FD93 * (i + 1) % 2**64)) < cut)
        if len(at):
            yield at, i


def descend(paths: np.ndarray, rows: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Paths of the next level and the records on them."""
    out = [(np.empty(0, np.uint64), np.empty(0, np.int64))]
    for at, i in children(paths, threshold):
        with np.errstate(over="ignore"):
            out.append((mix64(paths[at] * _U(0x9E3779B97F4A7C15) + (_U(i) << _U(32)) + sig[rows[at], i].astype(np.uint64)), rows[at]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def roots(threshold: float, recall: float) -> np.ndarray:
    """Paths of the runs: as many as a pair at the threshold needs to share a bucket of the last level with probability ``recall``."""
    met = 1.0
    for _ in range(LEVELS - 1):
        met = 1 - (1 - met / (threshold * COORDS)) ** (threshold * COORDS)
    runs, missed = [], 1.0
    while missed > 1 - recall:
        path = mix64(np.array([SEED + len(runs)], np.uint64))
        missed *= (1 - threshold * met) ** sum(len(at) for at, _ in children(path, threshold))
        runs.append(path[0])
    return np.array(runs, np.uint64)


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDS)


def forest(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric adjacency matrix."""
    out, open_ = [], np.ones(len(ids), bool)
    for root in range(len(ids)):
        if not open_[root]:
            continue
        open_[root], front = False, [root]
        while front:
            at = front.pop()
            new = np.flatnonzero(linked[at] & open_)
            open_[new] = False
            front += new.tolist()
            out += [(int(ids[at]), int(ids[n])) for n in new]
    return out


def _in_blocks(n: Column, record: Column, block: int) -> Column:
    """The (lo, hi) pairs of blocks in which a record of a group of n is compared."""
    count = F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    mine = F.pmod(F.xxhash64(record), count).cast("int")
    return F.explode(F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.struct(F.least(mine, j).alias("lo"), F.greatest(mine, j).alias("hi"), (mine <= j).alias("first"), mine.alias("mine"))))


def _across(t: pa.Table) -> np.ndarray:
    """Which pairs of a (lo, hi) group are to be compared: all within one block, else those across."""
    mine, lo, hi = t.column("mine").to_numpy(), t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
    fits = np.ones((len(mine), len(mine)), bool) if lo == hi else mine[:, None] != mine[None]
    np.fill_diagonal(fits, False)
    return fits


def join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links, n_copies of every row.

    Two texts are linked if the Jaccard similarity of their sets of n-word shingles is at least ``threshold``. class_id is the
    smallest doc_id among all documents joined through links or equal sets; n_links counts the other distinct shingle sets
    that the row's set is linked to; n_copies the rows with its set, itself included. Links are verified exactly; a pair
    at the threshold is met with probability ``recall`` at least, more similar ones more surely. A text without words
    has no links and is its own class. Rows repeated with one doc_id are rows of their own. A set held by null ids only has no links.
    """
    spark = docs.sparkSession
    short_batches(spark)
    runs, parts = roots(threshold, recall), partitions(spark)

    def sketch(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in part:
            sets = [shingles(t, n) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([set_hash(s) if len(s) else None for s in sets], pa.binary()),
                                              pa.array([embed(s).tobytes() if len(s) else None for s in sets], pa.binary())], names=["doc_id", "key", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    sketched = written(rows.mapInArrow(sketch, "doc_id long, key binary, sig binary"), "sketches")
    sets = written(sketched.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies")), "sets")
    reps = sketched.join(sets.where("rep is not null").select(F.col("rep").alias("doc_id"), "key"), ["doc_id", "key"], "inner").dropDuplicates(["key"])
    reps = written(reps.select(F.col("doc_id").alias("rep"), "key", "sig"), "records")

    def start(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in part:
            ids, sig = batch.column("rep").to_numpy(), _sigs(batch.column("sig"))
            paths, at = np.repeat(runs, len(ids)), np.tile(np.arange(len(ids)), len(runs))
            for _ in range(2):
                paths, at = descend(paths, at, sig, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(ids[at])], names=["bucket", "rep"])

    def deeper(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in part:
            paths, at = descend(batch.column("bucket").to_numpy().view(np.uint64), np.arange(len(batch)), _sigs(batch.column("sig")), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(batch.column("rep").to_numpy()[at])], names=["bucket", "rep"])

    def counted(frontier: DataFrame) -> DataFrame:
        frontier = written(frontier.distinct(), "frontier")
        sizes = written(frontier.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
        return written(frontier.join(sizes.hint("merge"), "bucket"), "met")

    level = counted(reps.mapInArrow(start, "bucket long, rep long"))
    leaves = level.where(F.col("n") <= BUCKET)
    for _ in range(LEVELS - 2):
        large = level.where(F.col("n") > BUCKET).join(reps.select("rep", "sig"), "rep")
        level = counted(large.mapInArrow(deeper, "bucket long, rep long"))
        leaves = leaves.unionByName(level.where(F.col("n") <= BUCKET))
    leaves = leaves.unionByName(level.where(F.col("n") > BUCKET)) if LEVELS > 2 else level

    def brute(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, out = (threshold - MARGIN) * COORDS, []
        for t in groups(part, ["bucket", "lo", "hi"]):
            ids, sig = t.column("rep").to_numpy(), _sigs(t.column("sig"))
            if len(ids) > 1:
                near = np.array([(sig == s).sum(axis=1) >= least for s in sig])
                out += forest(ids, near & _across(t))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    blocks = leaves.select("bucket", "rep", _in_blocks(F.col("n"), F.col("rep"), BUCKET).alias("p")).select("bucket", "rep", "p.lo", "p.hi", "p.mine")
    work = blocks.join(reps.select("rep", "sig"), "rep").repartition(parts, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    met = components(written(work.mapInArrow(brute, "a long, b long").distinct(), "candidates"))

    met = written(met, "groups")
    sized = met.join(met.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root").join(reps.select(F.col("rep").alias("node"), "key"), "node")
    sized = written(sized.select("node", "root", "n", "key"), "members")
    texts = rows.join(bounded(sized), rows["doc_id"] == sized["node"]).select("root", "node", "key", "text", _in_blocks(F.col("n"), F.col("node"), BLOCK).alias("p"))
    texts = texts.select("root", "node", "key", "text", "p.lo", "p.hi", "p.mine").repartition(parts, "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")

    def verify(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(part, ["root", "lo", "hi"]):
            found: dict[int, tuple[int, np.ndarray]] = {}
            keys, ids, text = t.column("key").to_pylist(), t.column("node").to_pylist(), t.column("text").to_pylist()
            for i, k in enumerate(ids):
                if k not in found:
                    s = shingles(text[i], n)
                    if len(s) and set_hash(s) == keys[i]:  # of rows repeated with one id, the record's own text
                        found[k] = (i, s)
            if len(found) < 2:
                continue
            at, members = zip(*found.values(), strict=True)
            size = np.array([len(s) for s in members])
            shared = overlaps(members)
            linked = (shared >= threshold * (size[:, None] + size[None] - shared) - 1e-9) & _across(t.take(pa.array(at)))
            nodes = np.array(list(found))
            links = forest(nodes, linked)
            degree = linked.sum(axis=1)
            rows_ = [(a, b, 0) for a, b in links] + [(int(x), None, int(d)) for x, d in zip(nodes, degree, strict=True) if d]
            if rows_:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows_, strict=True)], names=["a", "b", "links"])

    links = written(texts.mapInArrow(verify, "a long, b long, links long"), "verified")
    degree = links.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("n_links"))
    classes = components(links.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), F.col("root").alias("class_id"))
    info = written(sets.join(classes, "rep", "left").join(degree, "rep", "left")
                   .select("key", "n_copies", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    keyed = sketched.where("key is not null").select("doc_id", "key")
    out = attach(keyed, info, "key", "n_copies", sketched.count()).select("doc_id", "class_id", "n_links", "n_copies")
    alone = sketched.where("key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return out.unionByName(alone)


def overlaps(sets: tuple[np.ndarray, ...]) -> np.ndarray:
    """Sizes of all pairwise intersections, through matrix products over stretches of the shared tokens."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    token, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column, minlength=len(token)) > 1
    rank = np.cumsum(often) - 1
    owner, column = owner[often[column]], rank[column[often[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out, step = np.zeros((len(sets), len(sets)), np.float64), 1 << 14
    for lo in range(0, int(often.sum()), step):
        a, b = np.searchsorted(column, [lo, lo + step])
        m = np.zeros((len(sets), step), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += m @ m.T
    return np.rint(out).astype(np.int64)
