"""K-mer expansion and k-mer based similarity (SEQ-10..14, AGG-11, AGG-14, ALN-05, ALN-06)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as S
from ..session import cut_lineage
from . import sites

#: Codes of the four bases in alphabetical order, so that packed k-mers sort like their text; anything else is no base.
_BASE = np.full(256, 4, dtype=np.int64)
_BASE[np.frombuffer(b"ACGT", dtype=np.uint8)] = range(4)


def positions(df: DataFrame, k: int, step: int = 1, seq: str = "seq", keep=()) -> DataFrame:
    """One row per k-mer start (0-based ``pos``); slices are taken on bytes, in place."""
    n = F.length(seq)
    cols = list(keep)
    b = df.select(*cols, n.alias("_n"), F.col(seq).cast("binary").alias("_b"))
    p = b.select(*cols, "_b", F.explode_outer(
        F.when(F.col("_n") >= k, F.sequence(F.lit(0), F.col("_n") - k, F.lit(step)))).alias("pos"))
    return p.where(F.col("pos").isNotNull()).select(
        *cols, "pos", F.substring("_b", F.col("pos") + 1, F.lit(k)).cast("string").alias("kmer"))


def pack(seq: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-mers of a sequence in order, two bits a base (k up to 31), and their reverse complements; those with other letters are left out.

    Words of doubling length are put together, so it takes log2(k) passes over the sequence, not k.
    """
    code = _BASE[np.frombuffer(seq, dtype=np.uint8)]
    n = code.size - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)

    def roll(word: np.ndarray, later_first: bool) -> np.ndarray:
        out, have, size, at = np.zeros(n, np.int64), 0, 1, word
        while have < k:
            if k & size:  # the next ``size`` bases of the k-mer
                part = at[have:have + n]
                out = out | (part << (2 * have)) if later_first else (out << (2 * size)) | part
                have += size
            if have < k:
                nxt = at[size:]
                at = (nxt << (2 * size)) | at[:nxt.size] if later_first else (at[:nxt.size] << (2 * size)) | nxt
                size *= 2
        return out

    known = code < 4
    plain = np.where(known, code, 0)
    away = np.concatenate([[0], np.cumsum(~known)])
    ok = away[k:] == away[:-k]
    return roll(plain, False)[ok], roll(3 - plain, True)[ok]


def pack_at(seq: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed k-mers of a sequence in order, and where they start."""
    known = _BASE[np.frombuffer(seq, dtype=np.uint8)] < 4
    away = np.concatenate([[0], np.cumsum(~known)])
    return pack(seq, k)[0], np.flatnonzero(away[k:] == away[:-k])


#: Bases of the reads whose k-mers are held at once: a batch of rows has no bound in bases.
HELD = 1 << 20


def _held(seqs: pa.Array) -> Iterator[tuple[int, int]]:
    """(from, to): runs of rows of about ``HELD`` bases, one row at least."""
    at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(seqs), 0).to_numpy(zero_copy_only=False))])
    lo = 0
    while lo < len(seqs):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + HELD, side="right")) - 1)
        yield lo, hi
        lo = hi


def packed(reads: DataFrame, k: int, key: str = "read_id", extra: str | None = None) -> DataFrame:
    """(key, kmer, n_kmers): the distinct k-mers of every read as BIGINT, with how many distinct ones it has; made distinct where the read lies."""
    cols = [key, *([extra] if extra else [])]
    schema = ", ".join(f"{c} long" for c in cols) + ", kmer long, n_kmers int"

    def expand(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in part:
            for lo, hi in _held(whole.column(len(cols))):
                batch = whole.slice(lo, hi - lo)
                seqs = batch.column(len(cols))
                kinds = [np.unique(pack(s.as_buffer().to_pybytes(), k)[0]) if s.is_valid else np.empty(0, np.int64) for s in seqs]
                n = np.array([x.size for x in kinds], dtype=np.int64)
                if not n.sum():
                    continue
                held = [batch.column(i).take(pa.array(np.repeat(np.arange(n.size), n))) for i in range(len(cols))]
                yield pa.RecordBatch.from_arrays([*held, pa.array(np.concatenate(kinds)), pa.array(np.repeat(n, n).astype(np.int32))], [*cols, "kmer", "n_kmers"])

    return reads.where(F.col(key).isNotNull()).select(*cols, F.col("seq").cast("string")).mapInArrow(expand, schema)


def profile(reads: DataFrame, k: int, key: str = "read_id") -> DataFrame:
    """(key, n_kmers, distinct_kmers, canonical_kmers) of every read with a k-mer (SEQ-10); nothing is shuffled."""
    def count(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in part:
            out = []
            for s in batch.column(1):
                fwd, rev = pack(s.as_buffer().to_pybytes(), k) if s.is_valid else (np.empty(0, np.int64), np.empty(0, np.int64))
                out.append((fwd.size, np.unique(fwd).size, np.unique(np.minimum(fwd, rev)).size))
            n = np.array(out, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(n[:, i]) for i in range(3)]], [key, "n_kmers", "distinct_kmers", "canonical_kmers"]).filter(pa.array(n[:, 0] > 0))

    return reads.select(key, F.col("seq").cast("string")).mapInArrow(count, f"{key} long, n_kmers long, distinct_kmers long, canonical_kmers long")


#: K-mers that a task compares at once.
SORTED = 1 << 22


def _span(k: int) -> tuple[int, int]:
    """(m, w): length of the words that a k-mer is dealt by, and most k-mers of a stretch: w + k - 1 bases fit into 62 bits."""
    m = max(2 * k - 31, min(k, 8))
    return m, k - m + 1


def _stretches(raw: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, n, word, mark) of the stretches of up to w neighbouring k-mers with the same smallest hash (mark) of a word of m bases.

    Equal k-mers have equal marks wherever they stand. The word is the stretch itself, two bits a base, its first base highest, filled up to w + k - 1 bases.
    """
    m, w = _span(k)
    code = _BASE[raw]
    size = code.size - k + 1
    if size <= 0:
        return (np.empty(0, np.int64),) * 4
    away = np.concatenate([[0], np.cumsum(code > 3)])
    ok = away[k:] == away[:-k]
    code = np.concatenate([np.where(code > 3, 0, code), np.zeros(w, np.int64)])
    low = ((sites._words(code, m).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    have = 1
    while have < w:  # the least of ``have`` neighbours
        step = min(have, w - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    low = low[:size]
    first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (ok[1:] != ok[:-1])]))
    after = np.append(first[1:], size)
    since = np.arange(size) - np.repeat(first, after - first)
    start = np.flatnonzero(ok & (since % w == 0))
    n = np.minimum(w, after[np.searchsorted(first, start, side="right") - 1] - start)
    word = sites._words(code, w + k - 1)[start]
    spare = 2 * (w - n)
    return start, n, (word >> spare) << spare, low[start].astype(np.int64)


def _small(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs, told by the first byte."""
    size = next(s for s in (1, 2, 4) if x.max(initial=0) < 1 << (8 * s))
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def _counts(data: memoryview, at: int, n: int) -> tuple[np.ndarray, int]:
    size = data[at]
    return np.frombuffer(data, f"<u{size}", n, at + 1).astype(np.int64), at + 1 + size * n


def _kept(n: np.ndarray, k: int) -> np.ndarray:
    """Which of the eight bytes of a left-aligned stretch of n k-mers hold bases."""
    return np.arange(8)[None, :] < ((2 * (n + k - 1) + 7) // 8)[:, None]


def _block(groups: tuple[np.ndarray, np.ndarray], reads: int, owner: np.ndarray, n: np.ndarray, word: np.ndarray, k: int) -> bytes:
    """The stretches of one run of reads that go to one task: groups with their reads, stretches per read, k-mers per stretch, bases."""
    _, w = _span(k)
    rows = (word.astype(np.uint64) << np.uint64(64 - 2 * (w + k - 1))).astype(">u8").view(np.uint8).reshape(-1, 8)
    head = np.array([reads, groups[0].size, n.size], "<i8").tobytes() + groups[0].astype("<i8").tobytes() + groups[1].astype("<i8").tobytes()
    return head + _small(np.bincount(owner, minlength=reads)) + n.astype(np.uint8).tobytes() + rows[_kept(n, k)].tobytes()


def _opened(data: memoryview, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of every read, read of every stretch, n, word) of a ``_block``."""
    _, w = _span(k)
    reads, groups, size = np.frombuffer(data, "<i8", 3).tolist()
    g = np.repeat(np.frombuffer(data, "<i8", groups, 24), np.frombuffer(data, "<i8", groups, 24 + 8 * groups))
    per, at = _counts(data, 24 + 16 * groups, reads)
    n = np.frombuffer(data, np.uint8, size, at).astype(np.int64)
    rows, kept = np.zeros((size, 8), np.uint8), _kept(n, k)
    rows[kept] = np.frombuffer(data, np.uint8, -1, at + size)
    word = (rows.view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - 2 * (w + k - 1))).astype(np.int64)
    return g, np.repeat(np.arange(reads), per), n, word


def _marked(group: np.ndarray, owner: np.ndarray, n: np.ndarray, word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """(distinct k-mers, those of one group only) of every read, and the distinct k-mers of one group only by group; ``SORTED`` k-mers at once."""
    _, w = _span(k)
    names, g = np.unique(group, return_inverse=True)
    all_of, own_of, marks = (np.zeros(x, np.int64) for x in (group.size, group.size, names.size))
    slices, mask = max(1, -(-int(n.sum()) // SORTED)), (1 << (2 * k)) - 1
    for s in range(slices):
        found, of = [], []
        for j in range(w):
            on = np.flatnonzero(n > j)
            kmer = (word[on] >> (2 * (w - 1 - j))) & mask
            if slices > 1:
                here = (((kmer.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)) % np.uint64(slices)) == s
                on, kmer = on[here], kmer[here]
            found.append(kmer)
            of.append(owner[on])
        kmer, at = np.concatenate(found), np.concatenate(of)
        order = np.lexsort((at, kmer))
        kmer, at = kmer[order], at[order]
        new = np.concatenate([[True], kmer[1:] != kmer[:-1]])[:kmer.size]
        once = new | np.concatenate([[True], at[1:] != at[:-1]])[:kmer.size]
        at, new = at[once], new[once]
        if not at.size:
            continue
        first = np.flatnonzero(new)
        lone = np.minimum.reduceat(g[at], first) == np.maximum.reduceat(g[at], first)
        all_of += np.bincount(at, minlength=all_of.size)
        own_of += np.bincount(at[np.repeat(lone, np.diff([*first, at.size]))], minlength=own_of.size)
        marks += np.bincount(g[at[first[lone]]], minlength=names.size)
    return all_of, own_of, dict(zip(names.tolist(), marks.tolist()))


def _places(spark: SparkSession, parts: int) -> list[int]:
    """A value for each of ``parts`` tasks that ``repartition(parts, value)`` deals to it alone."""
    v = spark.range(24 * parts).select(F.col("id").cast("int").alias("v")).withColumn("p", F.pmod(F.hash("v"), F.lit(parts)))
    first = {r["p"]: r["v"] for r in v.groupBy("p").agg(F.min("v").alias("v")).collect()}
    return [first.get(i, i) for i in range(parts)]


def marker_counts(reads: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((read_id, g, n_kmers, c) of every row with k-mers, (g, markers)): distinct k-mers, how many of them are of one group only, and those of a group.

    reads: (read_id, g, seq), ids not null, g BIGINT. Neighbouring k-mers with the same mark travel as one stretch, a run of about ``HELD`` bases as one block
    per task: one or two bytes a k-mer, and no row of a k-mer is sorted or spilled. A task opens its blocks, compares ``SORTED`` k-mers at once and gives back
    per run the counts of its reads, which are added up by run.
    """
    parts = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = _places(reads.sparkSession, parts)

    def cut(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId() << 32
        for whole in part:
            for lo, hi in _held(whole.column(2)):
                batch = whole.slice(lo, hi - lo)
                group = batch.column(1).to_numpy(zero_copy_only=False)
                order = np.argsort(group, kind="stable")
                texts = [batch.column(2)[i].as_buffer().to_pybytes() if batch.column(2)[i].is_valid else b"" for i in order.tolist()]
                starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
                start, n, word, mark = _stretches(np.frombuffer(b"N".join(texts) + b"N", dtype=np.uint8), k)
                if not start.size:
                    continue
                owner = np.searchsorted(starts, start, side="right") - 1
                to = mark % parts
                by = np.argsort(to, kind="stable")
                owner, n, word = owner[by], n[by], word[by]
                edge = np.searchsorted(to[by], np.arange(parts + 1))
                groups = np.unique(group, return_counts=True)
                ids = batch.column(0).to_numpy(zero_copy_only=False)[order].astype("<i8").tobytes() + group[order].astype("<i8").tobytes()
                rows = [(run % parts, 1, ids)] + [(p, 0, _block(groups, order.size, owner[a:b], n[a:b], word[a:b], k))
                                                 for p, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())) if b > a]
                p, kind, data = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array([places[x] for x in p], pa.int32()), pa.array(kind, pa.int32()), pa.array([run] * len(rows), pa.int64()),
                                                  pa.array(data, pa.binary())], ["part", "kind", "run", "data"])
                run += 1

    def count(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(kind: int, run: list, data: list, n: list | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(run), pa.int32()), pa.array(run, pa.int64()), pa.array(data, pa.binary()),
                                               pa.array(n or [None] * len(run), pa.int64())], ["kind", "run", "data", "n"])

        runs, got, reads_of = [], [], 0
        for batch in part:
            for kind, run, data in zip(*(batch.column(i).to_pylist() for i in range(1, 4))):
                if kind == 1:
                    yield row(1, [run], [data])
                    continue
                g, owner, n, word = _opened(memoryview(data), k)
                got.append((g, (owner + reads_of).astype(np.int32), n.astype(np.uint8), word))
                runs.append((run, reads_of, g.size))
                reads_of += g.size
        if not got:
            return
        g, owner, n, word = (np.concatenate(x) for x in zip(*got))
        got.clear()
        every, own, marks = _marked(g, owner, n, word, k)
        for lo in range(0, len(runs), 1024):
            some = runs[lo:lo + 1024]
            yield row(0, [r for r, _, _ in some], [_small(every[a:a + m]) + _small((every - own)[a:a + m]) for _, a, m in some])
        yield row(2, list(marks), [None] * len(marks), list(marks.values()))

    def add(rows: pa.Table) -> pa.Table:
        kind, data = rows.column("kind").to_pylist(), rows.column("data").to_pylist()
        both = np.frombuffer(data[kind.index(1)], "<i8")
        size = both.size // 2
        every, other = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for one, x in zip(kind, data):
            if one == 0:
                a, at = _counts(memoryview(x), 0, size)
                every, other = every + a, other + _counts(memoryview(x), at, size)[0]
        out = {"read_id": both[:size], "g": both[size:], "n_kmers": every.astype(np.int32), "c": every - other}
        return pa.table({c: pa.array(x[every > 0]) for c, x in out.items()})

    blocks = reads.select("read_id", "g", F.col("seq").cast("string")).mapInArrow(cut, "part int, kind int, run long, data binary")
    counted = cut_lineage(blocks.repartition(parts, "part").mapInArrow(count, "kind int, run long, data binary, n long"))
    per_read = counted.where("kind < 2").groupBy("run").applyInArrow(add, "read_id long, g long, n_kmers int, c long")
    return per_read, counted.where("kind = 2").groupBy(F.col("run").alias("g")).agg(F.sum("n").alias("markers")).where("markers > 0")


def assign_by_markers(reads: DataFrame, k: int, grp: str, min_share: float = 0.30) -> DataFrame:
    """(read_id, grp, share): the group whose own k-mers a read has most of (AGG-11): shared / min(|markers|, |read's k-mers|).

    A marker is a k-mer of one group only, so the markers in a read are all of its own group (``marker_counts``). Two groups with one code stop the job.
    """
    code = F.xxhash64(grp)
    names = reads.groupBy(code.alias("g")).agg(F.min(grp).alias("grp"), F.max(grp).alias("top"))
    names = names.select("g", F.when(F.col("grp").eqNullSafe(F.col("top")), F.col("grp")).otherwise(F.raise_error(F.lit("two groups share a code")).cast("string")).alias("grp"))
    n, markers = marker_counts(reads.where("read_id is not null").withColumn("g", code), k)
    c = n.where("c > 0").groupBy("read_id", "g", "n_kmers").agg(F.sum("c").alias("c"))
    s = c.join(markers, "g").withColumn("share", F.col("c") / F.least(F.col("markers"), F.col("n_kmers"))).where(F.col("share") >= min_share)
    return s.join(names, "g").select("read_id", "grp", "share")


def kmer_set(df: DataFrame, k: int, keep, canonical: bool = False, seq: str = "seq") -> DataFrame:
    """Distinct k-mers without N per key."""
    p = positions(df, k, keep=keep, seq=seq).where(~F.col("kmer").contains("N")).drop("pos")
    if canonical:
        p = p.withColumn("kmer", S.canonical("kmer"))
    return p.distinct()


def _rows_of_keys(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that alone have their key, rows that share it or have none): a k-mer set of the former is settled within the row."""
    again = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(key).alias("_key"))
    shared = F.col(key) == F.col("_key")
    return df.where(F.col(key).isNotNull()).join(again, shared, "left_anti"), df.join(again, shared, "left_semi").unionByName(df.where(F.col(key).isNull()))


def packed_sets(df: DataFrame, k: int, key: str) -> DataFrame:
    """(key, kmer, n): the distinct k-mers (BIGINT) of every key and their number, as ``kmer_set`` counts them over the bases A, C, G, T.

    Only keys of several rows are shuffled; rows without a key take no part.
    """
    d = df.select(F.col(key).cast("long").alias(key), "seq")
    alone, shared = _rows_of_keys(d, key)
    one = packed(alone, k, key).select(key, "kmer", F.col("n_kmers").cast("long").alias("n"))
    own = packed(shared, k, key).select(key, "kmer").distinct()
    return one.unionByName(own.join(own.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key).select(key, "kmer", "n"))


def unique_profile(reads: DataFrame, k: int, key: str = "read_id") -> DataFrame:
    """(key, unique_kmers, pos_sum): how many k-mers of the bases A, C, G, T occur exactly once in a key, and the sum of their positions (SEQ-12).

    As ``unique_positions`` counted per key; a key of one row is settled where the row lies, only keys of several rows (and null) are dealt by k-mer.
    """
    d = reads.select(F.col(key).cast("long").alias(key), F.col("seq").cast("string").alias("seq"))
    alone, shared = _rows_of_keys(d, key)

    def count(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in part:
            out = []
            for s in batch.column(1):
                code, at = pack_at(s.as_buffer().to_pybytes(), k) if s.is_valid else (np.empty(0, np.int64), np.empty(0, np.int64))
                _, first, n = np.unique(code, return_index=True, return_counts=True)
                once = at[first[n == 1]]
                out.append((once.size, once.sum()))
            n = np.array(out, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n[:, 0]), pa.array(n[:, 1])], [key, "unique_kmers", "pos_sum"]).filter(pa.array(n[:, 0] > 0))

    one = alone.mapInArrow(count, f"{key} long, unique_kmers long, pos_sum long")
    plain = positions(shared, k, keep=[key]).where(~F.col("kmer").rlike("[^ACGT]"))
    u = plain.groupBy(key, "kmer").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos")).where("n = 1")
    return one.unionByName(u.groupBy(key).agg(F.count(F.lit(1)).alias("unique_kmers"), F.sum("pos").alias("pos_sum")))


def unique_positions(df: DataFrame, k: int, keep) -> DataFrame:
    """K-mers that occur exactly once per key, with their position (SEQ-12)."""
    return (positions(df, k, keep=keep).groupBy(*keep, "kmer")
            .agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos")).where(F.col("n") == 1).drop("n"))


def packed_index(df: DataFrame, k: int, part: str) -> DataFrame:
    """(part, word, pos): the k-mers of the bases A, C, G, T that occur once per ``part``, packed (k up to 31), as a written table."""
    u = unique_positions(df, k, [part]).where(F.col("kmer").rlike("^[ACGT]+$"))
    return cut_lineage(u.select(part, F.conv(F.translate("kmer", "ACGT", "0123"), 4, 10).cast("long").alias("word"), "pos"))


def indexed_positions(reads: DataFrame, index: DataFrame, k: int, part: str, keep=()) -> DataFrame:
    """(part, keep, pos, word): the positions of reads whose k bases are (nearly all) in the ``index`` (part, word) of the read's part.

    A sketch of the index goes with the tasks, so other positions never become rows; no k-mer is text.
    """
    cols = [part, *keep]
    code = F.xxhash64(part).alias("_g")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, word = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(sites._slots(word ^ g))], ["slot"])

    sketch = sites._sketch(index.select(code, "word").mapInArrow(slots, "slot long"), sites.SKETCH)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sketch.value
        for whole in batches:
            for lo, hi in _held(whole.column(len(cols) + 1)):
                b = whole.slice(lo, hi - lo)
                texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column(len(cols) + 1)]
                sizes = np.array([len(x) + 1 for x in texts], dtype=np.int64)
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                letter = _BASE[np.frombuffer(b"N".join(texts) + b"N", dtype=np.uint8)]
                away = np.concatenate([[0], np.cumsum(letter > 3)])
                word = sites._words(np.where(letter > 3, 0, letter), k)
                slot = sites._slots(word ^ np.repeat(b.column(len(cols)).to_numpy(zero_copy_only=False), sizes)[:word.size])
                at = np.flatnonzero((away[k:] == away[:-k]) & ((held[slot >> 6] >> (slot & 63)) & 1).astype(bool))
                owner = np.searchsorted(starts, at, side="right") - 1
                held_cols = [b.column(i).take(pa.array(owner)) for i in range(len(cols))]
                yield pa.RecordBatch.from_arrays([*held_cols, pa.array((at - starts[owner]).astype(np.int32)), pa.array(word[at])], [*cols, "pos", "word"])

    schema = ", ".join(f"{c} {reads.schema[c].dataType.simpleString()}" for c in cols) + ", pos int, word long"
    return reads.select(*cols, code, F.col("seq").cast("string").alias("seq")).mapInArrow(cut, schema)


def windows(df: DataFrame, lo: int, hi: int, keep) -> DataFrame:
    """Every start and length lo..hi without N, as forward and reverse oligos (SEQ-13).

    One scan: starts are exploded with the ``hi`` bases that follow, lengths from those.
    """
    cols = list(keep)
    n = F.length(seq := F.col("seq"))
    starts = df.select(*cols, n.alias("_n"), seq.cast("binary").alias("_b")).select(
        *cols, "_n", "_b", F.explode(F.when(F.col("_n") >= lo, F.sequence(F.lit(0), F.col("_n") - lo))).alias("pos"))
    starts = starts.select(*cols, "pos", (F.col("_n") - F.col("pos")).alias("_left"), F.substring("_b", F.col("pos") + 1, F.lit(hi)).cast("string").alias("_w"))
    out = starts.select(*cols, "pos", "_w", F.explode(F.sequence(F.lit(lo), F.least(F.lit(hi), F.col("_left")))).alias("len"))
    out = out.select(*cols, "pos", "len", F.substring(F.col("_w"), F.lit(1), F.col("len")).alias("kmer")).where(~F.col("kmer").contains("N"))
    both = F.explode(F.array(F.struct(F.lit("F").alias("dir"), F.col("kmer").alias("oligo")),
                             F.struct(F.lit("R").alias("dir"), S.revcomp("kmer").alias("oligo"))))
    return out.select(*cols, "pos", "len", both.alias("o")).select(*cols, "pos", "len", "o.dir", "o.oligo")


#: Rows of the smaller side of a containment that go with the tasks (24 bytes each); more are met by a sorted join.
BROADCAST_KMERS = 1_000_000


def containment(left: DataFrame, right: DataFrame, min_share: float) -> DataFrame:
    """|A n B| / min(|A|, |B|) at or above ``min_share`` (ALN-06).

    left: (a, kmer, na), right: (b, kmer, nb), as from ``packed_sets``. A left side of up to ``BROADCAST_KMERS`` rows goes to the right one's
    tasks, so that its k-mers never travel: only (a, b) with their partial counts do.
    """
    left = cut_lineage(left)
    side = F.broadcast(left) if left.count() <= BROADCAST_KMERS else left.hint("merge")
    s = right.join(side, "kmer").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    return s.withColumn("containment", F.col("shared") / F.least("na", "nb")).where(F.col("containment") >= min_share)


def read_support(candidates: DataFrame, sample: DataFrame, k: int = 21) -> DataFrame:
    """Share of a candidate's k-mers seen in its bin's sampled reads, on either strand (AGG-14).

    candidates: (bin, set, seq); sample: (bin, seq).
    """
    both = sample.select("bin", F.explode(F.array("seq", S.revcomp("seq"))).alias("seq"))
    seen = kmer_set(both, k, ["bin"])
    own = kmer_set(candidates, k, ["bin", "set"])
    hit = own.join(seen.withColumn("hit", F.lit(1)).hint("merge"), ["bin", "kmer"], "left")
    s = hit.groupBy("bin", "set").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("total"))
    meta = candidates.select("bin", "set", F.length("seq").alias("len"),
                             F.length(F.regexp_replace("seq", "[^N]", "")).alias("n_count"))
    return meta.join(s, ["bin", "set"], "left").withColumn(
        "support", F.when(F.col("total") > 0, 100.0 * F.col("found") / F.col("total")))


def choose_supported(support: DataFrame, max_n_percent: float = 50.0, band: float = 1.0) -> DataFrame:
    """Best consensus per bin (AGG-14): of those with few enough N, within a band of the best support,
    least N per cent, then longest, then best supported, then set name. support: as from ``read_support``."""
    s = (support.withColumn("n_percent", 100.0 * F.col("n_count") / F.col("len")).where(F.col("n_percent") <= max_n_percent)
         .withColumn("support", F.coalesce("support", F.lit(0.0))))
    top = s.groupBy("bin").agg(F.max("support").alias("top"))
    near = s.join(top, "bin").where(F.col("support") >= F.col("top") - band)
    best = near.groupBy("bin").agg(F.min(F.struct("n_percent", (-F.col("len")).alias("neg"), (-F.col("support")).alias("ns"), "set")).alias("m"))
    return best.select("bin", "m.set", (-F.col("m.ns")).alias("support"), "m.n_percent", (-F.col("m.neg")).alias("len"))
