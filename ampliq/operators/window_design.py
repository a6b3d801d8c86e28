"""Primer pairs sought apart in every window of a group's backbones (OPT-02).

A group has a backbone per length class. A pair counts if it binds every member; a product that lies wholly outside of the backbone's
marked locus is asked only of the long members, and measured in the long bins alone. Which sequences an oligo binds are bits of mask
words, so "every member" is one comparison per word and the competitors of a pair are bits of an AND. Each window keeps its best pairs,
which are measured on the reads; the one with the highest worst fold wins the window.

Without mismatches no such masks are made: a group's members are compared with its backbones where they meet, only windows that they share are
measured, and pairs are ranked inside their window, so that a pair becomes a row only if it can be one of the best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .. import params as P
from ..session import cut_lineage
from . import design as D
from . import group_design as G
from . import measure as M
from . import sites
from .design import grid_masks as _grid_masks
from .design import packed_words as _packed
from .ranking import top_n
from .sites import turned as _turned

#: Bases of a group's members that one task compares with the backbones, windows of a backbone that are ranked at once, and sequences outside of
#: the group that are listed per oligo; where more bind it, pairs that may be among the best are counted afterwards.
PART, CHUNK, LISTED = 1 << 22, 64, 512
#: Rivals of a pair whose primers both bind more than that, until they are counted; sequences that lists are compared over at once.
MANY, HELD = 1 << 30, 4096
#: Mask words of a cell's primers that are compared at once.
WORDS = 1024


@dataclass(frozen=True)
class Rules:
    """Windows, binding and how many pairs of a window are measured; fixed values of the published rule."""

    lengths: tuple[int, int] = P.OLIGO_LENGTH
    max_mm: int = 1
    exact_tail: int = 2
    product: tuple[int, int] = (60, 400)
    short: int = 150  # products up to it go first among pairs with equally many competitors
    width: int = 700
    step: int = 300
    shortest: int = 120
    ratio: float = 1.5  # a backbone is at least so many times as long as the next one
    keep: int = 8
    min_reads: int = P.MIN_COMPETITOR_READS


def backbones(seqs: DataFrame, ratio: float = 1.5, shortest: int = 120) -> DataFrame:
    """(grp, seq_id, seq): the longest member, then the longest that the backbone before is ``ratio`` times as long as, and so on.

    Equal lengths: the smallest seq_id. Members under ``shortest`` have no window and are no backbones. The list folded per group
    holds distinct lengths, however many members share them.
    """
    m = seqs.where("grp is not null").withColumn("n", F.length("seq")).where(F.col("n") >= shortest)
    first = cut_lineage(m.groupBy("grp", "n").agg(F.min("seq_id").alias("seq_id"), F.min_by("seq", "seq_id").alias("seq")))

    def longer(picked, n):
        fits = (F.size(picked) == 0) | (F.get(picked, F.size(picked) - 1) >= ratio * n)
        return F.when(fits, F.concat(picked, F.array(n))).otherwise(picked)

    lengths = first.groupBy("grp").agg(F.sort_array(F.collect_set("n"), asc=False).alias("ns"))
    picked = lengths.select("grp", F.explode(F.aggregate("ns", F.array().cast("array<int>"), longer)).alias("n"))
    return first.join(picked, ["grp", "n"]).select("grp", "seq_id", "seq")


def _word(seq_id: str = "seq_id"):
    return F.floor(F.col(seq_id) / G.WORD).alias("word")


def _bits(seq_id: str = "seq_id"):
    return F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({seq_id}, {G.WORD}) AS int))"))


def binding_masks(found: DataFrame) -> DataFrame:
    """(oligo, strand, word, mask): the sequences an oligo binds on a strand. seq_id is an integer."""
    return found.groupBy("oligo", "strand", _word()).agg(_bits().alias("mask"))


def member_masks(seqs: DataFrame) -> DataFrame:
    """(grp, base, word, whole, words): all members, and the long ones alone. seqs: (seq_id, grp, long)."""
    base = F.explode(F.when(F.col("long"), F.array(F.lit("all"), F.lit("long"))).otherwise(F.array(F.lit("all")))).alias("base")
    w = seqs.where("grp is not null").select("grp", "seq_id", base).groupBy("grp", "base", _word()).agg(_bits().alias("whole"))
    return w.join(w.groupBy("grp", "base").agg(F.count(F.lit(1)).alias("words")), ["grp", "base"])


def universal(asked: DataFrame, marks: DataFrame, need: DataFrame) -> DataFrame:
    """(grp, oligo, strand, base): the oligos that bind all of a group's members, or all of its long ones. asked: (grp, oligo, strand)."""
    hit = asked.join(marks, ["oligo", "strand"]).join(need, ["grp", "word"]).where(F.col("mask").bitwiseAND(F.col("whole")) == F.col("whole"))
    return (hit.groupBy("grp", "oligo", "strand", "base", "words").agg(F.count(F.lit(1)).alias("n"))
            .where("n = words").select("grp", "oligo", "strand", "base"))


def _mask_rows(names: list, words: list, masks: list, of: dict, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of every name of ``of``, rows): masks over the words of a block; row 0 holds none, and stands for names without any there."""
    row, rows = np.zeros(len(of), np.int64), [np.zeros(block.size, np.int64)]
    for name, word, mask in zip(names, words, masks):
        lo, hi = np.searchsorted(word, [block[0], block[-1] + 1])
        if hi > lo:
            if not row[of[name]]:
                row[of[name]] = len(rows)
                rows.append(np.zeros(block.size, np.int64))
            rows[row[of[name]]][np.searchsorted(block, word[lo:hi])] |= mask[lo:hi]
    return row, np.stack(rows)


def shared_competitors(pairs: DataFrame, marks: DataFrame, need: DataFrame) -> DataFrame:
    """(grp, fwd, rev, rivals): sequences outside of the group that both primers bind; no row where there are none.

    Pairs are dealt to the cells of a grid, by forward and by reverse primer, and the masks of a primer go to the cells that have it: about the square root
    of the tasks, once each, however many pairs and groups ask for it. A cell counts ``WORDS`` mask words of its pairs at once.
    """
    side = max(1, math.isqrt(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cell = F.pmod(F.xxhash64("fwd"), F.lit(side)) * side + F.pmod(F.xxhash64("rev"), F.lit(side))
    asked = cut_lineage(pairs.select("grp", "fwd", "rev").distinct().withColumn("cell", cell))
    lists = F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("bits")
    strands = {"+": "fwd", "-": "rev"}
    own = need.where("base = 'all'").groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("word", F.col("whole").alias("mask")))).alias("bits"))
    held = asked.select("cell", "grp").distinct().join(own, "grp").select("cell", F.lit("grp").alias("kind"), F.lit(None).cast("string").alias("oligo"), "grp", "bits")
    for strand, name in strands.items():
        of = marks.where(F.col("strand") == strand).groupBy("oligo").agg(lists)
        of = asked.select("cell", F.col(name).alias("oligo")).distinct().join(of, "oligo")
        held = held.unionByName(of.select("cell", F.lit(name).alias("kind"), "oligo", F.lit(None).cast(need.schema["grp"].dataType).alias("grp"), "bits"))
    held = held.select("cell", "kind", "oligo", "grp", "bits.word", "bits.mask")

    def count(masks: pa.Table, of: pa.Table) -> pa.Table:
        of = of.select(["grp_", "fwd_", "rev_"]).rename_columns(["grp", "fwd", "rev"])
        columns = {c: of.column(c).to_pylist() for c in ("grp", "fwd", "rev")}
        kind = np.array(masks.column("kind").to_pylist(), dtype=object)
        words, bits = ([x.values.to_numpy(zero_copy_only=False) for x in masks.column(c)] for c in ("word", "mask"))
        sides = []
        for name, values in columns.items():
            names = {x: i for i, x in enumerate(dict.fromkeys(values))}
            at = np.flatnonzero(kind == name).tolist()
            key = masks.column("grp" if name == "grp" else "oligo").to_pylist()
            sides.append((names, np.array([names[x] for x in values], dtype=np.int64), [key[i] for i in at], [words[i] for i in at], [bits[i] for i in at]))
        rivals = np.zeros(of.num_rows, np.int64)
        every = np.unique(np.concatenate([x for s in sides[1:] for x in s[3]] or [np.empty(0, np.int64)]))
        for start in range(0, every.size if of.num_rows else 0, WORDS):
            block = every[start:start + WORDS]
            parts = []
            for names, which, key, word, mask in sides:
                if names is sides[0][0]:  # of a group only the words that a primer has
                    kept = [np.isin(x, block) for x in word]
                    word, mask = [x[k] for x, k in zip(word, kept)], [x[k] for x, k in zip(mask, kept)]
                row, rows = _mask_rows(key, word, mask, names, block)
                parts.append((row[which], rows))
            (g, whole), (f, left), (r, right) = parts
            on = np.flatnonzero((f > 0) & (r > 0))
            for lo in range(0, on.size, 1024):
                i = on[lo:lo + 1024]
                rivals[i] += np.bitwise_count(left[f[i]] & right[r[i]] & ~whole[g[i]]).sum(axis=1, dtype=np.int64)
        return of.append_column("rivals", pa.array(rivals)).filter(pa.array(rivals > 0))

    # few bytes, much work: dealt by number, which isn't put together again by bytes
    held = held.repartition(side * side, "cell")
    asked = asked.select(*[F.col(c).alias(f"{c}_") for c in asked.columns])
    return held.groupBy("cell").cogroup(asked.groupBy("cell_")).applyInArrow(count, f"grp {need.schema['grp'].dataType.simpleString()}, fwd string, rev string, rivals long")


def shared_windows(seqs: DataFrame, back: DataFrame, rules: Rules) -> DataFrame:
    """(grp, seq_id, whole, long): which windows of a backbone all members of a part of its group have, and all long ones (null: there are none).

    Both are bits, the shortest windows first. A group of more than ``PART`` bases has several parts, each of which meets the backbones.
    """
    m = seqs.where("grp is not null")
    hot = m.groupBy("grp").agg(F.sum(F.length("seq")).alias("n")).where(F.col("n") > PART)
    hot = F.broadcast(hot.select("grp", F.ceil(F.col("n") / PART).alias("parts")))  # one row for PART bases at most
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    m = m.join(hot, "grp", "left").select("grp", F.pmod(F.xxhash64("seq_id"), parts).alias("part"), "long", "seq")
    b = back.join(hot, "grp", "left").select("grp", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "seq_id", "seq")
    sizes = D.oligo_sizes(rules.lengths)

    def meet(members: pa.Table, own: pa.Table) -> pa.Table:
        distinct: dict[str, bool] = {}
        for seq, long in zip(members.column("seq").to_pylist(), members.column("long").to_pylist()):
            distinct[seq] = distinct.get(seq, False) or bool(long)
        seqs_of = own.column("seq").to_pylist()
        whole, longs = [], []
        for size in sizes if seqs_of else ():
            backs = [_packed(seq, size)[1:] for seq in seqs_of]
            sought, place = np.unique(np.concatenate([words for words, _ in backs]), return_inverse=True)
            every = [np.ones(sought.size, bool), np.ones(sought.size, bool)]
            for seq, long in distinct.items():
                _, words, known = _packed(seq, size)
                words = words[known]
                at = np.minimum(np.searchsorted(sought, words), max(0, sought.size - 1))
                hit = np.zeros(sought.size, bool)
                if sought.size:
                    hit[at[sought[at] == words]] = True
                every[0] &= hit
                if long:
                    every[1] &= hit
            cuts = np.cumsum([words.size for words, _ in backs])[:-1]
            for kept, found in zip((whole, longs), every):
                kept.append([f & known for f, (_, known) in zip(np.split(found[place], cuts), backs)])
        any_long = any(distinct.values())
        bits = [[np.packbits(np.concatenate(x)).tobytes() for x in zip(*of)] for of in (whole, longs)]
        return pa.table({"grp": own.column("grp"), "seq_id": own.column("seq_id"), "whole": pa.array(bits[0], pa.binary()),
                         "long": pa.array(bits[1] if any_long else [None] * len(seqs_of), pa.binary())})

    kind = {c: back.schema[c].dataType.simpleString() for c in ("grp", "seq_id")}
    # few bytes, much work: dealt by number, which isn't put together again by bytes
    m = m.repartition(int(back.sparkSession.conf.get("spark.sql.shuffle.partitions")), "grp", "part")
    return m.groupBy("grp", "part").cogroup(b.groupBy("grp", "part")).applyInArrow(meet, f"grp {kind['grp']}, seq_id {kind['seq_id']}, whole binary, long binary")


def _windows(n: int, rules: Rules) -> list[tuple[int, int, int]]:
    """(window, start, end) of a backbone of n bases, as ``design.locus_windows``."""
    of = [(w, min(w * rules.step, max(0, n - rules.width))) for w in range(max(1, (n - rules.width) // rules.step + 2))]
    return [(w, s, min(n, s + rules.width)) for w, s in of if min(n, s + rules.width) - s >= rules.shortest]


def oligo_packs(back: DataFrame, shared: DataFrame, loci: DataFrame, rules: Rules) -> DataFrame:
    """The shared windows of ``CHUNK`` windows of a backbone that make oligos, one row of arrays: grp, backbone, chunk, n, lo, hi, and per window
    pos, len, base (1: in all members, 2: in all long ones), f and r (grid cells passed by it and by its reverse complement) and the packed word."""
    of = shared.groupBy("grp", "seq_id").agg(F.collect_list("whole").alias("whole"), F.collect_list("long").alias("long"))
    limits = loci.select("seq_id", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    rows = back.join(of, ["grp", "seq_id"]).join(limits, "seq_id", "left").select("grp", F.col("seq_id").alias("backbone"), "lo", "hi", "seq", "whole", "long")
    # a backbone becomes thousands of oligos with temperatures: the few rows are dealt first, by bytes they would all be one task
    rows = rows.repartition(int(back.sparkSession.conf.get("spark.sql.shuffle.partitions")), "backbone")
    sizes = D.oligo_sizes(rules.lengths)
    kinds = {"pos": pa.int32(), "len": pa.int32(), "base": pa.int32(), "f": pa.int64(), "r": pa.int64(), "word": pa.int64()}

    def made(seq: str, whole: list[bytes], long: list[bytes]) -> dict[str, np.ndarray]:
        total = sum(max(0, len(seq) - k + 1) for k in sizes)
        every = [np.bitwise_and.reduce([np.unpackbits(np.frombuffer(b, np.uint8), count=total) for b in bits]) if bits else np.zeros(total, np.uint8)
                 for bits in (whole, long)]
        base, parts, done = every[0].astype(np.int32) + 2 * every[1], [], 0
        for size in sizes:
            code, words, known = _packed(seq, size)
            _, turned, _ = _packed(seq[::-1].translate(_COMPLEMENT), size)
            if not words.size:
                continue
            free = D.free_of_runs(code, size)
            own = base[done:done + words.size]
            done += words.size
            at = np.flatnonzero(known & free & (own > 0))
            f, r = _grid_masks(code, words, turned[::-1], at, size)
            use = (f | r) != 0
            at = at[use]
            parts.append((at, np.full(at.size, size), own[at], f[use], r[use], words[at]))
        return dict(zip(kinds, (np.concatenate(x) for x in zip(*parts)))) if parts else {}

    def deal(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in part:
            for i, row in enumerate(batch.select(["seq", "whole", "long"]).to_pylist()):
                o, ws = made(**row), _windows(len(row["seq"]), rules)
                keys = {}
                for c in range(0, len(ws) if o else 0, CHUNK):
                    some = ws[c:c + CHUNK]
                    at = np.flatnonzero((o["pos"] >= some[0][1]) & (o["pos"] + o["len"] <= some[-1][2]))
                    if at.size:
                        keys = {k: batch.column(k).slice(i, 1) for k in ("grp", "backbone", "lo", "hi")}
                        cols = {k: pa.array([o[k][at]], pa.list_(t)) for k, t in kinds.items()}
                        extra = {"chunk": pa.array([c // CHUNK], pa.int32()), "n": pa.array([len(row["seq"])], pa.int32())}
                        yield pa.RecordBatch.from_pydict(keys | extra | cols)

    kind = {c: back.schema[c].dataType.simpleString() for c in ("grp", "seq_id")}
    return rows.mapInArrow(deal, f"grp {kind['grp']}, backbone {kind['seq_id']}, lo long, hi long, chunk int, n int, "
                                 "pos array<int>, len array<int>, base array<int>, f array<long>, r array<long>, word array<long>")


_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def outside_lists(seqs: DataFrame, packs: DataFrame, rules: Rules) -> DataFrame:
    """(grp, backbone, chunk, len, word, out): sequences outside of the group that have the word, null where they are more than ``LISTED``.

    Of a word at most LISTED + 1 sequences of each group are kept and 2 * LISTED + 2 of all: a list that long leaves more than LISTED for every
    group, a shorter one is whole up to groups that alone have more than LISTED.
    """
    key = ["site_len", "word"]
    want = packs.select("grp", "backbone", "chunk", F.explode(F.arrays_zip(F.col("len").alias("site_len"), "word")).alias("o")).select("grp", "backbone", "chunk", "o.*")
    have = sites.held_words(seqs.select("seq_id", F.col("grp").alias("home"), "seq"), sites.word_sketch(want), D.oligo_sizes(rules.lengths), once=True).drop("start")
    few = top_n(have, [*key, "home"], [F.col("seq_id")], LISTED + 1).drop("rank")
    few = top_n(few, key, [F.col("seq_id")], 2 * LISTED + 2).drop("rank")
    sets = few.groupBy(*key).agg(F.collect_list(F.struct("home", "seq_id")).alias("all"), F.min("home").alias("a"), F.max("home").alias("b"),
                                 F.count("home").alias("n"), F.count(F.lit(1)).alias("m"))
    sets = sets.where("a is null or a <> b or n < m")  # the rest is in one group alone
    sets = sets.select(*key, F.when(F.col("m") < 2 * LISTED + 2, F.col("all")).alias("all"))  # a list that long needn't travel
    out = F.transform(F.filter("all", lambda x: ~x["home"].eqNullSafe(F.col("grp"))), lambda x: x["seq_id"])
    got = want.join(sets, key).select("grp", "backbone", "chunk", F.col("site_len").alias("len"), "word", out.alias("out")).where("out is null or size(out) > 0")
    return got.withColumn("out", F.when(F.size("out") <= LISTED, F.col("out")))


def _text(word: int, size: int) -> str:
    return "".join("ACGT"[(word >> (2 * i)) & 3] for i in range(size - 1, -1, -1))


def ranked_pairs(packs: DataFrame, out: DataFrame, rules: Rules) -> DataFrame:
    """The pairs of each window that can be among its best: grp, backbone, window, fwd, rev, f_pos, r_end, bp, base, rivals (null: between 0 and many).

    A pair of which a primer binds nothing outside, or of which both are listed, is counted here. Another has bounds, and is kept if its lower one
    comes before the last of the best by their upper ones; of two primers that a window has many times, the first places are kept.
    """
    key = ["grp", "backbone", "chunk"]

    def best(pack: pa.Table, listed: pa.Table) -> pa.Table:
        rows = []
        none = np.empty(0, np.int64)
        every = [x if x.is_valid else None for x in listed.column("out")]  # numbers stay in their buffers
        lists = {(n, w): None if o is None else o.values.to_numpy(zero_copy_only=False) for n, w, o in zip(listed.column("len").to_pylist(), listed.column("word").to_pylist(), every)}
        for row in pack.to_pylist():
            pos, size, base, fm, rm, word = (np.array(row[c], dtype=np.int64) for c in ("pos", "len", "base", "f", "r", "word"))
            back = _turned(word, size)
            outs = [lists.get(k, none) for k in zip(size.tolist(), word.tolist())]
            n_out = np.array([LISTED + 1 if o is None else len(o) for o in outs], dtype=np.int64)
            lo, hi = (far if row[c] is None else row[c] for c, far in (("lo", -np.inf), ("hi", np.inf)))
            for window, start, end in _windows(row["n"], rules)[row["chunk"] * CHUNK:(row["chunk"] + 1) * CHUNK]:
                inside = (pos >= start) & (pos + size <= end)
                f, r = np.flatnonzero(inside & (fm != 0)), np.flatnonzero(inside & (rm != 0))
                r_end = pos[r] + size[r]
                bp = r_end[None, :] - pos[f][:, None]
                need = np.where((pos[f] >= hi)[:, None] | (r_end <= lo)[None, :], 2, 1)
                ok = ((bp >= rules.product[0]) & (bp <= rules.product[1]) & (pos[r][None, :] >= (pos[f] + size[f])[:, None])
                      & ((fm[f][:, None] & rm[r][None, :]) != 0) & ((base[f][:, None] & base[r][None, :] & need) != 0))
                i, j = np.nonzero(ok)
                if not i.size:
                    continue
                bp, need = bp[i, j], need[i, j]
                a, b = n_out[f[i]], n_out[r[j]]
                sure = (a == 0) | (b == 0) | (np.maximum(a, b) <= LISTED)
                low = _shared(outs, f, r)[i, j] if n_out[f].any() and n_out[r].any() else np.zeros(i.size, np.int64)
                high = np.where(sure, low, np.where(np.minimum(a, b) > LISTED, MANY, np.minimum(a, b)))
                if i.size > rules.keep:  # by rivals and length alone first: few pairs are left for the whole order
                    short = ((bp > rules.short).astype(np.int64) << 31) | bp
                    some = np.flatnonzero(((low << 32) | short) <= np.partition((high << 32) | short, rules.keep - 1)[rules.keep - 1])
                    i, j, bp, need, sure, low, high = (x[some] for x in (i, j, bp, need, sure, low, high))
                turn = np.empty(i.size, np.int64)
                left = [x << (2 * (31 - n)) for x, n in ((word[f], size[f]), (back[r], size[r]))]
                turn[np.lexsort((pos[f[i]], size[r[j]], left[1][j], size[f[i]], left[0][i], bp, bp > rules.short))] = np.arange(i.size)
                last = np.lexsort((turn, high))[:rules.keep][-1]
                can = np.flatnonzero((low < high[last]) | ((low == high[last]) & (turn <= turn[last]))) if i.size > rules.keep else np.arange(i.size)
                # the same two primers at several places have the same rivals: only the first places can be among the best
                can = can[np.lexsort((turn[can], word[r[j[can]]], size[r[j[can]]], word[f[i[can]]], size[f[i[can]]]))]
                two = np.stack([word[f[i[can]]], size[f[i[can]]], word[r[j[can]]], size[r[j[can]]]])
                new = np.flatnonzero(np.concatenate([[True], (np.diff(two) != 0).any(axis=0)]))
                for x in can[np.arange(can.size) - np.repeat(new, np.diff([*new, can.size])) < rules.keep]:
                    p, q = f[i[x]], r[j[x]]
                    rows.append((row["grp"], row["backbone"], window, _text(int(word[p]), int(size[p])), _text(int(back[q]), int(size[q])), int(pos[p]),
                                 int(pos[q] + size[q]), int(bp[x]), "all" if need[x] == 1 else "long", int(low[x]) if sure[x] else None))
        cols = list(zip(*rows)) or [()] * len(columns)
        return pa.table([pa.array(c, t) for c, t in zip(cols, columns.values())], names=list(columns))

    columns = {"grp": None, "backbone": None, "window": pa.int32(), "fwd": pa.string(), "rev": pa.string(), "f_pos": pa.int32(), "r_end": pa.int32(),
               "bp": pa.int32(), "base": pa.string(), "rivals": pa.int64()}
    columns |= {c: to_arrow_type(packs.schema[c].dataType) for c in ("grp", "backbone")}
    kind = {c: packs.schema[c].dataType.simpleString() for c in ("grp", "backbone")}
    # few bytes, much work: dealt by number, which isn't put together again by bytes
    packs = packs.repartition(int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    out = out.select(*[F.col(c).alias(f"{c}_") for c in key], "len", "word", "out")
    return packs.groupBy(*key).cogroup(out.groupBy(*[f"{c}_" for c in key])).applyInArrow(
        best, f"grp {kind['grp']}, backbone {kind['backbone']}, window int, fwd string, rev string, f_pos int, r_end int, bp int, base string, rivals long")


def _shared(outs: list, f: np.ndarray, r: np.ndarray) -> np.ndarray:
    """How many sequences the lists of f and r have in common, 0 where one of them has none or too many."""
    none = np.empty(0, np.int64)
    lists = [[none if outs[x] is None else outs[x] for x in side] for side in (f, r)]
    owner = [np.repeat(np.arange(len(side)), [len(o) for o in side]) for side in lists]
    ids = [np.concatenate([none, *side]) for side in lists]
    common = np.intersect1d(*ids)
    at = [np.minimum(np.searchsorted(common, x), max(0, common.size - 1)) for x in ids]
    both = np.zeros((f.size, r.size), np.int64)
    for start in range(0, common.size, HELD):  # a block of the sequences at a time
        held = []
        for side, x, place, own in zip(lists, ids, at, owner):
            m = np.zeros((len(side), min(HELD, common.size - start)), np.float32)
            use = (common[place] == x) & (place >= start) & (place < start + HELD)
            m[own[use], place[use] - start] = 1
            held.append(m)
        both += (held[0] @ held[1].T).astype(np.int64)
    return both


def marked_pairs(seqs: DataFrame, back: DataFrame, loci: DataFrame, need: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(pairs, marks) where oligos bind with mismatches or sequences have other letters: all pairs of all windows, and what every oligo binds."""
    dealt = back.repartition(int(back.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seq_id")
    cand = cut_lineage(D.candidates(dealt.select(F.col("seq_id").alias("target"), "seq"), rules.lengths).where("pm <> 0"))
    marks = cut_lineage(binding_masks(G.oligo_sites(seqs, cand.select("oligo").distinct(), rules)))
    of = back.select("grp", F.col("seq_id").alias("target"))
    c = cand.join(of, "target").withColumn("strand", F.when(F.col("dir") == "F", "+").otherwise("-"))
    u = universal(c.select("grp", "oligo", "strand").distinct(), marks, need)
    c = c.join(u, ["grp", "oligo", "strand"]).withColumn("target", F.struct("grp", F.col("target").alias("backbone"), "base"))
    pairs = D.pair_band(c, *rules.product).select("target.grp", "target.backbone", "target.base", "fwd", "rev", "f_pos", "r_end", "bp")
    pairs = pairs.join(loci.withColumnRenamed("seq_id", "backbone"), "backbone", "left")
    outside = F.coalesce((F.col("f_pos") >= F.col("hi")) | (F.col("r_end") <= F.col("lo")), F.lit(False))
    pairs = pairs.where(F.col("base") == F.when(outside, "long").otherwise("all")).drop("lo", "hi")
    # a window stands in the few cells it covers, a pair in the one it starts in
    w = D.locus_windows(back, "seq_id", rules.width, rules.step, rules.shortest).select(F.col("seq_id").alias("backbone"), "window", "start", "end")
    w = w.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / rules.step), F.floor((F.col("end") - 1) / rules.step))))
    p = pairs.withColumn("cell", F.floor(F.col("f_pos") / rules.step)).join(w, ["backbone", "cell"]).where("f_pos >= start and r_end <= end")
    return cut_lineage(p.drop("cell", "start", "end").withColumn("rivals", F.lit(None).cast("long"))), marks


def window_candidates(seqs: DataFrame, back: DataFrame, loci: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The best pairs of each window: grp, backbone, window, fwd, rev, f_pos, r_end, bp, base, rivals, rank.

    seqs: (seq_id, grp, long, seq), strands as given; back: ``backbones``; loci: (seq_id, lo, hi), the marked locus of a backbone (none: nothing
    is outside).
    """
    need = member_masks(seqs)
    if rules.max_mm or not seqs.where(F.col("seq").rlike("[^ACGTN]")).isEmpty():
        need = cut_lineage(need)
        pairs, marks = marked_pairs(seqs, back, loci, need, rules)
        unsure = pairs
    else:
        packs = cut_lineage(oligo_packs(back, shared_windows(seqs, back, rules), loci, rules))
        pairs = cut_lineage(ranked_pairs(packs, outside_lists(seqs, packs, rules), rules))
        unsure, marks = pairs.where("rivals is null"), None
    if marks is not None or not unsure.isEmpty():
        if marks is None:
            marks = cut_lineage(binding_masks(G.oligo_sites(seqs, unsure.select(F.explode(F.array("fwd", "rev")).alias("oligo")).distinct(), rules)))
        counted = shared_competitors(unsure, marks, need).withColumnRenamed("rivals", "more")
        pairs = pairs.join(counted, ["grp", "fwd", "rev"], "left").withColumn("rivals", F.coalesce("rivals", "more")).drop("more")
    pairs = pairs.withColumn("rivals", F.coalesce("rivals", F.lit(0).cast("long")))
    order = [F.col("rivals"), F.col("bp") > rules.short, F.col("bp"), F.col("fwd"), F.col("rev"), F.col("f_pos")]
    return top_n(pairs, ["grp", "backbone", "window"], order, rules.keep)


def worst_folds(pairs: DataFrame, reads: DataFrame, roles: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(grp, fwd, rev, base, member_bins, covered_bins, fold): the members' lowest bound over the worst competitor bin's highest.

    pairs: (grp, fwd, rev, base); reads: (read_id, bin, seq); roles: (grp, bin, role, long). Pairs of base "long" see the long bins only.
    Products are counted once for all groups that ask for a pair, and a group's bins come as one list.
    """
    asked = cut_lineage(pairs.select("grp", "fwd", "rev", "base").distinct().withColumn("id", F.monotonically_increasing_id()))
    two = cut_lineage(asked.select("fwd", "rev").distinct().withColumn("pair", F.monotonically_increasing_id()))
    oligos = two.select(F.explode(F.array("fwd", "rev")).alias("oligo")).distinct()
    found = cut_lineage(G.oligo_sites(reads.withColumnRenamed("read_id", "seq_id"), oligos, rules))
    made = G.pair_products(two.withColumn("grp", F.lit(0)), found, *rules.product).select("pair", F.col("seq_id").alias("read_id"))
    k = made.join(reads.select("read_id", "bin").where("bin is not null"), "read_id").groupBy("pair", "bin").agg(F.count(F.lit(1)).alias("k"))
    k = k.groupBy("pair").agg(F.map_from_entries(F.collect_list(F.struct("bin", "k"))).alias("ks"))
    n = reads.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    bins = roles.join(n, "bin").groupBy("grp").agg(F.collect_list(F.struct("bin", "role", "long", "n")).alias("bins"))
    asked_k = asked.join(two, ["fwd", "rev"]).select("grp", "base", "id", "pair").join(k, "pair", "left").join(bins, "grp")
    seen = F.explode(F.filter("bins", lambda x: (F.col("base") == "all") | x["long"])).alias("b")
    rates = asked_k.select(F.col("id").alias("pair"), "ks", seen).select(
        "pair", "b.bin", F.coalesce(F.try_element_at("ks", F.col("b.bin")), F.lit(0)).alias("k"), "b.n", "b.role")
    sep = M.separation(rates, None, rules.min_reads)
    return asked.join(sep.select(F.col("pair").alias("id"), "member_bins", "covered_bins", F.col("fold_worst").alias("fold")), "id").drop("id")


def window_designs(seqs: DataFrame, reads: DataFrame, roles: DataFrame, loci: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per window of every backbone: its limits, the pairs measured (``candidates``) and the winner, null where no pair passes.

    The winner has the highest worst fold; a fold that was not measured comes last, ties go to the better candidate.
    """
    back = cut_lineage(backbones(seqs, rules.ratio, rules.shortest))
    best = cut_lineage(window_candidates(seqs, back, loci, rules))
    m = best.join(worst_folds(best, reads, roles, rules), ["grp", "fwd", "rev", "base"], "left")
    key = ["grp", "backbone", "window"]
    n = m.groupBy(*key).agg(F.count(F.lit(1)).alias("candidates"))
    won = top_n(m.withColumnRenamed("rank", "place"), key, [F.desc_nulls_last("fold"), F.col("place")], 1).drop("rank", "place")
    w = D.locus_windows(back, "seq_id", rules.width, rules.step, rules.shortest).select(F.col("seq_id").alias("backbone"), "window", "start", "end")
    w = back.select("grp", F.col("seq_id").alias("backbone")).join(w, "backbone")
    return w.join(n, key, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0).cast("long"))).join(won, key, "left")
