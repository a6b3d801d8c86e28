"""One primer pair for a whole group of members (OPT-04).

A group's oligos come from its anchor. Every sequence is searched once for all oligos of all groups; the members an oligo or a
pair reaches are bits of a mask, joined by a bitwise aggregate, so "in every member" is one comparison per mask word and
"in no competitor" an anti-join. Competitors of a group are all sequences outside of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import seq as S
from ..session import cut_lineage
from . import design as D
from . import sites
from .ranking import top_n

#: Bits of a mask word; larger groups have more words.
WORD = 63
#: Mismatches an oligo without any site in a competitor counts for.
NOWHERE = 99
#: Bases of a group's members that one task compares with the anchor; members whose products one task measures, and products it holds at once.
PART, SHARE, HELD = 1 << 22, 20_000, 1 << 20


@dataclass(frozen=True)
class Rules:
    """How oligos bind and which pairs are accepted; fixed values of the published rule."""

    lengths: tuple[int, int] = P.OLIGO_LENGTH
    max_mm: int = 3
    exact_tail: int = 2
    product: tuple[int, int] = (60, 400)
    rival_product: tuple[int, int] = (40, 600)
    tm_best: tuple[int, int] = (58, 62)
    product_best: tuple[int, int] = (60, 150)
    dtm: float = P.PAIR_DTM_MAX
    orphan_mm: int = NOWHERE  # one primer's best site in competitors has at least so many mismatches
    slices: int = 40  # the best oligo of each positional slice of the anchor and direction
    keep: int = 5  # pairs reported per group


def member_bits(members: DataFrame) -> DataFrame:
    """(grp, seq_id, word, bit): every member's place in its group's mask. members: (grp, seq_id)."""
    no = F.row_number().over(Window.partitionBy("grp").orderBy("seq_id")) - 1
    return members.select("grp", "seq_id").withColumn("no", no).select(
        "grp", "seq_id", F.floor(F.col("no") / WORD).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(no % {WORD} AS int))").alias("bit"))


def full_masks(bits: DataFrame) -> DataFrame:
    """(grp, word, whole, words): the mask of all members, word by word."""
    w = bits.groupBy("grp", "word").agg(F.bit_or("bit").alias("whole"))
    return w.join(w.groupBy("grp").agg(F.count(F.lit(1)).alias("words")), "grp")


def in_every_member(reached: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` (grp among them) whose ``reached`` members (keys, word, bit) are all members of the group."""
    m = reached.groupBy(*keys, "word").agg(F.bit_or("bit").alias("mask"))
    return (m.join(masks, ["grp", "word"]).where("mask = whole").groupBy(*keys, "words").agg(F.count(F.lit(1)).alias("n"))
            .where("n = words").select(*keys))


def anchors(seqs: DataFrame) -> DataFrame:
    """(target, seq): of each group the member with the fewest N, then the longest, then the first."""
    n = F.length("seq") - F.length(F.replace(F.col("seq"), F.lit("N"), F.lit("")))
    return seqs.where("grp is not null").groupBy(F.col("grp").alias("target")).agg(
        F.min_by("seq", F.struct(n, -F.length("seq"), F.col("seq_id"))).alias("seq"))


def oligo_sites(seqs: DataFrame, oligos: DataFrame, rules: Rules) -> DataFrame:
    """(oligo, seq_id, strand, start, len, mm): sites of oligos on either strand, starts on the given strand."""
    both = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.lit("L").alias("side"), F.col("oligo").alias("pattern")),
                             F.struct(F.lit("-").alias("strand"), F.lit("R").alias("side"), S.revcomp("oligo").alias("pattern"))))
    pats = oligos.select(F.col("oligo").alias("pair"), both.alias("x")).select("pair", "x.*")
    of = seqs.select(F.col("seq_id").alias("read_id"), "seq")
    found = sites.scan_sites(of, pats, rules.max_mm, rules.exact_tail) if rules.max_mm else sites.word_sites(of, pats, rules.lengths)
    return found.select(F.col("pair").alias("oligo"), F.col("read_id").alias("seq_id"), "strand", "start", F.col("site_len").alias("len"), "mm")


def texts_of(seqs: DataFrame) -> DataFrame:
    """(grp, seq_id, seq) as given; an id with several rows has each of their texts in each of their groups, and a missing id is left out."""
    own = seqs.where("seq_id is not null").select("grp", "seq_id", "seq")
    twice = own.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seq_id")
    if twice.isEmpty():
        return own
    again = own.join(twice, "seq_id", "left_semi").withColumnRenamed("grp", "home")
    more = again.select("seq_id", F.col("home").alias("grp")).distinct().join(again, "seq_id").where(~F.col("home").eqNullSafe(F.col("grp")))
    return own.unionByName(more.select("grp", "seq_id", "seq"))


def shared_places(texts: DataFrame, backs: DataFrame, rules: Rules) -> DataFrame:
    """(grp, bits): which windows of an anchor all members of a part of its group have on either strand, the shortest windows first.

    texts: ``texts_of``, of A, C, G, T and N only. A group of more than ``PART`` bases has several parts, each of which meets the anchor.
    """
    m = texts.where("grp is not null")
    hot = m.groupBy("grp").agg(F.sum(F.length("seq")).alias("n")).where(F.col("n") > PART)
    hot = F.broadcast(hot.select("grp", F.ceil(F.col("n") / PART).alias("parts")))  # one row for PART bases at most
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    m = m.join(hot, "grp", "left").select("grp", F.pmod(F.xxhash64("seq_id"), parts).alias("part"), "seq_id", "seq")
    b = backs.withColumnRenamed("target", "grp").join(hot, "grp", "left").select("grp", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "seq")
    sizes = D.oligo_sizes(rules.lengths)

    def meet(members: pa.Table, own: pa.Table) -> pa.Table:
        back = own.column("seq")[0].as_py() if own.num_rows else None
        if back is None:
            return pa.table({"grp": own.column("grp").slice(0, 0), "bits": pa.array([], pa.binary())})
        of: dict = {}
        for name, seq in zip(members.column("seq_id").to_pylist(), members.column("seq").to_pylist()):
            of.setdefault(name, set()).add(seq or "")
        distinct = {frozenset(x) for x in of.values()}
        bits = []
        for size in sizes:
            _, words, known = D.packed_words(back, size)
            turned = sites.turned(words, np.full(words.size, size))
            sought, place = np.unique(np.minimum(words, turned), return_inverse=True)
            every = known.copy()
            for some in distinct if sought.size else ():
                hit = np.zeros(sought.size, bool)
                for seq in some:
                    _, have, ok = D.packed_words(seq, size)
                    have = have[ok]
                    have = np.minimum(have, sites.turned(have, np.full(have.size, size)))
                    at = np.minimum(np.searchsorted(sought, have), sought.size - 1)
                    hit[at[sought[at] == have]] = True
                every &= hit[place]
            bits.append(every)
        return pa.table({"grp": own.column("grp").slice(0, 1), "bits": pa.array([np.packbits(np.concatenate(bits)).tobytes()], pa.binary())})

    # few bytes, much work: dealt by number, which isn't put together again by bytes
    m = m.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "grp", "part")
    return m.groupBy("grp", "part").cogroup(b.groupBy("grp", "part")).applyInArrow(meet, f"grp {texts.schema['grp'].dataType.simpleString()}, bits binary")


def shared_candidates(seqs: DataFrame, texts: DataFrame, rules: Rules) -> DataFrame:
    """``design.candidates`` of the anchors that pass a grid cell and stand in every member: grp, pos, len, dir, tm, the packed word on the anchor's strand, and
    of it and its reverse complement the smaller one (both)."""
    lost = seqs.where("grp is not null and seq_id is null").select(F.col("grp").alias("target")).distinct()  # nothing is known to bind such a member
    backs = cut_lineage(anchors(seqs).join(lost, "target", "left_anti"))
    shared = shared_places(texts, backs, rules).groupBy("grp").agg(F.collect_list("bits").alias("bits"))
    # an anchor becomes thousands of oligos: the few rows are dealt first, by bytes they would all be one task
    rows = backs.select(F.col("target").alias("grp"), "seq").join(shared, "grp").repartition(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seq")
    sizes = D.oligo_sizes(rules.lengths)

    def deal(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in part:
            for i, (seq, bits) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                total, done = sum(max(0, len(seq) - k + 1) for k in sizes), 0
                every = np.bitwise_and.reduce([np.unpackbits(np.frombuffer(b, np.uint8), count=total) for b in bits]).astype(bool)
                for size in sizes:
                    code, words, known = D.packed_words(seq, size)
                    if not words.size:
                        continue
                    turned = sites.turned(words, np.full(words.size, size))
                    at = np.flatnonzero(every[done:done + words.size] & known & D.free_of_runs(code, size))
                    done += words.size
                    for way, (masks, tm) in zip("FR", D.window_measures(code, words, turned, at, size)):
                        pos, tm = at[masks != 0], D.two_digits(tm[masks != 0])
                        yield pa.RecordBatch.from_arrays([
                            batch.column(0).take(pa.array(np.full(pos.size, i))), pa.array(pos.astype(np.int32)), pa.array(np.full(pos.size, size, np.int32)),
                            pa.array([way] * pos.size, pa.string()), pa.array(tm), pa.array(words[pos]), pa.array(np.minimum(words, turned)[pos])],
                            ["grp", "pos", "len", "dir", "tm", "word", "both"])

    return rows.mapInArrow(deal, f"grp {seqs.schema['grp'].dataType.simpleString()}, pos int, len int, dir string, tm double, word long, both long")


def _either(rows: DataFrame, schema: str) -> DataFrame:
    """rows (any, site_len, word) with the smaller one of a word and its reverse complement."""
    def least(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in part:
            word, n = b.column(2).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.minimum(word, sites.turned(word, n)))], b.schema.names)

    return rows.mapInArrow(least, schema)


def exact_oligos(seqs: DataFrame, rules: Rules) -> DataFrame:
    """``universal_oligos`` of oligos without mismatches, over texts of A, C, G, T and N: the windows of an anchor that all members have are found where they
    meet it, and of each word only the first and the last group that has it, and whether a sequence of no group does, are asked for."""
    texts = texts_of(seqs)
    cand = cut_lineage(shared_candidates(seqs, texts, rules))
    twice = F.explode(F.array(F.lit(False), F.lit(True)))
    words = cand.select("len", "both").withColumn("back", twice).select("back", F.col("len").alias("site_len"), F.col("both").alias("word"))

    def ways(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in part:
            back, n, word = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(np.where(back, sites.turned(word, n), word))], ["word"])

    sketch = sites.word_sketch(words.mapInArrow(ways, "word long"))
    have = sites.held_words(texts.where("seq is not null").select(F.col("grp").alias("home"), "seq"), sketch, D.oligo_sizes(rules.lengths), once=True).drop("start")
    homes = _either(have, f"home {seqs.schema['grp'].dataType.simpleString()}, site_len int, word long").groupBy(F.col("site_len").alias("len"), F.col("word").alias("both")).agg(
        F.min("home").alias("first"), F.max("home").alias("last"), F.max(F.col("home").isNull()).alias("lone"))
    rival = F.col("lone") | (F.col("first") != F.col("grp")) | (F.col("last") != F.col("grp"))
    return cand.join(homes, ["len", "both"]).select("grp", "pos", "len", "dir", "word", "tm", F.lit(0).alias("worst"), F.when(rival, 0).otherwise(NOWHERE).alias("rival"))


def universal_oligos(cand: DataFrame, found: DataFrame, seqs: DataFrame, bits: DataFrame, masks: DataFrame) -> DataFrame:
    """The candidates that bind every member, with ``worst`` (mismatches in the weakest member) and ``rival`` (in the nearest competitor, or ``NOWHERE``).

    Of an oligo only the two nearest groups are asked for (no group is one of them): one of them is not its own. So an oligo that many groups and
    sequences have isn't joined with all of them.
    """
    best = found.groupBy("oligo", "seq_id").agg(F.min("mm").alias("mm")).join(seqs.select("seq_id", F.col("grp").alias("home")), "seq_id")
    own = best.where("home is not null").withColumnRenamed("home", "grp").join(cand.select("grp", "oligo").distinct(), ["grp", "oligo"], "left_semi")
    every = in_every_member(own.join(bits, ["grp", "seq_id"]), masks, ["grp", "oligo"])
    worst = own.groupBy("grp", "oligo").agg(F.max("mm").alias("worst"))
    near = top_n(best.groupBy("oligo", "home").agg(F.min("mm").alias("mm")), ["oligo"], [F.col("mm"), F.col("home")], 2)
    near = near.groupBy("oligo").agg(F.array_sort(F.collect_list(F.struct("rank", "mm", "home"))).alias("near"))
    rival = F.get(F.filter("near", lambda x: ~x["home"].eqNullSafe(F.col("grp"))), F.lit(0))["mm"]
    return (cand.join(every, ["grp", "oligo"]).join(worst, ["grp", "oligo"]).join(near, "oligo", "left")
            .withColumn("rival", F.coalesce(rival, F.lit(NOWHERE))).drop("near"))


def pair_products(pairs: DataFrame, found: DataFrame, lo: int, hi: int) -> DataFrame:
    """(grp, pair, seq_id, bp): the shortest product of each pair in each sequence, in either orientation."""
    f = found.select(F.col("oligo").alias("fwd"), "seq_id", F.col("strand").alias("fs"), F.col("start").alias("fp"), F.col("len").alias("fl"))
    r = found.select(F.col("oligo").alias("rev"), "seq_id", F.col("strand").alias("rs"), F.col("start").alias("rp"), F.col("len").alias("rl"))
    bp = F.when(F.col("fs") == "+", F.col("rp") + F.col("rl") - F.col("fp")).otherwise(F.col("fp") + F.col("fl") - F.col("rp"))
    j = pairs.select("grp", "pair", "fwd", "rev").join(f, "fwd").join(r, ["rev", "seq_id"]).where("fs <> rs").withColumn("bp", bp)
    return j.where(F.col("bp").between(lo, hi)).groupBy("grp", "pair", "seq_id").agg(F.min("bp").alias("bp"))


def own_products(pairs: DataFrame, found: DataFrame, seqs: DataFrame, rules: Rules) -> DataFrame:
    """(grp, pair, members, bp_min, bp_max, bp_avg) of the pairs with a product in every member: the shortest product of each, in either orientation.

    The sites of a group's members meet its pairs in one task (``SHARE`` members at most), which gives back a row per pair. Sites outside of the group take no part.
    """
    lo, hi = min(rules.product[0], rules.rival_product[0]), max(rules.product[1], rules.rival_product[1])
    m = seqs.where("grp is not null")
    size = m.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    hot = F.broadcast(size.where(F.col("size") > SHARE).select("grp", F.ceil(F.col("size") / SHARE).alias("parts")))  # one row for SHARE members at most
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    m = m.groupBy("grp", "seq_id").agg(F.count(F.lit(1)).alias("copies")).join(hot, "grp", "left").withColumn("part", F.pmod(F.xxhash64("seq_id"), parts)).drop("parts")
    used = pairs.select("grp", F.explode(F.array("fwd", "rev")).alias("oligo")).distinct()
    s = found.join(m, "seq_id").join(used, ["grp", "oligo"], "left_semi")
    s = s.select("grp", "part", "seq_id", "copies", "oligo", (F.col("strand") == "+").alias("plus"), F.col("start").cast("long").alias("start"), F.col("len").cast("long").alias("len"))
    p = pairs.join(hot, "grp", "left").select("grp", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "pair", "fwd", "rev")

    def measure(sites_of: pa.Table, own: pa.Table) -> pa.Table:
        n = own.num_rows
        if not n or not sites_of.num_rows:
            return pa.table({"grp": own.column("grp").slice(0, 0), "pair": own.column("pair").slice(0, 0), **{c: pa.array([], pa.int64()) for c in ("n", "least", "most", "total")}})
        oligos = {o: i for i, o in enumerate(dict.fromkeys(own.column("fwd").to_pylist() + own.column("rev").to_pylist()))}
        fwd, rev = (np.array([oligos[o] for o in own.column(c).to_pylist()], dtype=np.int64) for c in ("fwd", "rev"))
        ids = sites_of.column("seq_id").combine_chunks().dictionary_encode()
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        member = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        many = len(ids.dictionary)
        copies = np.zeros(many, np.int64)
        copies[member] = sites_of.column("copies").to_numpy()
        oligo = np.array([oligos[o] for o in sites_of.column("oligo").to_pylist()], dtype=np.int64)
        plus, start, length = (sites_of.column(c).to_numpy() for c in ("plus", "start", "len"))
        order = np.lexsort((start, member, oligo))
        oligo, member, plus, start, length = (x[order] for x in (oligo, member, plus, start, length))
        size_of = np.zeros(len(oligos), np.int64)
        size_of[oligo] = length
        sides = []
        for on in (plus, ~plus):
            o, x, at = oligo[on], member[on], start[on]
            sides.append((x, at, ((o * many + x) << 31) + at, np.searchsorted(o, np.arange(len(oligos) + 1))))
        out = np.zeros((4, n), np.int64)
        weight = np.maximum(sum(np.diff(sides[0][3])[x] for x in (fwd, rev)), 1)
        cuts = np.searchsorted(np.cumsum(weight), np.arange(HELD, weight.sum() + HELD, HELD), side="right")
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n]):
            b = min(n, max(b, a))
            rows = [np.empty(0, np.int64)] * 3
            for left, right in ((fwd[a:b], rev[a:b]), (rev[a:b], fwd[a:b])):  # the left one on the given strand, the right one's end on the other
                x, at, _, edge = sides[0]
                _, after, keys, _ = sides[1]
                per = edge[left + 1] - edge[left]
                pair = np.repeat(np.arange(b - a), per)
                site = np.arange(per.sum()) + np.repeat(edge[left] - np.cumsum(per) + per, per)
                if not site.size or not keys.size:
                    continue
                o, who = right[pair], x[site]
                low = np.maximum(at[site] + lo - size_of[o], 0)
                i = np.searchsorted(keys, ((o * many + who) << 31) + low)
                ok = i < keys.size
                i = np.minimum(i, keys.size - 1)
                bp = after[i] + size_of[o] - at[site]
                ok &= ((keys[i] >> 31) == o * many + who) & (bp <= hi)
                rows = [np.concatenate(y) for y in zip(rows, (pair[ok], who[ok], bp[ok]))]
            pair, who, bp = rows
            o = np.lexsort((bp, who, pair))
            pair, who, bp = pair[o], who[o], bp[o]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(who) != 0)])[:pair.size])
            pair, who, bp = pair[first], who[first], bp[first]
            use = (bp >= rules.product[0]) & (bp <= rules.product[1])
            pair, who, bp = pair[use] + a, who[use], bp[use]
            np.add.at(out[0], pair, copies[who])
            np.add.at(out[3], pair, bp * copies[who])
            out[1, pair[::-1]] = bp[::-1]
            out[2, pair] = bp
            np.minimum.at(out[1], pair, bp)
            np.maximum.at(out[2], pair, bp)
        some = out[0] > 0
        table = pa.table({"grp": own.column("grp"), "pair": own.column("pair"), **{c: pa.array(x) for c, x in zip(("n", "least", "most", "total"), out)}})
        return table.filter(pa.array(some))

    s = s.repartition(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "grp", "part")
    kind = {c: pairs.schema[c].dataType.simpleString() for c in ("grp", "pair")}
    r = s.groupBy("grp", "part").cogroup(p.groupBy("grp", "part")).applyInArrow(measure, f"grp {kind['grp']}, pair {kind['pair']}, n long, least long, most long, total long")
    r = r.groupBy("grp", "pair").agg(F.sum("n").alias("members"), F.min("least").cast("int").alias("bp_min"), F.max("most").cast("int").alias("bp_max"), F.sum("total").alias("total"))
    return r.join(size, "grp").where("members = size").withColumn("bp_avg", F.col("total") / F.col("members")).drop("size", "total")


def beyond(value, lo: float, hi: float):
    """How far a value lies outside of a range."""
    return F.greatest(F.lit(lo) - value, value - F.lit(hi), F.lit(0.0))


def prepared(seqs: DataFrame, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(pairs, sites, bits, masks) of the groups: candidate pairs of universal oligos, and all sites of those oligos.

    seqs: (seq_id, grp, seq); grp is null for sequences of no group.
    """
    bits = member_bits(seqs.where("grp is not null"))
    masks = full_masks(bits)
    exact = not rules.max_mm and max(D.oligo_sizes(rules.lengths), default=0) <= 31 and seqs.where(F.col("seq").rlike("[^ACGTN]")).isEmpty()
    if exact:
        u = exact_oligos(seqs, rules)
        text = F.translate(F.lpad(F.conv("word", 10, 4), F.col("len"), "0"), "0123", "ACGT")
        u = u.withColumn("oligo", F.when(F.col("dir") == "F", text).otherwise(S.revcomp(text))).drop("word")
    else:
        # an anchor becomes thousands of oligos with temperatures: the few rows are dealt first, by bytes they would all be one task
        dealt = anchors(seqs).repartition(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seq")
        cand = cut_lineage(D.candidates(dealt, rules.lengths).where("pm <> 0").withColumnRenamed("target", "grp").drop("pm", "gc"))
        found = cut_lineage(oligo_sites(seqs, cand.select("oligo").distinct(), rules))
        u = universal_oligos(cand, found, seqs, bits, masks)
    mid = sum(rules.tm_best) / 2
    order = [F.desc("rival"), F.abs(F.col("tm") - mid), F.col("pos"), F.col("len"), F.col("oligo")]
    u = u.withColumn("side", F.concat_ws(" ", F.col("grp").cast("string"), "dir"))
    u = cut_lineage(D.stratified_pick(u, "side", "pos", rules.slices, order))
    used = u.select("oligo").distinct()
    found = cut_lineage(oligo_sites(seqs, used, rules)) if exact else found.join(used, "oligo", "left_semi")
    f = u.where("dir = 'F'").select("grp", F.col("pos").alias("f_pos"), F.col("len").alias("f_len"), F.col("oligo").alias("fwd"), F.col("tm").alias("f_tm"),
                                    F.col("worst").alias("f_worst"), F.col("rival").alias("f_rival"))
    r = u.where("dir = 'R'").select("grp", F.col("pos").alias("r_pos"), (F.col("pos") + F.col("len")).alias("r_end"), F.col("oligo").alias("rev"), F.col("tm").alias("r_tm"),
                                    F.col("worst").alias("r_worst"), F.col("rival").alias("r_rival"))
    pairs = f.join(r, "grp").where((F.col("r_end") - F.col("f_pos")).between(*rules.product) & (F.col("r_pos") >= F.col("f_pos") + F.col("f_len"))
                                   & (F.round(F.abs(F.col("f_tm") - F.col("r_tm")), 2) <= rules.dtm))
    pairs = pairs.withColumn("pair", F.concat_ws("-", "f_pos", "f_len", "r_pos", "r_end"))
    return cut_lineage(pairs), found, bits, masks


def group_pairs(seqs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The best pairs of every group: a product in every member, none in a competitor, and one primer that no competitor has."""
    seqs = cut_lineage(seqs.select("seq_id", "grp", "seq"))
    pairs, found, _, _ = prepared(seqs, rules)
    pairs = pairs.where(F.greatest("f_rival", "r_rival") >= rules.orphan_mm)
    ok = pairs.join(own_products(pairs, found, seqs, rules), ["grp", "pair"])
    if rules.orphan_mm < NOWHERE:  # a primer without any site in a competitor has no product there
        lo, hi = min(rules.product[0], rules.rival_product[0]), max(rules.product[1], rules.rival_product[1])
        made = pair_products(pairs.where(F.greatest("f_rival", "r_rival") < NOWHERE), found, lo, hi).join(seqs.select("seq_id", F.col("grp").alias("home")), "seq_id")
        rivals = made.where(F.col("bp").between(*rules.rival_product) & ~F.col("home").eqNullSafe(F.col("grp"))).select("grp", "pair").distinct()
        ok = ok.join(rivals, ["grp", "pair"], "left_anti")
    penalty = (F.abs(F.col("f_tm") - F.col("r_tm")) + 0.02 * (F.col("bp_max") - F.col("bp_min"))
               + 2.0 * (beyond(F.col("f_tm"), *rules.tm_best) + beyond(F.col("r_tm"), *rules.tm_best))
               + 0.05 * beyond(F.col("bp_avg"), *rules.product_best) + 0.5 * (F.col("f_worst") + F.col("r_worst")))
    orphan = F.when(F.least("f_rival", "r_rival") >= rules.orphan_mm, "both").when(F.col("f_rival") >= rules.orphan_mm, "forward").otherwise("reverse")
    ok = ok.withColumn("penalty", F.round(penalty, 3)).withColumn("orphan", orphan)
    return top_n(ok, ["grp"], [F.col("penalty"), F.col("f_pos"), F.col("r_pos"), F.col("fwd"), F.col("rev")], rules.keep)


def supports(seqs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(grp, pair, seq_id): which candidate pair works in which member; what splitting a group starts from (GRF-07)."""
    seqs = cut_lineage(seqs.select("seq_id", "grp", "seq"))
    pairs, found, _, _ = prepared(seqs, rules)
    return pair_products(pairs, found, *rules.product).join(seqs.select("seq_id", "grp"), ["seq_id", "grp"], "left_semi").select("grp", "pair", "seq_id")
