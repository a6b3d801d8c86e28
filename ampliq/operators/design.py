"""Primer search: candidates, pair band join, parameter grid, selection
(AGG-09, AGG-10, JOIN-12, WIN-01..03, DEC-17..19, OPT-01, OPT-02, OPT-05, THR-03, THR-05)."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import predicates as X
from ..functions import seq as S
from ..functions import thermo as T
from . import kmers as K
from . import sites
from .ranking import top_n

PRIMER_CELLS = [(g, t, e, s) for g in P.GRID_GC for t in P.GRID_TM for e in P.GRID_END_GC for s in P.GRID_LAST5]


def strictness(cell, product_index: int) -> int:
    """0 is the strictest cell of the grid."""
    g, t, e, s = cell
    return P.GRID_GC.index(g) + P.GRID_TM.index(t) + product_index + (0 if e else 1) + (0 if s else 1)


def grid_cells(spark) -> DataFrame:
    """The 144 cells: primer bit, product bit, limits, strictness."""
    rows = [(pi, ui, c[0][0], c[0][1], c[1][0], c[1][1], u[0], u[1], c[2], c[3], strictness(c, ui))
            for ui, u in enumerate(P.GRID_PRODUCT) for pi, c in enumerate(PRIMER_CELLS)]
    return spark.createDataFrame(rows, "primer_bit int, product_bit int, gc_lo int, gc_hi int, tm_lo int, tm_hi int, "
                                       "bp_lo int, bp_hi int, end_gc boolean, last5 boolean, strictness int")


def candidates(backbones: DataFrame, lengths: tuple[int, int] = P.OLIGO_LENGTH) -> DataFrame:
    """Oligo windows with their measurements (SEQ-13, THR-05), invariant rules applied (FLT-02).

    backbones: (target, seq). Cheap string rules run before temperatures.
    """
    w = K.windows(backbones, *lengths, keep=["target"]).where(X.invariant_oligo_ok("oligo"))
    return w.withColumn("m", measures("oligo")).select("target", "pos", "len", "dir", "oligo", "m.gc", "m.tm", "m.pm")


def measures(oligo: str) -> Column:
    """struct(gc, tm, pm) of an oligo; pm is the 36-bit mask of the grid cells it passes.

    Built as one expression, so a filter on the mask does not repeat the temperature model
    for every cell.
    """
    base = F.struct(F.round(S.gc_percent(oligo), 1).alias("gc"), F.round(T.melting_temperature(oligo), 2).alias("tm"),
                    S.last_base(oligo).isin("G", "C").alias("e"), (S.gc_in_last5(oligo) <= 3).alias("l"))

    def build(m):
        mask = F.lit(0).cast("long")
        for i, (g, t, end_gc, last5) in enumerate(PRIMER_CELLS):
            ok = m["gc"].between(*g) & m["tm"].between(*t)
            ok = ok & m["e"] if end_gc else ok
            ok = ok & m["l"] if last5 else ok
            mask = mask.bitwiseOR(F.when(ok, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
        return F.struct(m["gc"].alias("gc"), m["tm"].alias("tm"), mask.alias("pm"))

    return S.let(base, build)


def packed_words(seq: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, words, known): the bases, the packed words of k bases at every position, and which of them hold A, C, G and T only."""
    code = sites._PLAIN[np.frombuffer(seq.encode(), dtype=np.uint8)]
    away = np.concatenate([[0], np.cumsum(code > 3)])
    code = np.where(code > 3, 0, code)
    return code, sites._words(code, k), (away[k:] == away[:-k]) if code.size >= k else np.empty(0, bool)


def oligo_sizes(lengths: tuple[int, int]) -> range:
    """The lengths that an oligo may have."""
    return range(max(lengths[0], P.OLIGO_LENGTH[0]), min(lengths[1], P.OLIGO_LENGTH[1]) + 1)


def free_of_runs(code: np.ndarray, size: int) -> np.ndarray:
    """Which windows of ``size`` bases hold no run of four."""
    run = (code[:-3] == code[1:-2]) & (code[1:-2] == code[2:-1]) & (code[2:-1] == code[3:])
    runs = np.concatenate([[0], np.cumsum(run)])
    return runs[size - 3:] == runs[:-(size - 3)]


def grid_masks(code: np.ndarray, words: np.ndarray, back: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The grid cells (``measures``) that the windows at ``at`` pass, read forward and as their reverse complements."""
    return tuple(mask for mask, _ in window_measures(code, words, back, at, size))


def two_digits(x: np.ndarray) -> np.ndarray:
    """Positive values rounded half up to two digits, as ``round`` does it on their decimal form."""
    low = np.floor(x * 100)
    part = x * 100 - low
    out = (low + (part >= 0.5)) / 100
    for i in np.flatnonzero(np.abs(part - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.01"), ROUND_HALF_UP))
    return out


def window_measures(code: np.ndarray, words: np.ndarray, back: np.ndarray, at: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mask, temperature) of the windows at ``at``, read forward and as their reverse complements; code, words: of the sequence, back: words turned.

    Sums run in the order of the oligo, as in ``thermo``; a rounded value lies in a range if it lies between the range's rounding limits.
    """
    r = P.Reaction()
    pair = code[:-1] * 4 + code[1:]
    table = np.array([T.ALL_STACKS[x + y] for x in "ACGT" for y in "ACGT"])
    strong = (code == 1) | (code == 2)
    before = np.concatenate([[0], np.cumsum(strong)])
    share = np.array([float(Decimal(repr(100.0 * i / size)).quantize(Decimal("0.1"), ROUND_HALF_UP)) for i in range(size + 1)])[before[at + size] - before[at]]
    first, last = strong[at], strong[at + size - 1]
    same = words[at] == back[at]
    conc = T.GAS * np.log(np.where(same, r.oligo_nm * 1e-9, r.oligo_nm * 1e-9 / 4.0))
    salt = 0.368 * np.log(T.monovalent_equivalent(r))
    out = []
    for steps, end, tail in ((range(size - 1), last, before[at + size] - before[at + size - 5]), (range(size - 2, -1, -1), first, before[at + 5] - before[at])):
        h, s = np.zeros(at.size), np.zeros(at.size)
        for i in steps:
            p = pair[at + i]
            h += table[p, 0]
            s += table[p, 1]
        h += np.where(first, T.END_GC[0], T.END_AT[0]) + np.where(last, T.END_GC[0], T.END_AT[0])
        s += np.where(first, T.END_GC[1], T.END_AT[1]) + np.where(last, T.END_GC[1], T.END_AT[1])
        s += np.where(same, T.SYMMETRY[1], 0.0)
        tm = 1000.0 * h / (s + salt * (size - 1) + conc) - 273.15
        mask = np.zeros(at.size, np.int64)
        for i, (g, t, end_gc, last5) in enumerate(PRIMER_CELLS):
            ok = (share >= g[0]) & (share <= g[1]) & (tm >= float(f"{t[0] - 0.005:.3f}")) & (tm < float(f"{t[1] + 0.005:.3f}"))
            ok &= end if end_gc else True
            ok &= (tail <= 3) if last5 else True
            mask |= ok.astype(np.int64) << i
        out.append((mask, tm))
    return out


def product_mask(bp) -> Column:
    b = F.col(bp) if isinstance(bp, str) else bp
    mask = F.lit(0)
    for i, (lo, hi) in enumerate(P.GRID_PRODUCT):
        mask = mask.bitwiseOR(F.when(b.between(lo, hi), 1 << i).otherwise(0))
    return mask


def pair_band(cand: DataFrame, lo: int = P.PRODUCT_IDEAL[0], hi: int = P.PRODUCT_MAX) -> DataFrame:
    """Forward x reverse pairs with the reverse end inside the band (JOIN-12).

    A band join on (target, bucket): a reverse oligo sits in one ``width``-wide bucket by its
    end, a forward oligo meets the few buckets its band covers. Pairs sharing no grid cell are
    dropped in the join. The few input rows expand to millions of pairs, so both sides are
    given a fixed number of partitions: by input size alone they would end up in one task.
    """
    width = max((hi - lo) // 4, 1)
    n = int(cand.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = cand.where("pm <> 0")
    f = c.where("dir = 'F'").select("target", F.col("pos").alias("f_pos"), F.col("len").alias("f_len"), F.col("oligo").alias("fwd"),
                                    F.col("tm").alias("f_tm"), F.col("pm").alias("f_pm"),
                                    F.explode(F.sequence(F.floor((F.col("pos") + lo) / width), F.floor((F.col("pos") + hi) / width))).alias("cell"))
    r = c.where("dir = 'R'").select("target", F.col("pos").alias("r_pos"), (F.col("pos") + F.col("len")).alias("r_end"),
                                    F.col("oligo").alias("rev"), F.col("tm").alias("r_tm"), F.col("pm").alias("r_pm"),
                                    F.floor((F.col("pos") + F.col("len")) / width).alias("cell"))
    f, r = f.repartition(n, "target", "cell"), r.repartition(n, "target", "cell")
    bp = F.col("r_end") - F.col("f_pos")
    j = f.join(r, ["target", "cell"]).where(bp.between(lo, hi) & (F.col("r_pos") >= F.col("f_pos") + F.col("f_len"))
                                           & (F.col("f_pm").bitwiseAND(F.col("r_pm")) != 0))
    return j.select("target", "f_pos", "fwd", "f_tm", "r_end", "rev", "r_tm", bp.alias("bp"),
                    F.col("f_pm").bitwiseAND(F.col("r_pm")).alias("pm"), product_mask(bp).alias("um"))


def grid_counts(pairs: DataFrame) -> DataFrame:
    """Surviving pairs per grid cell in one pass (AGG-09).

    Pairs collapse to (target, mask, mask) counts before the 144-row cell table is joined,
    so the join input is the number of distinct masks, not of pairs.
    """
    m = pairs.groupBy("target", "pm", "um").agg(F.count(F.lit(1)).alias("n"))
    cells = F.broadcast(grid_cells(pairs.sparkSession))  # always 144 rows
    hit = F.expr("shiftright(pm, primer_bit) & 1L = 1") & F.expr("shiftright(um, product_bit) & 1 = 1")
    return m.join(cells, hit).groupBy("target", "primer_bit", "product_bit", "strictness").agg(F.sum("n").alias("survivors"))


_PRIMER_STRICTNESS = [strictness(c, 0) for c in PRIMER_CELLS]


def with_strictest_cell(pairs: DataFrame) -> DataFrame:
    """Adds strictness, pi, ui of the strictest cell a pair survives in; NULL when none.

    Strictness is the primer part plus the product index, so at each level the candidate
    primer bits are one mask, the first of them is its lowest set bit, and the product index
    is the difference. Plain integer arithmetic: it stays inside generated code.
    """
    p, u = F.col("pm"), F.col("um")
    allowed = []
    for level in range(max(_PRIMER_STRICTNESS) + len(P.GRID_PRODUCT)):
        mask = F.lit(0).cast("long")
        for ui in range(len(P.GRID_PRODUCT)):
            bits = sum(1 << i for i, s in enumerate(_PRIMER_STRICTNESS) if s + ui == level)
            mask = mask.bitwiseOR(F.when(u.bitwiseAND(1 << ui) != 0, F.lit(bits).cast("long")).otherwise(F.lit(0).cast("long")))
        allowed.append(p.bitwiseAND(mask))
    level = F.coalesce(*[F.when(x != 0, level) for level, x in enumerate(allowed)])
    bits = F.coalesce(*[F.when(F.col("strictness") == level, x) for level, x in enumerate(allowed)])
    d = pairs.withColumn("strictness", level).withColumn("_x", bits)
    d = d.withColumn("pi", F.bit_count(F.col("_x").bitwiseAND(-F.col("_x")) - 1).cast("int")).drop("_x")
    return d.withColumn("ui", F.col("strictness") - F.element_at(F.array(*map(F.lit, _PRIMER_STRICTNESS)), F.col("pi") + 1))


def cell_representatives(pairs: DataFrame, per_cell: int = 6) -> DataFrame:
    """Pairs closest to the reference length in their strictest cell (AGG-10)."""
    p = with_strictest_cell(pairs).where("strictness IS NOT NULL").withColumn("cell", F.col("pi") * 10 + F.col("ui")).drop("pi", "ui")
    order = [F.abs(F.col("bp") - P.REPRESENTATIVE_BP), F.col("f_pos"), F.col("r_end"), F.col("fwd"), F.col("rev")]
    return top_n(p, ["target", "cell"], order, per_cell)


def round_robin(rows: DataFrame, key: str, cell: str, strict: str, order: list[Column], cap: int) -> DataFrame:
    """i-th best of every cell, cells by strictness, until ``cap`` rows per key (WIN-02)."""
    w = Window.partitionBy(key, cell).orderBy(*order)
    r = rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= cap)
    return top_n(r, [key], [F.col("turn"), F.col(strict), F.col(cell)], cap, rank="pick")


def candidate_order(rows: DataFrame, key: str) -> DataFrame:
    """Coverage, then covered fold, then raw fold, missing values last (WIN-01)."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last("coverage"), F.desc_nulls_last("fold_covered"), F.desc_nulls_last("fold"), F.col("pair"))
    return rows.withColumn("rank", F.row_number().over(w))


def stratified_pick(rows: DataFrame, key: str, pos: str, slices: int, order: list[Column]) -> DataFrame:
    """Best row of each positional slice (WIN-03)."""
    every = Window.partitionBy(key)
    s = rows.withColumn("_lo", F.min(pos).over(every)).withColumn("_hi", F.max(pos).over(every))
    s = s.withColumn("slice", F.floor((F.col(pos) - F.col("_lo")) * slices / (F.col("_hi") - F.col("_lo") + 1)))
    return top_n(s.where(F.col(key).isNotNull()), [key, "slice"], order, 1).drop("_lo", "_hi", "rank")


def tm_agreement(cand: DataFrame, key: list[str], tolerance: float | None = None, k: float = 2.0) -> DataFrame:
    """Keep oligos whose two temperatures agree after the systematic offset (THR-03)."""
    from .ranking import exact_median
    d = cand.withColumn("diff", F.round(F.col("tm") - F.col("tm2"), 6))
    med = exact_median(d, key, "diff").withColumnRenamed("median", "offset")
    sd = d.groupBy(*key).agg(F.stddev_pop("diff").alias("sd"))
    tol = F.lit(tolerance) if tolerance is not None else F.greatest(F.lit(0.10), k * F.col("sd"))
    return d.join(med, key).join(sd, key).where(F.abs(F.col("diff") - F.col("offset")) <= F.round(tol, 9))


def arms_variants(primers: DataFrame) -> DataFrame:
    """15 variants with a deliberate mismatch at the second and third base from the 3' end (DEC-18)."""
    bases = F.array(*map(F.lit, "ACGT"))
    v = primers.withColumn("b2", F.explode(bases)).withColumn("b3", F.explode(bases))
    n = F.length("oligo")
    o2, o3 = F.substring(F.col("oligo"), n - 1, F.lit(1)), F.substring(F.col("oligo"), n - 2, F.lit(1))
    v = v.where((n >= 4) & ((F.col("b2") != o2) | (F.col("b3") != o3)))
    variant = F.concat(F.substring(F.col("oligo"), F.lit(1), n - 3), "b3", "b2", F.right("oligo", F.lit(1)))
    label = F.concat_ws(" ", F.when(F.col("b3") != o3, F.concat(F.lit("-3:"), o3, F.lit(">"), F.col("b3"))),
                        F.when(F.col("b2") != o2, F.concat(F.lit("-2:"), o2, F.lit(">"), F.col("b2"))))
    return v.select(*primers.columns, variant.alias("variant"), label.alias("label"))


def discriminating_base(best: DataFrame, key: str) -> DataFrame:
    """Is the 3' base of a primer discriminating (DEC-17)?

    best: (key, role, exact BOOLEAN, mm): best mismatch counts with the terminal base exact or
    not; no row means no site.
    """
    g = best.groupBy(key).agg(
        F.min(F.when((F.col("role") == "member") & F.col("exact"), F.col("mm"))).alias("member"),
        F.min(F.when((F.col("role") == "competitor") & F.col("exact"), F.col("mm"))).alias("rival_exact"),
        F.min(F.when(F.col("role") == "competitor", F.col("mm"))).alias("rival_any"))
    ok = (F.col("member") <= 1) & F.col("rival_any").isNotNull() & (
        F.col("rival_exact").isNull() | (F.col("rival_exact") > F.col("rival_any")))
    return g.withColumn("discriminating", F.coalesce(ok, F.lit(False)))


# Two-base ambiguity codes.
TWO_BASE = {"AG": "R", "CT": "Y", "CG": "S", "AT": "W", "GT": "K", "AC": "M"}


def degenerate_primer(sites: DataFrame, key: str, tail: int = 3, max_variants: int = 4) -> DataFrame:
    """Two-base codes at the positions that gain the most member sites, 3' end fixed (DEC-19).

    sites: (key, oligo, site as the oligo reads it, on either strand). Counts per position and base are aggregated; the greedy step
    folds over the few positions of one oligo.
    """
    p = sites.select(key, "oligo", F.posexplode(F.split("site", "")).alias("k", "base")).where(F.col("base").isin(*"ACGT"))
    c = p.groupBy(key, "oligo", "k", "base").agg(F.count(F.lit(1)).alias("n"))
    own = F.substring(F.col("oligo"), F.col("k") + 1, F.lit(1))
    c = c.where((F.col("base") != own) & (F.col("k") < F.length("oligo") - tail))
    second = c.groupBy(key, "oligo", "k").agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("base"))).alias("m"))
    g = second.groupBy(key, "oligo").agg(F.array_sort(F.collect_list(F.struct(
        F.col("m.neg").alias("neg"), (-F.col("k")).alias("nk"), F.col("m.base").alias("base")))).alias("c"))
    table = F.create_map(*[F.lit(x) for kv in TWO_BASE.items() for x in kv])
    steps = max_variants.bit_length() - 1
    # the walk ends at the first position whose own base is a code already; changes before it stand
    bad = F.array_position(F.transform("c", lambda x: ~F.substring(F.col("oligo"), 1 - x["nk"], F.lit(1)).isin(*"ACGT")), True)
    count = F.when(bad > 0, F.least(bad - 1, F.lit(steps))).otherwise(F.lit(steps)).cast("int")
    out = F.aggregate(F.slice("c", F.lit(1), count), F.col("oligo"), lambda o, x: F.overlay(
        o, F.element_at(table, F.concat_ws("", F.array_sort(F.array(F.substring(o, 1 - x["nk"], F.lit(1)), x["base"])))),
        (1 - x["nk"]).cast("int"), F.lit(1)))
    every = sites.select(key, "oligo").distinct()
    return every.join(g.select(key, "oligo", out.alias("degenerate")), [key, "oligo"], "left").select(
        key, "oligo", F.coalesce("degenerate", "oligo").alias("degenerate"))


def gel_clashes(plate: DataFrame, key: str, min_gap: int = 10) -> DataFrame:
    """Pairs of products of one plate closer than the gel can separate (OPT-05).

    plate: (key, target, bp). A band join on gap-wide buckets instead of all pairs.
    """
    a = plate.select(key, F.col("target").alias("a"), F.col("bp").alias("bp_a"), F.explode(F.array(
        F.floor(F.col("bp") / min_gap) - 1, F.floor(F.col("bp") / min_gap), F.floor(F.col("bp") / min_gap) + 1)).alias("cell"))
    b = plate.select(key, F.col("target").alias("b"), F.col("bp").alias("bp_b"), F.floor(F.col("bp") / min_gap).alias("cell"))
    return a.join(b, [key, "cell"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("bp_a") - F.col("bp_b")) < min_gap)).select(
        key, "a", "b", "bp_a", "bp_b")


def locus_windows(seqs: DataFrame, key: str, width: int = 700, step: int = 300, shortest: int = 120) -> DataFrame:
    """Overlapping windows of a backbone in which primers are sought apart (OPT-02): key, window, start, end, seq.

    The last window ends with the sequence; one shorter than ``width`` is a window of its own.
    """
    n = F.length("seq")
    last = F.greatest(F.lit(0), n - width)
    count = F.greatest(F.lit(1), F.floor((n - width) / step).cast("int") + 2)
    w = seqs.select(key, "seq", last.alias("_last"), F.explode(F.sequence(F.lit(0), count - 1)).alias("window"))
    w = w.withColumn("start", F.least(F.col("window") * step, F.col("_last"))).withColumn("end", F.least(n, F.col("start") + width))
    return w.where(F.col("end") - F.col("start") >= shortest).select(
        key, "window", "start", "end", F.substring("seq", F.col("start") + 1, F.col("end") - F.col("start")).alias("seq"))


# Bases of the 3' end that must match, share of a site that must be filled, mismatches a product allows.
SITE_TAIL, SITE_FILLED, SITE_MISMATCHES = 3, 0.8, 1


def site_mismatch(site, primer) -> Column:
    """Mismatches of a primer on the bases a record has in its alignment columns (ALN-13). NULL where the site is too
    gappy to be tested or one of the last bases differs."""
    s, p = (F.col(c) if isinstance(c, str) else c for c in (site, primer))
    n = F.length(p)
    bad = S.mismatch_positions(S.primer_mask(p), S.template_mask(F.regexp_replace(s, "[^ACGT]", "N")), n)
    filled = F.length(F.regexp_replace(s, "[^ACGT]", "")) >= SITE_FILLED * n
    return F.when(filled & ~F.exists(bad, lambda i: i > n - SITE_TAIL), F.size(bad))


def coverage_by_genus(records: DataFrame, genus: str = "genus") -> DataFrame:
    """Records that could be tested and those that give a product, per genus (AGG-16). records: (genus, forward, reverse)
    mismatches as from ``site_mismatch``; a record silent on both sides isn't tested."""
    tested = F.col("forward").isNotNull() | F.col("reverse").isNotNull()
    amplified = (F.col("forward") <= SITE_MISMATCHES) & (F.col("reverse") <= SITE_MISMATCHES)
    return records.where(tested).groupBy(genus).agg(F.count(F.when(amplified, 1)).alias("amplified"), F.count(F.lit(1)).alias("tested"))
