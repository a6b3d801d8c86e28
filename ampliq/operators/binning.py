"""Read-to-centre assignment, segments, satellites, bin selection
(JOIN-13..15, WIN-07, WIN-11..14, GRF-04, AGG-08, AGG-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .. import params as P
from ..session import cut_lineage


def tiered_assignment(hits: DataFrame, identity: float = P.ASSIGN_IDENTITY, coverage: float = P.ASSIGN_COVERAGE,
                      tiered: bool = True) -> DataFrame:
    """read -> centre: best centre at the identity floor, or in the second tier with a clear
    margin over the runner-up centre (JOIN-13). hits: (q, qlen, qs, qe, t, identity)."""
    cov = F.when(F.col("qlen") > 0, (F.col("qe") - F.col("qs")) / F.col("qlen")).otherwise(F.lit(0.0))
    best = hits.where(cov >= coverage).groupBy("q", "t").agg(F.max("identity").alias("identity"))
    w = Window.partitionBy("q").orderBy(F.desc("identity"), "t")
    r = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 2)
    g = r.groupBy("q").agg(F.max(F.when(F.col("rank") == 1, F.struct("t", "identity"))).alias("b"),
                           F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("identity"))), F.lit(0.0)).alias("second"))
    ident = F.col("b.identity")
    ok = ident >= identity
    if tiered:
        ok = ok | ((ident >= P.ASSIGN_IDENTITY_2) & (ident - F.col("second") >= P.ASSIGN_MARGIN))
    return g.where((ident > 0) & ok).select("q", F.col("b.t").alias("t"), ident.alias("identity"))


def simple_assignment(hits: DataFrame, identity: float = 0.90, coverage: float = 0.80) -> DataFrame:
    """Best identity per read with both floors (JOIN-14)."""
    ok = hits.where((F.col("qlen") > 0) & ((F.col("qe") - F.col("qs")) / F.col("qlen") >= coverage)
                    & (F.col("identity") >= identity))
    b = ok.groupBy("q").agg(F.min(F.struct((-F.col("identity")).alias("neg"), F.col("t"))).alias("b"))
    return b.select("q", F.col("b.t").alias("t"), (-F.col("b.neg")).alias("identity"))


def overlap_pairs(hits: DataFrame, identity: float, coverage: float) -> DataFrame:
    """Pairs covering enough of the shorter sequence (JOIN-15); self hits removed."""
    shorter = F.least("qlen", "tlen")
    span = F.least(F.col("qe") - F.col("qs"), F.col("te") - F.col("ts"))
    return hits.where((F.col("q") != F.col("t")) & (shorter > 0) & (span / shorter >= coverage)
                      & (F.col("identity") >= identity)).select("q", "t", "identity")


def segments(hits: DataFrame, identity: float, coverage: float = P.SEGMENT_COVERAGE, cap: float = P.FULL_HIGH) -> DataFrame:
    """Non-overlapping concatemer segments per read, longest and most identical first (WIN-14).

    The greedy choice folds over the hits of one read, a group bounded by the read itself.
    """
    span, tspan = F.col("qe") - F.col("qs"), F.col("te") - F.col("ts")
    ok = hits.where((F.col("identity") >= identity) & (tspan >= coverage * F.col("tlen")) & (span <= cap * F.col("tlen")))
    cand = ok.select("q", F.struct((-span * F.col("identity")).alias("score"), F.col("qs"), F.col("qe"),
                                   F.col("t"), F.col("identity")).alias("s"))
    g = cand.groupBy("q").agg(F.array_sort(F.collect_list("s")).alias("s"))
    empty = F.array().cast(g.schema["s"].dataType.simpleString())
    chosen = F.aggregate("s", empty, lambda acc, x: F.when(
        F.forall(acc, lambda c: (x["qe"] <= c["qs"]) | (x["qs"] >= c["qe"])), F.concat(acc, F.array(x))).otherwise(acc))
    e = g.select("q", F.explode(chosen).alias("c"))
    return e.select("q", "c.qs", "c.qe", "c.t", "c.identity")


def satellite_parent(hits: DataFrame, sample_sizes: DataFrame, identity: float = P.ASSIGN_IDENTITY,
                     coverage: float = 0.80, share: float = P.SATELLITE_SHARE) -> DataFrame:
    """Centre holding at least half of a bin's sampled reads, if any (GRF-04).

    hits: (bin, q, t, ts, te, tlen, identity); sample_sizes: (bin, sampled).
    """
    ok = hits.where((F.col("identity") >= identity) & ((F.col("te") - F.col("ts")) >= coverage * F.col("tlen")))
    best = ok.groupBy("bin", "q").agg(F.min(F.struct((-F.col("identity")).alias("neg"), F.col("t"))).alias("b"))
    c = best.groupBy("bin", F.col("b.t").alias("parent")).agg(F.count(F.lit(1)).alias("hits"))
    top = c.groupBy("bin").agg(F.min(F.struct((-F.col("hits")).alias("neg"), F.col("parent"))).alias("m"))
    return (top.select("bin", F.col("m.parent").alias("parent"), (-F.col("m.neg")).alias("hits"))
            .join(sample_sizes, "bin").where(F.col("hits") >= share * F.col("sampled")))


def settle_satellites(bins: DataFrame, hits: DataFrame, sampled: DataFrame, share: float = P.SATELLITE_SHARE, max_rounds: int = 10_000) -> DataFrame:
    """(barcode, bin, satellite) of the wanted bins, taken in order of (barcode, place) (GRF-04).

    A bin is the satellite of a centre chosen before it if, its reads being given to their best such centre, one holds ``share``
    of the bin's sample; else it is chosen itself. That is one bin after the other, yet only along the hits: a round settles every bin whose
    earlier hit centres are settled, so rounds follow the longest chain of bins that hit one another, not the number of bins.

    bins: (barcode, bin, place), wanted bins only; hits: (barcode, bin, q, centre, identity), those good enough to count, at most one per
    read and centre; sampled: (barcode, bin, sampled).
    """
    before = bins.select("barcode", F.col("bin").alias("centre"), F.col("place").alias("at"))
    hits = cut_lineage(hits.join(bins, ["barcode", "bin"]).join(before, ["barcode", "centre"]).where("at < place").select("barcode", "bin", "q", "centre", "identity"))
    edges = cut_lineage(hits.select("barcode", "bin", "centre").distinct())
    state = cut_lineage(bins.select("barcode", "bin", F.lit(None).cast("boolean").alias("satellite")))
    for _ in range(max_rounds):
        open_bins = state.where("satellite is null").select("barcode", "bin")
        waiting = edges.join(open_bins.withColumnRenamed("bin", "centre"), ["barcode", "centre"], "left_semi").select("barcode", "bin").distinct()
        ready = open_bins.join(waiting, ["barcode", "bin"], "left_anti")
        chosen = state.where("not satellite").select("barcode", F.col("bin").alias("centre"))
        h = hits.join(ready, ["barcode", "bin"], "left_semi").join(chosen, ["barcode", "centre"], "left_semi")
        best = h.groupBy("barcode", "bin", "q").agg(F.min(F.struct((-F.col("identity")).alias("neg"), F.col("centre"))).alias("b"))
        n = best.groupBy("barcode", "bin", F.col("b.centre").alias("centre")).agg(F.count(F.lit(1)).alias("n"))
        top = n.groupBy("barcode", "bin").agg(F.max("n").alias("n")).join(sampled, ["barcode", "bin"])
        found = ready.join(top, ["barcode", "bin"], "left").select("barcode", "bin", F.coalesce(F.col("n") >= share * F.col("sampled"), F.lit(False)).alias("now"))
        left = Observation()  # counted by the job that writes the round
        state = state.join(found, ["barcode", "bin"], "left").select("barcode", "bin", F.coalesce("satellite", "now").alias("satellite"))
        state = cut_lineage(state.observe(left, F.count_if(F.col("satellite").isNull()).alias("n")))
        if not left.get["n"]:
            return state
    raise RuntimeError("satellites did not settle")


def wanted_bins(bins: DataFrame, min_reads: int, top_per_window: int) -> DataFrame:
    """``bins`` (barcode, bin, window, reads) with pos (rank in its window), place (rank in its barcode) and wanted."""
    order = [F.desc("reads"), F.col("bin")]
    r = bins.withColumn("pos", F.row_number().over(Window.partitionBy("barcode", "window").orderBy(*order)))
    r = r.withColumn("place", F.row_number().over(Window.partitionBy("barcode").orderBy(*order)))
    return r.withColumn("wanted", (F.col("reads") >= min_reads) | (F.col("pos") <= top_per_window))


def select_bins(bins: DataFrame, hits: DataFrame, sampled: DataFrame, min_reads: int = 500, top_per_window: int = 5, max_per_barcode: int = 40,
                share: float = P.SATELLITE_SHARE) -> DataFrame:
    """Bin choice with its reason (WIN-07). bins: (barcode, bin, window, reads), one row per bin of a barcode.

    Satellites of bins chosen before (``settle_satellites``) are left out and don't use up the ceiling. Nothing is chosen once a barcode is
    full, so the ceiling can't change what is settled before it and is applied to the settled order.
    """
    r = cut_lineage(wanted_bins(bins, min_reads, top_per_window))
    settled = settle_satellites(r.where("wanted").select("barcode", "bin", "place"), hits, sampled, share)
    r = r.join(settled, ["barcode", "bin"], "left").withColumn("satellite", F.coalesce("satellite", F.lit(False)))
    taken = F.when(F.col("wanted") & ~F.col("satellite"), 1).otherwise(0)
    before = Window.partitionBy("barcode").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("before", F.coalesce(F.sum(taken).over(before), F.lit(0)))
    reason = (F.when(F.col("before") >= max_per_barcode, "ceiling").when(F.col("satellite"), "satellite")
              .when(F.col("reads") >= min_reads, "reads").when(F.col("pos") <= top_per_window, "top_of_window")
              .otherwise("too_few"))
    return r.withColumn("reason", reason).withColumn("chosen", reason.isin("reads", "top_of_window")).drop("before", "place", "wanted")


def length_peaks(lengths: DataFrame, keys: list[str], min_share: float = 0.03, max_peaks: int = 4) -> DataFrame:
    """Read-length peaks per key (AGG-08): greedy over 100-bp buckets, at most a few hundred.

    lengths: (keys, len). Reads are reduced to (length, count) first; a window's share is the
    exact count of lengths inside it.
    """
    lc = lengths.groupBy(*keys, "len").agg(F.count(F.lit(1)).alias("n"))
    total = lc.groupBy(*keys).agg(F.sum("n").alias("total"))
    b = lc.where(F.col("len") >= 300).groupBy(*keys, F.floor(F.col("len") / 100).cast("int").alias("bucket")).agg(
        F.sum("n").alias("bn"))
    peak = F.col("bucket") * 100 + 50
    b = b.withColumn("peak", peak).withColumn("low", F.floor(peak * 0.85).cast("int")).withColumn(
        "high", F.floor(peak * 1.15).cast("int"))
    # each length is sent to the few buckets whose window can hold it
    first, last = F.floor(F.col("len") / 116).cast("int") - 1, F.ceil(F.col("len") / 84).cast("int") + 1
    spread = lc.select(*keys, "len", "n", F.explode(F.sequence(first, last)).alias("bucket"))
    inside = (b.join(spread, [*keys, "bucket"]).where(F.col("len").between(F.col("low"), F.col("high")))
              .groupBy(*keys, "bucket", "peak", "low", "high", "bn").agg(F.sum("n").alias("in_window")))
    g = inside.join(total, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("bn")).alias("neg"), F.col("bucket"), F.col("low"), F.col("high"), F.col("peak"),
        (F.col("in_window") / F.col("total")).alias("share")))).alias("c"))
    empty = F.array().cast(g.schema["c"].dataType.simpleString())
    chosen = F.aggregate("c", empty, lambda acc, x: F.when(
        (F.size(acc) < max_peaks) & (x["share"] >= min_share)
        & F.forall(acc, lambda a: (x["high"] < a["low"]) | (x["low"] > a["high"])),
        F.concat(acc, F.array(x))).otherwise(acc))
    e = g.select(*keys, F.explode(chosen).alias("p"))
    return e.select(*keys, "p.low", "p.high", "p.peak", (100.0 * F.col("p.share")).alias("share_pct"))


def centre_pick(members: DataFrame, cluster: str, name: str, length: str) -> DataFrame:
    """Member closest to the upper median length, ties by name (WIN-11)."""
    from .ranking import nth_value
    med = nth_value(members, [cluster], length, 0.5).withColumnRenamed("value", "median")
    d = members.join(med, cluster).groupBy(cluster).agg(
        F.min(F.struct(F.abs(F.col(length) - F.col("median")).alias("d"), F.col(name))).alias("m"))
    return d.select(cluster, F.col(f"m.{name}").alias("centre"), F.col("m.d").alias("distance"))


def backbone_clusters(lengths: Column, ratio: float = 1.5) -> Column:
    """Heads of length clusters: descending lengths, joined while head / length < ratio (WIN-13).

    ``lengths`` is an array (BIGINT) of the distinct candidate lengths of one bin; no head is near a length of 0, which is a head of its own.
    """
    ordered = F.reverse(F.array_sort(lengths))
    return F.aggregate(ordered, F.array().cast("array<bigint>"), lambda heads, n: F.when(
        F.exists(heads, lambda h: F.try_divide(h, n) < ratio), heads).otherwise(F.concat(heads, F.array(n.cast("bigint")))))
