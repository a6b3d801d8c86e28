"""Community profiles over classified reads (COM-01..06, AGG-18, AGG-20, AGG-26, MTH-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as M
from .ranking import top_n

# Taxonomic ranks from broad to narrow.
RANKS = ("D", "P", "C", "O", "F", "G", "S")


def rank_order(code: str) -> Column:
    return F.array_position(F.array(*map(F.lit, RANKS)), F.substring(code, 1, 1)).cast("int")


def rank_coverage(direct: DataFrame, sample: str = "sample") -> DataFrame:
    """Reads placed at each rank or below, per sample (COM-01).

    direct: (sample, rank code, n); 'U' is unclassified. Only seven rows per sample remain
    before the running sum.
    """
    code = F.substring("rank", 1, 1)
    per = direct.groupBy(sample, code.alias("rank")).agg(F.sum("n").alias("n"))
    total = per.groupBy(sample).agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("rank") == "U", F.col("n"))), F.lit(0)).alias("unclassified"))
    frame = total.withColumn("rank", F.explode(F.array(*map(F.lit, RANKS))))
    f = frame.join(per, [sample, "rank"], "left").withColumn("pos", rank_order("rank"))
    w = Window.partitionBy(sample).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("placed", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("classified", F.col("total") - F.col("unclassified"))
    return f.withColumn("share", M.ratio("placed", "classified")).select(
        sample, "rank", "pos", "placed", "classified", "unclassified", "total", "share")


def supported_rank(coverage: DataFrame, min_share: float = 0.50, sample: str = "sample") -> DataFrame:
    """Deepest rank at which the classified share still stands; the broadest rank otherwise."""
    c = coverage.groupBy(sample).agg(
        F.max(F.when(F.col("share") >= min_share, F.struct("pos", "rank", "placed"))).alias("m"),
        F.max(F.when(F.col("pos") == 1, F.struct("pos", "rank", "placed"))).alias("d"),
        F.max("classified").alias("classified"), F.max("unclassified").alias("unclassified"), F.max("total").alias("total"))
    pick = F.coalesce("m", "d")
    return c.select(sample, pick["rank"].alias("rank"), pick["placed"].alias("placed"), "classified", "unclassified", "total")


def abundance_at_rank(clades: DataFrame, chosen: DataFrame, close: DataFrame, ranks: DataFrame,
                      top: int = 15, sample: str = "sample") -> DataFrame:
    """Taxa of the chosen rank, outermost nodes only, plus residual rows (COM-01).

    clades: (sample, node, clade); close: (node, ancestor, dist); ranks: (node, rank).
    """
    r = ranks.withColumn("rank", F.substring("rank", 1, 1))
    nested = (close.where("dist > 0").join(r, "node").join(
        r.select(F.col("node").alias("ancestor"), F.col("rank").alias("ar")), "ancestor").where(F.col("rank") == F.col("ar"))
        .select("node").distinct())
    outer = r.join(nested, "node", "left_anti")
    t = clades.join(outer, "node").join(chosen, [sample, "rank"]).select(
        sample, F.col("node").alias("taxon"), F.col("clade").alias("n"), "total")
    t = top_n(t, [sample], [F.desc("n"), F.col("taxon")], top).drop("rank")
    above = chosen.select(sample, F.concat(F.lit("[above "), "rank", F.lit("]")).alias("taxon"),
                          (F.col("classified") - F.col("placed")).alias("n"), "total").where("n > 0")
    none = chosen.select(sample, F.lit("[unclassified]").alias("taxon"), F.col("unclassified").alias("n"), "total").where("n > 0")
    return t.unionByName(above).unionByName(none).withColumn("pct", F.round(100.0 * F.col("n") / F.col("total"), 4)).drop("total")


def reassign(read_hits: DataFrame, assigned: DataFrame, close: DataFrame, confidence: float) -> DataFrame:
    """First ancestor of the assigned taxon whose clade holds enough of the k-mer hits (COM-02).

    read_hits: (read_id, taxon, hits) with 'A' ambiguous (left out of Q) and '0' no match
    (in Q only); assigned: (read_id, taxon). Returns (read_id, old, new) with NULL = none.
    """
    h = read_hits.where("taxon <> 'A'")
    q = h.groupBy("read_id").agg(F.sum("hits").alias("q"))
    clade = (h.where("taxon <> '0'").join(close.select(F.col("node").alias("taxon"), "ancestor"), "taxon")
             .groupBy("read_id", "ancestor").agg(F.sum("hits").alias("c")))
    chain = assigned.select("read_id", F.col("taxon").alias("old")).join(
        close.select(F.col("node").alias("old"), "ancestor", "dist"), "old")
    ok = (chain.join(clade, ["read_id", "ancestor"]).join(q, "read_id").where((F.col("q") > 0) & (F.col("c") / F.col("q") >= confidence))
          .groupBy("read_id").agg(F.min(F.struct("dist", "ancestor")).alias("m")))
    return assigned.select("read_id", F.col("taxon").alias("old")).join(ok, "read_id", "left").select(
        "read_id", "old", F.col("m.ancestor").alias("new"))


def threshold_sweep(read_hits: DataFrame, assigned: DataFrame, close: DataFrame, ranks: DataFrame, thresholds: list[float]) -> DataFrame:
    """Reads per rank at every threshold in one pass (AGG-20).

    The share of each ancestor is computed once per read; the thresholds multiply only the
    finished (read, rank-of-first-passing-ancestor) comparison.
    """
    h = read_hits.where("taxon <> 'A'")
    q = h.groupBy("read_id").agg(F.sum("hits").alias("q"))
    clade = (h.where("taxon <> '0'").join(close.select(F.col("node").alias("taxon"), "ancestor"), "taxon")
             .groupBy("read_id", "ancestor").agg(F.sum("hits").alias("c")))
    chain = assigned.join(close.select(F.col("node").alias("taxon"), "ancestor", "dist"), "taxon")
    steps = (chain.join(clade, ["read_id", "ancestor"]).join(q, "read_id").where("q > 0")
             .join(ranks.select(F.col("node").alias("ancestor"), "rank"), "ancestor")
             .groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("dist", "rank", (F.col("c") / F.col("q")).alias("share")))).alias("chain")))
    every = assigned.select("read_id").join(steps, "read_id", "left")
    t = every.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    first = F.get(F.filter("chain", lambda s: s["share"] >= F.col("threshold")), F.lit(0))
    return t.select("threshold", F.coalesce(first["rank"], F.lit("U")).alias("rank")).groupBy("threshold", "rank").agg(
        F.count(F.lit(1)).alias("n"))


def collapse_threshold(shares: DataFrame, key: str, floor: float = 0.20) -> DataFrame:
    """Lowest threshold at which a bin's dominant share falls under the floor; NULL if never."""
    return shares.groupBy(key).agg(F.min(F.when(F.col("share") < floor, F.col("threshold"))).alias("collapse"))


def diversity(abundance: DataFrame, sample: str = "sample") -> DataFrame:
    """Shannon (natural log), Simpson (1 - sum p^2) and richness (MTH-06)."""
    a = abundance.where("n > 0")
    t = a.groupBy(sample).agg(F.sum("n").alias("total"))
    p = a.join(t, sample).withColumn("p", F.col("n") / F.col("total"))
    return p.groupBy(sample).agg((-F.sum(F.col("p") * F.log("p"))).alias("shannon"), (1.0 - F.sum(F.col("p") * F.col("p"))).alias("simpson"),
                                 F.count(F.lit(1)).alias("taxa"))


def bray_curtis(pairs: DataFrame, abundance: DataFrame, sample: str = "sample") -> DataFrame:
    """Bray-Curtis distance for the given (s1, s2) pairs; 0 when both are empty (MTH-06).

    sum|a-b| = A + B - 2 sum min(a,b), so only shared taxa are joined.
    """
    tot = abundance.groupBy(sample).agg(F.sum("n").alias("t"))
    a = abundance.select(F.col(sample).alias("s1"), "taxon", F.col("n").alias("n1"))
    b = abundance.select(F.col(sample).alias("s2"), "taxon", F.col("n").alias("n2"))
    shared = pairs.join(a, "s1").join(b, ["s2", "taxon"]).groupBy("s1", "s2").agg(F.sum(F.least("n1", "n2")).alias("m"))
    j = (pairs.join(shared, ["s1", "s2"], "left").join(tot.select(F.col(sample).alias("s1"), F.col("t").alias("t1")), "s1", "left")
         .join(tot.select(F.col(sample).alias("s2"), F.col("t").alias("t2")), "s2", "left"))
    both = F.coalesce("t1", F.lit(0)) + F.coalesce("t2", F.lit(0))
    return j.select("s1", "s2", F.when(both > 0, (both - 2 * F.coalesce("m", F.lit(0))) / both).otherwise(F.lit(0.0)).alias("distance"))


def trend_table(abundance: DataFrame, years: list[int], top: int) -> DataFrame:
    """Share of each of the top taxa per group by year (COM-03). abundance: (grp, year, taxon, n)."""
    total = abundance.groupBy("grp", "year").agg(F.sum("n").alias("total"))
    best = top_n(abundance.groupBy("grp", "taxon").agg(F.sum("n").alias("n")), ["grp"], [F.desc("n"), F.col("taxon")], top).select("grp", "taxon")
    p = abundance.join(best, ["grp", "taxon"], "left_semi").join(total, ["grp", "year"]).withColumn("pct", 100.0 * F.col("n") / F.col("total"))
    return p.groupBy("grp", "taxon").pivot("year", years).agg(F.round(F.sum("pct"), 6))


def bin_shares(bins: DataFrame) -> DataFrame:
    """Share of each bin in its barcode's full reads and in all its reads (AGG-18).

    bins: (barcode, bin, full, reads).
    """
    d = bins.groupBy("barcode").agg(F.sum("full").alias("full_total"), F.sum("reads").alias("all_total"))
    return bins.join(d, "barcode").select("barcode", "bin", M.ratio(100.0 * F.col("full"), "full_total").alias("share_full"),
                                          M.ratio(100.0 * F.col("reads"), "all_total").alias("share_all"))


def top_species(shares: DataFrame, n: int) -> DataFrame:
    """Species shares summed per sample and kingdom, best n (COM-04). shares: (sample, kingdom, species, share)."""
    s = shares.groupBy("sample", "kingdom", "species").agg(F.round(F.sum("share"), 9).alias("share"))
    return top_n(s, ["sample", "kingdom"], [F.desc("share"), F.col("species")], n)


def clade_bins(assigned: DataFrame, close: DataFrame, clades: DataFrame) -> DataFrame:
    """Reads assigned inside a clade form its bin (COM-05). clades: (bin, node)."""
    inside = close.select(F.col("node").alias("taxon"), F.col("ancestor")).join(clades.withColumnRenamed("node", "ancestor"), "ancestor")
    return assigned.join(inside.select("taxon", "bin"), "taxon").select("bin", "read_id")


def calibration(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Symmetric difference of two (bin, read_id) assignments per bin (COM-05)."""
    f = found.distinct().withColumn("f", F.lit(1))
    e = expected.distinct().withColumn("e", F.lit(1))
    return f.join(e, ["bin", "read_id"], "full_outer").groupBy("bin").agg(
        F.count(F.when(F.col("f").isNotNull() & F.col("e").isNotNull(), 1)).alias("common"),
        F.count(F.when(F.col("e").isNull(), 1)).alias("only_found"), F.count(F.when(F.col("f").isNull(), 1)).alias("only_expected"))


def dereplicate(reads: DataFrame, min_size: int = 2) -> DataFrame:
    """Distinct sequences with their abundance (COM-06); grouped on a hash so that a heavily
    copied sequence is counted map-side and long texts are not compared in the shuffle."""
    g = reads.groupBy(F.sha2("seq", 256).alias("digest")).agg(F.count(F.lit(1)).alias("size"), F.min("read_id").alias("representative"))
    return g.where(F.col("size") >= min_size)


def taxon_coverage(rates: DataFrame, min_pct: float = 10.0) -> DataFrame:
    """Best rate per taxon and pair over its bins and the taxon's status (AGG-26).

    rates: (taxon, pair, universal, pct_mm1, pct_mm3).
    """
    m = rates.groupBy("taxon", "pair", "universal").agg(F.max("pct_mm1").alias("m1"), F.max("pct_mm3").alias("m3"))
    g = m.groupBy("taxon").agg(F.count(F.when((F.col("m1") >= min_pct) & ~F.col("universal"), 1)).alias("specific"),
                               F.count(F.when(F.col("m1") >= min_pct, 1)).alias("any1"),
                               F.count(F.when((F.col("m3") >= min_pct) & (F.col("m1") < min_pct), 1)).alias("only3"))
    return g.withColumn("status", F.when(F.col("specific") > 0, "specific").when(F.col("any1") > 0, "universal_only")
                        .when(F.col("only3") > 0, "mm3_only").otherwise("gap"))
