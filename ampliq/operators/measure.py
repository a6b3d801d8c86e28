"""Rates per pair and bin, member/competitor summaries, panel verdicts
(AGG-01, AGG-02, AGG-15, DEC-09, DEC-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import stats as M


def bin_rates(hits: DataFrame, reads: DataFrame, pairs: DataFrame) -> DataFrame:
    """k of n reads with a product for every pair and bin, zeros included (AGG-01).

    ``hits`` holds one row per (read_id, pair). Both counts are partially aggregated, so a
    bin with a third of all reads reaches the shuffle as one row per task.
    """
    n = reads.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    k = (hits.join(reads.select("read_id", "bin"), "read_id")
         .groupBy("pair", "bin").agg(F.count(F.lit(1)).alias("k")))
    # pair x bin is the shape of the report: the product of two dimension tables
    frame = pairs.select("pair").distinct().join(n)
    return (frame.join(k, ["pair", "bin"], "left")
            .select("pair", "bin", F.coalesce("k", F.lit(0)).alias("k"), "n"))


def separation(rates: DataFrame, membership: DataFrame | None, min_reads: int = P.MIN_COMPETITOR_READS) -> DataFrame:
    """Member lower bound against pooled and worst-single competitor upper bound (AGG-02).

    Everything that was not measured stays NULL. Without ``membership`` the rates have the role.
    """
    r = (rates if membership is None else rates.join(membership, "bin")).where(F.col("n") > 0)
    member, comp = F.col("role") == "member", F.col("role") == "competitor"
    covered = member & (F.col("k") / F.col("n") >= P.COVERAGE_SHARE)
    lo, hi = M.wilson_lower("k", "n"), M.wilson_upper("k", "n")
    deep = comp & (F.col("n") >= min_reads)
    g = r.groupBy("pair").agg(
        F.min(F.when(member, lo)).alias("member_low"),
        F.count(F.when(member, 1)).alias("member_bins"),
        F.count(F.when(covered, 1)).alias("covered_bins"),
        F.min(F.when(covered, lo)).alias("covered_low"),
        F.coalesce(F.sum(F.when(comp, F.col("k"))), F.lit(0)).alias("pool_k"),
        F.coalesce(F.sum(F.when(comp, F.col("n"))), F.lit(0)).alias("pool_n"),
        F.max(F.when(deep, hi)).alias("worst_high"),
        F.count(F.when(deep, 1)).alias("competitors_measured"),
        F.max(F.when(deep, F.struct(hi.alias("h"), F.col("bin").alias("b")))).alias("w"),
    ).where(F.col("member_bins") > 0)
    pool_high = F.when(F.col("pool_n") > 0, M.wilson_upper("pool_k", "pool_n"))
    g = g.withColumn("pool_high", pool_high).withColumn("worst_bin", F.col("w.b")).drop("w")
    pool_ok = F.col("pool_n") >= min_reads
    return (g.withColumn("fold_pool", F.when(pool_ok, M.ratio("member_low", "pool_high")))
            .withColumn("fold_worst", M.ratio("member_low", "worst_high"))
            .withColumn("fold_pool_covered", F.when(pool_ok, M.ratio("covered_low", "pool_high")))
            .withColumn("fold_worst_covered", M.ratio("covered_low", "worst_high")))


def panel_decision(sep: DataFrame, universal: Column | None = None,
                   threshold: float = P.FOLD_THRESHOLD) -> DataFrame:
    """Verdict on the worst competitor bin, falling back to the pool, else not measurable (DEC-09)."""
    u = universal if universal is not None else F.lit(False)
    value = F.when(u, F.lit(None).cast("double")).otherwise(F.coalesce("fold_worst", "fold_pool"))
    basis = (F.when(u, "universal").when(F.col("fold_worst").isNotNull(), "worst_bin")
             .when(F.col("fold_pool").isNotNull(), "pool").otherwise("no_competitor"))
    return sep.withColumn("value", value).withColumn("basis", basis).withColumn(
        "decision", F.when(F.col("value").isNull(), "NOT MEASURABLE")
        .when(F.col("value") >= threshold, "ABOVE THRESHOLD").otherwise("BELOW THRESHOLD"))


def read_level_summary(rates: DataFrame, membership: DataFrame) -> DataFrame:
    """Pooled and per-bin percentages of the read-level check (AGG-15).

    ``rates`` is (pair, bin, k0, k1, n): reads with a product at zero and at one mismatch.
    """
    r = rates.join(membership, "bin").where(F.col("n") > 0)
    member, comp = F.col("role") == "member", F.col("role") == "competitor"
    pct = 100.0 * F.col("k1") / F.col("n")

    def pooled(k: str, cond: Column) -> Column:
        return 100.0 * F.sum(F.when(cond, F.col(k))) / F.sum(F.when(cond, F.col("n")))

    return r.groupBy("pair").agg(
        F.count(F.when(member, 1)).alias("member_bins"),
        F.count(F.when(member & (pct >= 10), 1)).alias("member_bins_10"),
        F.min(F.when(member, pct)).alias("member_min"),
        F.max(F.when(member, pct)).alias("member_max"),
        F.coalesce(pooled("k1", member), F.lit(0.0)).alias("pooled_mm1"),
        F.coalesce(pooled("k0", member), F.lit(0.0)).alias("pooled_mm0"),
        F.coalesce(F.max(F.when(comp, pct)), F.lit(0.0)).alias("worst_competitor"),
        F.coalesce(pooled("k1", comp), F.lit(0.0)).alias("pooled_competitor"),
    )


def read_level_verdict(summary: DataFrame, universal: Column | None = None) -> DataFrame:
    """Point-estimate verdict; an absent competitor gives an infinite ratio, kept as NULL
    next to an explicit flag (DEC-10)."""
    u = universal if universal is not None else F.lit(False)
    have = F.col("member_bins") > 0
    pooled_inf = ~(F.col("pooled_competitor") > 0)
    worst_inf = have & ~(F.col("worst_competitor") > 0) & (F.col("member_min") > 0)
    worst = (F.when(have & (F.col("worst_competitor") > 0), F.col("member_min") / F.col("worst_competitor"))
             .when(worst_inf, F.lit(None).cast("double")).otherwise(F.lit(0.0)))
    s = (summary.withColumn("ratio_pooled", F.when(~pooled_inf, F.col("pooled_mm1") / F.col("pooled_competitor")))
         .withColumn("ratio_pooled_infinite", pooled_inf)
         .withColumn("ratio_worst", worst).withColumn("ratio_worst_infinite", worst_inf))
    t = P.FOLD_THRESHOLD
    verdict = (F.when(u, "COVERAGE")
               .when(~have | (F.col("member_max") < 10), "NO / WEAK PRODUCT IN MEMBERS")
               .when(F.col("ratio_worst_infinite") | (F.col("ratio_worst") >= t), "PASSED")
               .when(F.col("ratio_pooled_infinite") | (F.col("ratio_pooled") >= t), "PASSED POOLED ONLY")
               .otherwise("FAILED"))
    return s.withColumn("verdict", verdict).withColumn(
        "systematic_mismatch", have & (F.col("pooled_mm1") >= 10) & (F.col("pooled_mm0") == 0))
