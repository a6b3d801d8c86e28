"""Specificity layers and verdicts; not measured is never clean
(DEC-08, DEC-11, DEC-13, DEC-21, DEC-22, DEC-24, DEC-26, DEC-27, THR-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import stats as M


def vote(hits: Column, limit: int = 0) -> Column:
    """UNKNOWN when not measured, else CLEAN up to the limit, else RISKY."""
    return F.when(hits.isNull(), "UNKNOWN").when(hits <= limit, "CLEAN").otherwise("RISKY")


def merge_layers(layers: DataFrame, limit: int = 0) -> DataFrame:
    """Three measured layers side by side and their category (DEC-08).

    layers: (target, local_hits, thermo_hits, network_hits, organelle); NULL = not measured.
    """
    d = layers
    for name in ("local", "thermo", "network"):
        d = d.withColumn(name, vote(F.col(f"{name}_hits"), limit))
    votes = ("local", "thermo", "network")
    known = sum((F.col(v) != "UNKNOWN").cast("int") for v in votes)
    risky = sum((F.col(v) == "RISKY").cast("int") for v in votes)
    loose_only = (F.col("local") == "RISKY") & (F.col("thermo") == "CLEAN") & (F.col("network") != "RISKY")
    d = d.withColumn("sources", known).withColumn("risky", risky)
    category = (F.when(loose_only, "REVIEW").when((F.col("risky") > 0) & (F.col("risky") < F.col("sources")), "CONTRADICTORY")
                .when(F.col("sources") == 0, "INCOMPLETE").when(F.col("risky") > 0, "RISKY")
                .when(F.coalesce("organelle", F.lit(0)) > 0, "REVIEW").when(F.col("sources") >= 3, "CERTAIN")
                .when(F.col("sources") == 2, "CONDITIONAL").otherwise("INCOMPLETE"))
    return d.withColumn("category", category).withColumn("agreeing", F.greatest(F.col("risky"), F.col("sources") - F.col("risky")))


# Cycles lost to a terminal mismatch, by primer base and template base.
TERMINAL_PENALTY = {"AG": 6.6, "GA": 6.6, "CC": 6.6, "AA": 4.3, "TG": 0.0, "TC": 0.0, "TT": 0.0}
UNKNOWN_TERMINAL, SECOND_BASE, INNER_BASE, THREE_OF_LAST_FOUR = 6.6, 10.0, 3.3, 15.0


def end_penalty(positions, terminal_pair: Column) -> Column:
    """Expected cycle penalty of mismatches near the 3' end (THR-07).

    ``positions`` are counted from the 3' end, 1 = terminal; an unknown terminal pair takes
    the worst value.
    """
    pos = F.array_distinct(F.col(positions) if isinstance(positions, str) else positions)
    known = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TERMINAL_PENALTY.items() for x in kv]), terminal_pair), F.lit(0.0))
    last = F.when(terminal_pair.isNull(), F.lit(UNKNOWN_TERMINAL)).otherwise(known)
    total = F.aggregate(pos, F.lit(0.0), lambda a, k: a + F.when(k == 1, last).when(k == 2, F.lit(SECOND_BASE))
                        .when(k <= 8, F.lit(INNER_BASE)).otherwise(F.lit(0.0)))
    return F.when(F.size(F.filter(pos, lambda k: k <= 4)) >= 3, F.lit(THREE_OF_LAST_FOUR)).otherwise(total)


def leak_aware(counts: DataFrame, cap: float, leak_cap: float, min_reads: int) -> DataFrame:
    """A competitor is real when its lower bound exceeds what measured read leakage explains (DEC-22).

    counts: (k, n, leak_k, leak_n).
    """
    leak = F.when(F.col("leak_n") >= min_reads, F.least(M.wilson_upper("leak_k", "leak_n"), F.lit(leak_cap))).otherwise(F.lit(0.0))
    d = counts.withColumn("low", M.wilson_lower("k", "n")).withColumn("limit_used", F.greatest(F.lit(cap), leak))
    return d.withColumn("real_competitor", F.col("low") > F.col("limit_used"))


def _cross_level(target_low: Column, rival_low: Column) -> Column:
    return F.when(rival_low <= 0.02, 0).when((rival_low <= 0.10) & (target_low >= 10 * rival_low), 1).otherwise(2)


def two_denominators(counts: DataFrame) -> DataFrame:
    """Cross reaction on all reads and on reads covering the locus; the stricter one stands (DEC-11).

    counts: (k target reads with product, ck competitor reads, raw_n, cov_n).
    """
    d = counts.withColumn("_kn", F.greatest("cov_n", "k")).withColumn("_cn", F.greatest("cov_n", "ck"))
    raw = _cross_level(M.wilson_lower("k", "raw_n"), M.wilson_lower("ck", "raw_n"))
    cov = _cross_level(M.wilson_lower("k", "_kn"), M.wilson_lower("ck", "_cn"))
    label = F.element_at(F.array(F.lit("NONE"), F.lit("BORDERLINE"), F.lit("PRESENT")), F.greatest(raw, cov) + 1)
    return d.withColumn("cross_reaction", label).withColumn("denominators_diverge", raw != cov).drop("_kn", "_cn")


def database_coverage(longest, product_bp) -> Column:
    """Whether a database holds the class at all; not covered is no evidence of clean (DEC-21)."""
    n = F.col(longest)
    return F.when(n.isNull(), "NOT MEASURED").when(n < product_bp, "NOT COVERED").otherwise("COVERED")


def problem_reasons(geometry_violated, provisional, dropped, separation, product_bp, gel_clash) -> Column:
    """All problem labels of a panel row (DEC-13)."""
    labels = F.array(
        F.when(geometry_violated, "G"), F.when(provisional, "K"), F.when(dropped, "C"),
        F.when(separation < P.FOLD_THRESHOLD, "A"),
        F.when(product_bp > P.PRODUCT_NOT_ADVISED, "U_long").when(product_bp > P.PRODUCT_IDEAL[1], "U_over_ideal"),
        F.when(gel_clash, "P"))
    return F.filter(labels, lambda x: x.isNotNull())


def near_published(fold, published) -> Column:
    """A measured fold within 0.34x to 3x of the published one (DEC-24)."""
    f = F.col(fold) if isinstance(fold, str) else fold
    return f.between(0.34 * published, 3 * published)


def order_list(rows: DataFrame, cls: str, wanted: list[str], sequence: str) -> DataFrame:
    """Rows to order; a row without a sequence is reported, never dropped (DEC-27)."""
    return rows.withColumn("status", F.when(~F.col(cls).isin(*wanted), "other_class")
                           .when(F.col(sequence).isNull(), "no_sequence").otherwise("ordered"))


def search_verdict(targets: DataFrame, candidates: DataFrame, key: str, threshold: float = P.FOLD_THRESHOLD) -> DataFrame:
    """Outcome of a primer search per target (DEC-26). candidates: (key, fold, arms)."""
    c = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(~F.col("arms"), F.col("fold"))).alias("plain"),
                                    F.max(F.when(F.col("arms"), F.col("fold"))).alias("with_arms"))
    d = targets.join(c, key, "left")
    verdict = (F.when(F.col("n").isNull(), "NO CANDIDATE").when(F.col("plain").isNull() & F.col("with_arms").isNull(), "NONE MEASURABLE")
               .when(F.col("plain") >= threshold, "SOLVED").when(F.col("with_arms") >= threshold, "SOLVED WITH ARMS").otherwise("NOT SOLVED"))
    return d.withColumn("verdict", verdict).withColumn("best", F.greatest("plain", "with_arms"))
