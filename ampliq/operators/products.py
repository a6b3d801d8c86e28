"""In-silico PCR products from binding sites (JOIN-05..09, JOIN-11, JOIN-24, JOIN-25)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S


def products(sites: DataFrame, lo: int, hi: int, non_overlapping: bool = True) -> DataFrame:
    """Every product: left and right sites of one read, pair and strand within the window.

    A band join: the right site's end lies within ``hi`` of the left start, so both sides
    are cut into ``hi``-wide buckets and a left site meets its own and the next bucket.
    """
    keys = ["read_id", "pair", "strand"]
    left = sites.where(F.col("side") == "L").select(
        *keys, F.col("start").alias("l_start"), F.col("site_len").alias("l_len"), F.col("mm").alias("l_mm"),
        F.explode(F.array(F.floor(F.col("start") / hi), F.floor(F.col("start") / hi) + 1)).alias("cell"))
    right = sites.where(F.col("side") == "R").select(
        *keys, F.col("start").alias("r_start"), (F.col("start") + F.col("site_len")).alias("r_end"),
        F.col("mm").alias("r_mm"), F.floor((F.col("start") + F.col("site_len")) / hi).alias("cell"))
    size = F.col("r_end") - F.col("l_start")
    cond = size.between(lo, hi)
    if non_overlapping:
        cond = cond & (F.col("r_start") >= F.col("l_start") + F.col("l_len"))
    out = left.join(right, [*keys, "cell"]).where(cond)
    return out.select(*keys, "l_start", F.col("r_end").alias("end"), size.alias("bp"), "l_mm", "r_mm")


def best_products(prods: DataFrame, keys=("read_id", "pair"), first_strand_wins: bool = False) -> DataFrame:
    """One product per key: fewest total mismatches, then '+', then leftmost, then shortest.

    The minimum is partially aggregated before its shuffle. ``first_strand_wins`` reports
    '+' whenever that strand has a product, whatever '-' offers.
    """
    total = (F.col("l_mm") + F.col("r_mm")).alias("mm")
    strand = F.when(F.col("strand") == "+", 0).otherwise(1).alias("strand_order")
    first = [strand, total] if first_strand_wins else [total, strand]
    best = F.min(F.struct(*first, "l_start", "bp", "l_mm", "r_mm", "strand", "end")).alias("b")
    return prods.groupBy(*keys).agg(best).select(
        *keys, "b.strand", "b.l_start", "b.end", "b.bp", "b.l_mm", "b.r_mm", "b.mm")


def excise(prods: DataFrame, reads: DataFrame) -> DataFrame:
    """Product substring, primers included, written in the fwd-to-rev direction (JOIN-24)."""
    cut = F.substring(F.col("seq").cast("binary"), F.col("l_start") + 1, F.col("bp")).cast("string")
    return prods.join(reads.select("read_id", "seq"), "read_id").withColumn(
        "product", F.when(F.col("strand") == "-", S.revcomp(cut)).otherwise(cut)).drop("seq")


def coverage(prods: DataFrame, records: DataFrame, min_len: int, pairs: DataFrame) -> DataFrame:
    """Share of records that give a product, with the length histogram (JOIN-08).

    ``records`` is (read_id, seq); records under ``min_len`` leave both counts.
    """
    eligible = records.where(F.length("seq") >= min_len).select("read_id")
    best = best_products(prods).join(eligible, "read_id", "left_semi")
    hist = best.groupBy("pair", "bp").count().groupBy("pair").agg(
        F.sum("count").alias("with_product"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("bp", "count")))).alias("lengths"))
    total = eligible.agg(F.count(F.lit(1)).alias("records"))
    return (pairs.select("pair").join(hist, "pair", "left").join(F.broadcast(total))
            .select("pair", F.coalesce("with_product", F.lit(0)).alias("with_product"), "records", "lengths"))


def global_scan(sites: DataFrame, records: DataFrame, lo: int, hi: int, total_mm: int, evidence: int = 300):
    """Off-target scan without a 3' rule (JOIN-09): (class counters per pair, evidence rows).

    sites: all sites with at most ``total_mm`` mismatches, no exact tail; records: (read_id,
    class). The best product of a record counts once. Evidence keeps the best rows of every
    pair as a report; the counters are over everything.
    """
    from .lineage import class_counters
    from .ranking import top_n
    p = products(sites, lo, hi).where(F.col("l_mm") + F.col("r_mm") <= total_mm)
    best = best_products(p).join(records.select("read_id", "class"), "read_id")
    rows = top_n(best, ["pair"], [F.col("mm"), F.col("read_id")], evidence)
    return class_counters(best, ["pair"], "class"), rows
