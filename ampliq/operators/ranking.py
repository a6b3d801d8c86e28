"""Ranking, sampling and order statistics (WIN family, MTH-07)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per key under a total order.

    row_number() <= n lets Spark keep only n rows per key in each task before the shuffle,
    so a key with a third of all rows still arrives as n rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def _cumulative(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values with the cumulative count below and including them.

    Windows run over distinct values only, however many rows share them.
    """
    vc = value_counts(df.where(F.col(value).isNotNull()), keys, value)
    w = Window.partitionBy(*keys).orderBy(value)
    total = Window.partitionBy(*keys)
    return (vc.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("total", F.sum("n").over(total)))


def exact_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median (mean of the middle two) from value counts."""
    c = _cumulative(df, keys, value)
    lo, hi = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    before = F.col("upto") - F.col("n")
    picks = c.where(((before < lo) & (F.col("upto") >= lo)) | ((before < hi) & (F.col("upto") >= hi)))
    return picks.groupBy(*keys).agg(((F.min(value) + F.max(value)) / 2.0).alias("median"))


def nth_value(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Element at index int(n * share) of the sorted values (0-based) (MTH-07)."""
    c = _cumulative(df, keys, value)
    at = F.floor(F.col("total") * share) + 1
    at = F.least(at, F.col("total"))
    picks = c.where((F.col("upto") >= at) & (F.col("upto") - F.col("n") < at))
    return picks.select(*keys, F.col(value).alias("value"))


def hash_sample(df: DataFrame, keys: list[str], id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n rows per key, chosen by hash of the id: repeatable on any partitioning."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    return top_n(df.withColumn("_h", h), keys, [F.col("_h"), F.col(id_col)], n).drop("_h", "rank")


def systematic_sample(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Every (N // n)-th row of each key in the given order (WIN-10).

    Positions come from a range count rather than one window per key: rows are bucketed between
    approximate quantiles of the order value, so outliers leave the buckets even; buckets are
    counted, and only they are numbered together. The bounds decide the split, not the result.
    """
    cuts = F.percentile_approx(order, [i / 256 for i in range(1, 256)], 4096)
    # written once: the bounds depend on the order of merging, and both uses below must see the same ones
    bounds = cut_lineage(df.groupBy(*keys).agg(cuts.alias("_cuts"), F.count(F.lit(1)).alias("_n")))

    def met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:  # a null key is a key
        r = right.withColumnsRenamed({k: f"{k}_r" for k in on})
        return left.join(r, reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in on])).drop(*[f"{k}_r" for k in on])

    b = met(df, bounds, keys).withColumn("_b", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(order))), F.lit(0)))
    per = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    off = per.withColumn("_off", F.coalesce(F.sum("_c").over(
        Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    pos = met(b, off, [*keys, "_b"]).withColumn("_p", F.col("_off") + F.row_number().over(
        Window.partitionBy(*keys, "_b").orderBy(order)) - 1)
    step = F.greatest(F.floor(F.col("_n") / n), F.lit(1))
    return pos.where(F.col("_p") % step == 0).drop("_cuts", "_n", "_b", "_off", "_p")
