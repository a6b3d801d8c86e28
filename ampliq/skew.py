"""Plans that survive one key holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
                task_rows: int | None = None, spread: Column | None = None) -> DataFrame:
    """Equi-join in which keys of ``left`` with more rows than a task should have are split.

    Row counts per key come from a partially aggregated count, so finding the hot keys costs no
    skewed shuffle. A key is split over count / ``task_rows`` tasks; by default a task's share is
    half of the rows over the shuffle partitions. Rows of ``right`` are repeated for hot keys only.
    ``left`` must be the side whose rows are preserved (inner, left, left_semi, left_anti).
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if task_rows is None:
        total = counts.agg(F.sum("_n")).first()[0] or 0
        task_rows = max(10_000, total // (2 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # at most total / task_rows keys are hot; Spark's own size check decides how to join them
    hot = counts.where(F.col("_n") > task_rows).withColumn("_n", F.ceil(F.col("_n") / task_rows))
    spread = spread if spread is not None else F.xxhash64(*[F.col(c) for c in left.columns])
    lhs = (left.join(hot, keys, "left")
           .withColumn("_salt", F.pmod(spread, F.coalesce(F.col("_n"), F.lit(1)).cast("long")))
           .drop("_n"))
    rhs = (right.join(hot, keys, "left")
           .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_n"), F.lit(1)) - 1))).drop("_n"))
    return lhs.join(rhs, [*keys, "_salt"], how).drop("_salt")
