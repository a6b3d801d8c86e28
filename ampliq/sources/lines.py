"""Numbered lines of splittable text files.

Formats whose records span lines need line numbers. A text file is read in splits; inside a
split rows keep their order, so a line number is the number of lines in earlier splits of the
file plus the position inside the split. The offsets table has one row per split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block, line_no (0-based), value"""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    raw = raw.withColumn("_id", F.monotonically_increasing_id())
    splits = raw.groupBy("file", "block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return raw.join(offsets, ["file", "block"]).select(
        "file", "block", (F.col("_id") - F.col("_first") + F.col("_off")).alias("line_no"), F.rtrim("value").alias("value"))
