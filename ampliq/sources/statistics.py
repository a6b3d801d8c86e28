"""Record statistics that are kept between runs (SRC-14).

A store holds one row per file: size, modification time, records and bases. A refresh lists the files, measures those that are new or have
changed, and accepts the next version of the store; unchanged files are not opened. A refresh that fails leaves the version before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .readers import read_fasta
from .sinks import read_accepted, write_accepted

STORE = "file string, modified timestamp, bytes long, records long, bases long"
#: Measures the files it is given: (file, records, bases).
Measure = Callable[[SparkSession, list[str]], DataFrame]


def listing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, modified, bytes) of every file under a path or matching a pattern; contents are not read."""
    m = F.col("_metadata")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        m["file_path"].alias("file"), m["file_modification_time"].alias("modified"), m["file_size"].alias("bytes"))


def _readable(file: str) -> str:
    """A listed file as a path to read: listings encode names, and a path may hold no pattern characters."""
    return re.sub(r"([\\*?{}\[\]])", r"\\\1", unquote(file))


def fasta_lengths(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, records, bases) of FASTA files; a header without bases is no record."""
    n = read_fasta(spark, files).withColumn("n", F.length("seq")).where("n > 0")
    return n.groupBy("file").agg(F.count(F.lit(1)).alias("records"), F.sum("n").cast("long").alias("bases"))


def column_lengths(column: str) -> Measure:
    """Measures Parquet files by the lengths of one column; null and empty values are no records."""

    def measure(spark: SparkSession, files: list[str]) -> DataFrame:
        n = spark.read.parquet(*files).select(F.col("_metadata.file_path").alias("file"), F.length(column).alias("n")).where("n > 0")
        return n.groupBy("file").agg(F.count(F.lit(1)).alias("records"), F.sum("n").cast("long").alias("bases"))

    return measure


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The accepted version of a store, without rows if there is none yet."""
    try:
        return read_accepted(spark, store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORE)


def refresh(spark: SparkSession, path: str | list[str], store: str, measure: Measure = fasta_lengths) -> int:
    """Bring ``store`` up to the files now under ``path``; returns how many were read.

    A file is unchanged if name, size and modification time are. Files that are gone leave the store, files without records stay with zeros.
    The driver sees the names of files to read, as for any scan. No version is written where nothing changed.
    """
    old = stored(spark, store)
    now = cut_lineage(listing(spark, path))
    key = ["file", "modified", "bytes"]
    todo = [_readable(r["file"]) for r in now.join(old, key, "left_anti").select("file").toLocalIterator()]
    kept = now.join(old, key)
    if not todo and kept.count() == old.count():
        return 0
    rows = kept.select(*key, "records", "bases")
    if todo:
        new = now.join(old, key, "left_anti").join(measure(spark, todo), "file", "left")
        zero = F.lit(0).cast("long")
        rows = rows.unionByName(new.select(*key, F.coalesce("records", zero).alias("records"), F.coalesce("bases", zero).alias("bases")))
    write_accepted(rows, store, min_rows=0, required=["file", "records", "bases"], rules={"not_negative": "records >= 0 AND bases >= records"})
    return len(todo)


def mean_length(spark: SparkSession, store: str) -> DataFrame:
    """(files, records, bases, mean): mean record length over all stored files; 1.0 where there are no bases, so that it can divide."""
    s = stored(spark, store).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("bases"), F.lit(0)).alias("bases"))
    return s.withColumn("mean", F.when(F.col("bases") > 0, F.col("bases") / F.col("records")).otherwise(1.0))
