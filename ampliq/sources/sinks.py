"""Writers (SNK family). Parquet is the record; text formats are exports at the edge."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, decimal_comma: bool = False) -> None:
    """Tab-separated export with a header (SNK-01); decimals may be shown with a comma."""
    out = df
    if decimal_comma:
        for name, kind in df.dtypes:
            if kind in ("double", "float"):
                out = out.withColumn(name, F.regexp_replace(F.col(name).cast("string"), "\\.", ","))
    out.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_fastq(reads: DataFrame, path: str, task_rows: int = 250_000) -> None:
    """One folder of FASTQ text per library and bin; unassigned reads go to '_unassigned',
    fragments to '_fragments', nothing is dropped (SNK-02).

    Rows are spread by read hash inside each bin over as many tasks as its count asks for, so a
    bin holding a third of all reads is written by many.
    """
    bin_ = F.when(F.coalesce("fragment", F.lit(False)), "_fragments").otherwise(F.coalesce("bin", F.lit("_unassigned")))
    text = F.concat(F.lit("@"), "read_id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")
    out = reads.select("library", bin_.alias("bin"), text.alias("value"), F.col("read_id"))
    tasks = out.groupBy("library", "bin").agg(F.ceil(F.count(F.lit(1)) / task_rows).alias("_tasks"))  # one row per bin
    out = out.join(F.broadcast(tasks), ["library", "bin"])
    out = out.repartition(F.col("library"), F.col("bin"), F.pmod(F.xxhash64("read_id"), F.col("_tasks"))).drop("read_id", "_tasks")
    out.write.mode("overwrite").partitionBy("library", "bin").text(path)


def write_long(tables: dict[str, DataFrame], path: str) -> None:
    """Presentation exports as long tables: one folder per sheet (stands in for SNK-04)."""
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{path}/{name}", sep="\t", header=True)


class Refused(ValueError):
    """An output that was written, looked at, and not accepted."""


def write_accepted(df: DataFrame, path: str, min_rows: int = 1, required: list[str] = (), rules: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` and accept it only if it holds what is asked (AUD-06): one row (run, rows, bad, accepted).

    The numbers are observed by the job that writes: rows, and per rule the rows that break it (``required`` columns are not null, ``rules`` are SQL
    conditions by name). A run has its own folder; accepting it is one row of the manifest beside them, so readers never see a refused or
    half-written run, and the run before stays in place. Raises ``Refused`` otherwise.
    """
    spark = df.sparkSession
    broken = {f"null_{c}": f"`{c}` IS NULL" for c in required} | {n: f"NOT coalesce({r}, false)" for n, r in (rules or {}).items()}
    seen, run = Observation(), uuid.uuid4().hex
    counts = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.expr(c)).alias(n) for n, c in broken.items()]]
    df.observe(seen, *counts).write.parquet(f"{path}/runs/{run}")
    got = seen.get
    bad = {n: got[n] for n in broken if got[n]}
    if got["rows"] < min_rows or bad:
        raise Refused(f"{got['rows']} rows, {min_rows} asked; broken: {bad or 'nothing'}")
    entry = spark.range(1).select(F.lit(run).alias("run"), F.lit(got["rows"]).cast("long").alias("rows"), F.current_timestamp().alias("at"))
    entry.coalesce(1).write.mode("append").parquet(f"{path}/accepted")
    return entry.select("run", "rows")


def read_accepted(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last accepted run."""
    last = spark.read.parquet(f"{path}/accepted").agg(F.max_by("run", "at")).first()[0]
    return spark.read.parquet(f"{path}/runs/{last}")
