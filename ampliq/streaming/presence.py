"""New reads as a stream: product counts per pair and bin (our extension; batch semantics)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import products, sites

READ_SCHEMA = "read_id long, bin string, library string, seq string"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(READ_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def presence_increments(batch: DataFrame, panel: DataFrame, lo: int, hi: int, max_mm: int, lengths: tuple[int, int]) -> DataFrame:
    """Counts of one micro-batch: (pair, bin, k)."""
    s = sites.seeded_sites(batch, panel, max_mm, shortest=lengths[0], longest=lengths[1])
    best = products.best_products(products.products(s, lo, hi), first_strand_wins=True)
    return best.join(batch.select("read_id", "bin"), "read_id").groupBy("pair", "bin").agg(F.count(F.lit(1)).alias("k"))


def start_presence(stream: DataFrame, panel: DataFrame, out: str, checkpoint: str, lo: int = 60, hi: int = 400,
                   max_mm: int = 1, lengths: tuple[int, int] = (18, 25), event_time: str | None = None, late: str = "1 day"):
    """Append increments, one folder per batch: re-running a batch overwrites its own folder, so a restart counts nothing twice.

    A read_id counts once, whichever batches it comes in: ids are stream state, kept in the checkpoint. With ``event_time`` (a timestamp column)
    an id is kept for ``late`` after the watermark only, so state has a bound where copies come that close together; without one it is
    kept for good and grows with the ids.
    """
    once = stream.dropDuplicates(["read_id"]) if event_time is None else stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["read_id"])

    def sink(batch: DataFrame, batch_id: int) -> None:
        presence_increments(batch, panel, lo, hi, max_mm, lengths).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return once.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("pair", "bin").agg(F.sum("k").alias("k"))
