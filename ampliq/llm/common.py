"""Helpers of the training-data operators: written tables, bounded broadcasts, skew-safe joins, components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of Arrow batches handed to Python: whole texts are long, so batches stay short.
BATCH_ROWS = 256
#: Largest number of rows that is broadcast after it was counted; ids and a few numbers, so a few tens of MB.
BROADCAST_ROWS = 1_000_000
#: At most so many groups are treated as hot, whatever the data: the bound of the hot side's broadcast.
HOT_GROUPS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local session without one gets a fresh folder."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        own = tempfile.mkdtemp(prefix="llm-shared-")  # a local session alone: goes with the process
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bounded(df: DataFrame) -> DataFrame:
    """A broadcast hint where the counted rows stay under ``BROADCAST_ROWS``; beyond, a shuffle join. ``df`` is narrow and written."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def attach(rows: DataFrame, info: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``info``, one row per ``key`` that counts its rows in ``size`` (their sum is ``total`` at most).

    Groups above total / HOT_GROUPS rows are at most HOT_GROUPS many, so they are broadcast and their rows stay where they
    are; all other groups are small and meet in a shuffle. Both frames should be written tables, as they are read twice.
    """
    limit = max(1, total // HOT_GROUPS)
    hot = F.broadcast(info.where(F.col(size) > limit))
    cold = info.where(F.col(size) <= limit)
    return (rows.join(hot, key).unionByName(
        rows.join(hot.select(key), key, "left_anti").join(cold.hint("merge"), key)))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) of the components of undirected links; root is the smallest node. A node in no link is absent.

    Rounds of large-star and small-star. A hub's rows are only ever reduced with min(), a partial aggregate, and the join
    back leaves a hot hub's rows where they are. Each round is written. Rounds grow with the logarithm of the longest
    path; more than ``max_rounds`` raises.
    """
    link = written(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct(), "links")
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    seen = link.agg(mark).first()
    for _ in range(max_rounds):
        # large star: of the neighbours of u, those above u go to the smallest
        both = link.unionByName(link.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "low")
        wide = attach(both, low, "u", "n", 2 * seen[0][0]).where("v > u")
        link = written(wide.select(F.col("m").alias("u"), "v").distinct(), "links")
        # small star: of the smaller neighbours of v, all go to the smallest
        down = written(link.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n")), "down")
        rest = link.join(down.where("n > 1").hint("merge"), "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        link = written(rest.unionByName(down.select(F.col("m").alias("u"), "v")).distinct(), "links")
        now = link.agg(mark).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return link.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        link.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct()


def groups(part: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of a sorted stream."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in part:
        if not len(batch):
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
            key = tuple(c[lo] for c in cols)
            if held and key != now:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def model_path(name: str) -> str:
    """Where a public tokenizer file lies: TOKENIZER_DIR, else the installed package. Never copied here."""
    if os.environ.get("TOKENIZER_DIR"):
        return os.path.join(os.environ["TOKENIZER_DIR"], name)
    import public_tokenizers
    return public_tokenizers.path(name)
