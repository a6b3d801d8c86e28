"""Audits and reconciliation (AUD family, AGG-27, ORC-02)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys present on one side only, with the side (AUD-01, AUD-12)."""
    left = a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti").withColumn("missing_in", F.lit("right"))
    right = b.select(*keys).distinct().join(a.select(*keys).distinct(), keys, "left_anti").withColumn("missing_in", F.lit("left"))
    return left.unionByName(right)


def differing_values(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows whose value differs, NULL-safely; absence on either side is a difference (AUD-01)."""
    j = a.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l")).join(
        b.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_r")), keys, "full_outer")
    return j.where(F.col("_l").isNull() | F.col("_r").isNull() | ~F.col("left_value").eqNullSafe(F.col("right_value"))).drop("_l", "_r")


def row_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table the other lacks, as multisets (AUD-04, AUD-08)."""
    cols = a.columns
    return a.exceptAll(b.select(*cols)).withColumn("side", F.lit("left")).unionByName(
        b.select(*cols).exceptAll(a).withColumn("side", F.lit("right")))


def alphabet_profile(records: DataFrame, key: str, seq: str) -> DataFrame:
    """U to T ratio and foreign letters per database (AUD-01 alphabet gate)."""
    def n(p):
        return F.sum(F.length(F.regexp_replace(F.upper(seq), p, "")).cast("long"))

    return records.groupBy(key).agg(n("[^U]").alias("u"), n("[^T]").alias("t"), n("[ACGTUN]").alias("foreign"), F.count(F.lit(1)).alias("records"))


def acceptance(df: DataFrame, min_rows: int, required: list[str]) -> DataFrame:
    """One row: enough rows and no required value empty (AUD-06)."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in required]).withColumn(
        "accepted", (F.col("rows") >= min_rows) & sum((F.col(f"null_{c}") == 0).cast("int") for c in required).__eq__(len(required)))


def access_proof(records: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Every configured database was read to its end and yields what is expected (AUD-13).

    records: (key, seq); expected: (key, min_records).
    """
    g = records.groupBy(key).agg(F.count(F.lit(1)).alias("records"), F.max(F.length("seq")).cast("long").alias("longest"))
    j = expected.join(g, key, "left")
    return j.select(key, F.coalesce("records", F.lit(0)).alias("records"), "longest",
                    F.when(F.col("records").isNull(), "NOT READ").when(F.col("records") < F.col("min_records"), "SHORT").otherwise("OK").alias("status"))


def foreign_members(members: DataFrame, close: DataFrame, allowed: DataFrame) -> DataFrame:
    """Members whose taxon lies outside the clade of their library (AUD-07).

    members: (library, taxon); close: (node, ancestor); allowed: (library, clade).
    """
    inside = close.select(F.col("node").alias("taxon"), F.col("ancestor").alias("clade")).join(allowed, "clade").select("library", "taxon")
    return members.join(inside.distinct(), ["library", "taxon"], "left_anti")


def four_columns(base: DataFrame, others: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Outer join of several (key, name) methods into one row per key (AUD-10)."""
    out = base
    for name, df in others:
        out = out.join(df.withColumnRenamed("name", name), key, "full_outer")
    return out


def status_counts(rows: DataFrame, cls: str, names: list[str]) -> DataFrame:
    """Counts of every named class, zeros included (AUD-14)."""
    frame = rows.sparkSession.createDataFrame([(n,) for n in names], f"{cls} string")
    return frame.join(rows.groupBy(cls).agg(F.count(F.lit(1)).alias("n")), cls, "left").na.fill(0, ["n"])


def remeasured(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Two measurements of the same rows and their difference in points (AGG-27, AUD-11)."""
    j = old.select(*keys, F.col("pct").alias("old_pct")).join(new.select(*keys, F.col("pct").alias("new_pct")), keys, "full_outer")
    return j.withColumn("delta", F.col("new_pct") - F.col("old_pct"))


def signature(rows: DataFrame, stage: str, inputs: list[str]) -> DataFrame:
    """Order-independent fingerprint of everything a stage reads (ORC-02).

    Row digests are summed as numbers, so the fingerprint needs no sort and no collection.
    """
    d = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in inputs])), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(stage).agg(F.sum(d).cast("string").alias("digest"), F.count(F.lit(1)).alias("rows")).select(
        stage, "rows", F.md5(F.concat_ws("|", F.col(stage).cast("string"), F.col("rows").cast("string"), "digest")).alias("signature"))


def stale_stages(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """Why each stage may or may not be skipped (ORC-02).

    manifest: (stage, signature, status, rows_out); current: (stage, signature).
    """
    j = current.join(manifest.withColumnRenamed("signature", "stamp"), "stage", "left")
    return j.select("stage", F.when(F.col("stamp").isNull(), "run: never").when(F.col("status") != "done", "run: unfinished")
                    .when(F.col("stamp") != F.col("signature"), "run: inputs changed").when(F.coalesce("rows_out", F.lit(0)) == 0, "run: empty output")
                    .otherwise("skip").alias("decision"))
