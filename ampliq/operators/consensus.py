"""Column-vote consensus (AGG-05..07, AGG-22, SEQ-17, ALN-03, MTH-07 helpers).

Votes are (key, col, base[, weight]) rows. They are summed per (key, column, base) first,
so a bin with a third of all reads still shuffles at most four rows per column and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as M
from . import kmers as K

SEGMENT = 64


def column_votes(reads: DataFrame, key: str, seq: str = "seq", offset: Column | None = None) -> DataFrame:
    """One vote per base of every read at its template column (0-based).

    Sequences are first cut into short segments so that no slice walks a long string.
    """
    n = F.length(seq)
    at = offset if offset is not None else F.lit(0)
    cut = reads.select(key, at.alias("_at"), F.col(seq).cast("binary").alias("_b"), F.explode_outer(
        F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("i"))
    votes = cut.where(F.col("i").isNotNull()).select(
        key, (F.col("_at") + F.col("i")).alias("col"),
        F.substring("_b", F.col("i") + 1, F.lit(1)).cast("string").alias("base"))
    return votes.where(F.col("base").isin("A", "C", "G", "T"))


def tally(votes: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    if weight:
        aggs.append(F.sum(weight).alias("w"))
    return votes.groupBy(*keys, "col", "base").agg(*aggs)


def dominant_alleles(counts: DataFrame, keys: list[str], min_depth: int = 20, min_share: float = 0.50) -> DataFrame:
    """Base per column: N when shallow, tied, or under the share; Wilson lower bound kept (AGG-06)."""
    per = counts.groupBy(*keys, "col").agg(
        F.sum("n").alias("depth"), F.max("n").alias("top"),
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), F.col("base").alias("b")))).alias("alleles"))
    tied = F.size(F.filter("alleles", lambda a: a["neg"] == -F.col("top"))) > 1
    share = F.col("top") / F.col("depth")
    shallow = F.col("depth") < min_depth
    return per.select(
        *keys, "col", "depth",
        F.when(shallow | tied | (share < min_share), "N").otherwise(F.get("alleles", F.lit(0))["b"]).alias("base"),
        F.when(~shallow, share).otherwise(F.lit(0.0)).alias("share"),
        F.when(~shallow & ~tied, M.wilson_lower("top", "depth")).otherwise(F.lit(0.0)).alias("low"))


def two_method_consensus(counts: DataFrame, keys: list[str], min_depth: int = 5,
                         weight_share: float = 0.5, count_share: float = 0.5) -> DataFrame:
    """Quality-weighted and plain votes; a base stands only where both agree (AGG-05).

    counts: (keys, col, base, n, w).
    """
    g = counts.groupBy(*keys, "col").agg(
        F.sum("n").alias("depth"), F.sum(F.col("w").cast("decimal(18,6)")).cast("double").alias("tw"),
        F.min(F.struct((-F.col("w")).alias("neg"), F.col("base").alias("b"))).alias("mw"),
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("base").alias("b"))).alias("mn"))
    deep = F.col("depth") >= min_depth
    a = F.when(deep & (-F.col("mw.neg") / F.col("tw") >= weight_share), F.col("mw.b")).otherwise("N")
    b = F.when(deep & (-F.col("mn.neg") / F.col("depth") >= count_share), F.col("mn.b")).otherwise("N")
    return g.select(*keys, "col", "depth", a.alias("weighted"), b.alias("plain"),
                    F.when(a == b, a).otherwise("N").alias("base"))


def spell(columns: DataFrame, keys: list[str], base: str = "base", width: int = 1000) -> DataFrame:
    """Write the per-column bases as one sequence per key; uncalled columns are N.

    Columns are joined in ``width``-wide pieces first, then the pieces are joined.
    """
    piece = F.floor(F.col("col") / width)
    p = columns.groupBy(*keys, piece.alias("piece")).agg(F.array_sort(F.collect_list(F.struct("col", base))).alias("c"))
    filled = F.aggregate(
        F.col("c"), F.struct((F.col("piece") * width).cast("long").alias("next"), F.lit("").alias("s")),
        lambda acc, x: F.struct(
            (x["col"] + 1).cast("long").alias("next"),
            F.concat(acc["s"], F.repeat(F.lit("N"), (x["col"] - acc["next"]).cast("int")), x[base]).alias("s")))
    p = p.select(*keys, "piece", filled["s"].alias("s"))
    last = Window.partitionBy(*keys)
    p = p.withColumn("s", F.when(F.col("piece") < F.max("piece").over(last), F.rpad("s", width, "N")).otherwise(F.col("s")))
    g = p.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("piece", "s"))).alias("c"))
    full = F.aggregate("c", F.struct(F.lit(0).cast("long").alias("next"), F.lit("").alias("s")), lambda acc, x: F.struct(
        (x["piece"] + 1).cast("long").alias("next"),
        F.concat(acc["s"], F.repeat(F.lit("N"), ((x["piece"] - acc["next"]) * width).cast("int")), x["s"]).alias("s")))
    return g.select(*keys, full["s"].alias("consensus"))


def trim_ends(seq) -> Column:
    """Outer N are trimmed, inner N stay."""
    return F.regexp_replace(seq, "^N+|N+$", "")


def modal_length_products(prods: DataFrame, key: str, seq: str) -> DataFrame:
    """Products of the most frequent length per key, ties to the shorter (AGG-07)."""
    c = prods.groupBy(key, F.length(seq).alias("len")).agg(F.count(F.lit(1)).alias("n"))
    modal = c.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("len"))).alias("m"),
                               F.count(F.lit(1)).alias("lengths")).select(
        key, F.col("m.len").alias("len"), (-F.col("m.neg")).alias("n_products"), "lengths")
    return prods.withColumn("len", F.length(seq)).join(modal, [key, "len"])


def occupied_columns(msa: DataFrame, keys: list[str], min_share: float) -> DataFrame:
    """Alignment columns filled in at least ``min_share`` of the rows, with their consensus
    position and majority base (SEQ-17). msa: (keys, row, seq) with '-' gaps."""
    rows = msa.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    v = msa.select(*keys, F.posexplode(F.split("seq", "")).alias("col", "base")).where(F.col("base") != "-")
    c = v.groupBy(*keys, "col", "base").agg(F.count(F.lit(1)).alias("n"))
    g = c.groupBy(*keys, "col").agg(F.sum("n").alias("filled"), F.min(F.struct(
        (-F.col("n")).alias("neg"), F.col("base").alias("b"))).alias("m")).join(rows, keys)
    g = g.where(F.col("filled") / F.col("rows") >= min_share)
    return g.select(*keys, "col", F.col("m.b").alias("base"), "filled", (F.row_number().over(
        Window.partitionBy(*keys).orderBy("col")) - 1).alias("pos"))


def quality_gate(consensus, diverging, max_n_percent: float = 20.0, max_diverging: int = 15) -> Column:
    """NULL when a regenerated consensus is usable, else the reason (AGG-22)."""
    s = F.col(consensus) if isinstance(consensus, str) else consensus
    n_pct = 100.0 * F.length(F.regexp_replace(s, "[^N]", "")) / F.length(s)
    return F.when(n_pct > max_n_percent, "too_many_n").when(F.col(diverging) > max_diverging, "methods_diverge")


def anchored_diagonals(reads: DataFrame, templates: DataFrame, k: int, part: str, key: str, top: int = 8, min_hits: int = 3) -> DataFrame:
    """K-mer hits grouped by diagonal; the best diagonals become segments (ALN-03).

    reads: (part, key, seq); templates: (part, seq), whose k-mers of the bases A, C, G, T that occur once per part are the index. Only read
    positions that hold one of them become rows; an index of up to ``K.BROADCAST_KMERS`` rows goes with the tasks, so they meet it where they are.
    """
    keys = [part, key]
    index = K.packed_index(templates, k, part).withColumnRenamed("pos", "tpos")
    hits = K.indexed_positions(reads, index, k, part, [key])
    hits = hits.join(F.broadcast(index) if index.count() <= K.BROADCAST_KMERS else index.hint("merge"), [part, "word"]).withColumn("diag", F.col("tpos") - F.col("pos"))
    d = hits.groupBy(*keys, "diag").agg(F.count(F.lit(1)).alias("hits"), F.min("tpos").alias("t_start"),
                                        F.max("tpos").alias("t_end")).where(F.col("hits") >= min_hits)
    w = Window.partitionBy(*keys).orderBy(F.desc("hits"), "diag")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
