"""Lineages and taxon trees (GRF-02, GRF-03, GRF-08, GRF-09, SNK-05, TAX-18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def class_counters(hits: DataFrame, keys: list[str], cls: str) -> DataFrame:
    """Side-by-side counts per hit class; only known outside hits count as off clade (AGG-12)."""
    def n(*names):
        return F.count(F.when(F.col(cls).isin(*names), 1))

    return hits.groupBy(*keys).agg(
        n("in").alias("n_in"), n("organelle").alias("n_organelle"), n("same_domain").alias("n_same"),
        n("other_domain").alias("n_other"), n("unknown").alias("n_unknown"),
        n("same_domain", "other_domain").alias("off_clade"))


def rank_consensus(df: DataFrame, key: str, ranks: str, threshold: float) -> DataFrame:
    """Rank by rank majority lineage, stopping at the first rank below the share (GRF-08).

    The denominator is the number of rank lists of the key, not the lists that reach the rank.
    """
    # place 0 stands for the list itself, so one pass counts lists and names
    listed = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(ranks, F.array().cast("array<string>")))
    c = df.where(F.col(key).isNotNull()).select(key, F.posexplode(listed).alias("_pos", "_name")).groupBy(key, "_pos", "_name").agg(F.count(F.lit(1)).alias("_k"))
    best = c.groupBy(key, "_pos").agg(F.min(F.struct((-F.col("_k")).alias("neg"), F.col("_name").alias("name"))).alias("_m"))
    g = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("_pos").alias("pos"), F.col("_m.name").alias("name"), F.col("_m.neg").alias("neg")))).alias("steps"))
    g = g.where(F.size("steps") > 1).select(key, F.get("steps.neg", F.lit(0)).alias("_n"), F.slice("steps", F.lit(2), F.size("steps")).alias("steps"))
    g = g.select(key, F.transform("steps", lambda s: F.struct(s["name"].alias("name"), (s["neg"] / F.col("_n")).alias("share"))).alias("steps"))
    stop = F.array_position(F.transform("steps", lambda s: s["share"] < threshold), True)
    kept = F.when(stop == 0, F.col("steps")).otherwise(F.slice("steps", F.lit(1), F.greatest(stop.cast("int") - 1, F.lit(0))))
    return g.select(key, F.concat_ws(";", F.transform(kept, lambda s: s["name"])).alias("lineage"))


def dominant_lineage(df: DataFrame, key: str, lineage: str) -> DataFrame:
    """Most frequent full lineage per key, ties by text (GRF-09); never a common prefix."""
    c = df.where(F.size(lineage) > 0).groupBy(key, lineage).agg(F.count(F.lit(1)).alias("_k"))
    best = c.groupBy(key).agg(F.min(F.struct((-F.col("_k")).alias("neg"), F.concat_ws(";", lineage).alias("t"),
                                             F.col(lineage).alias("l"))).alias("_m"))
    return best.select(key, F.col("_m.l").alias("dominant"))


def path_nodes(df: DataFrame, ranks: str) -> DataFrame:
    """One node per distinct lineage path: the same name under two parents is two nodes (SNK-05)."""
    p = df.where(F.size(ranks) > 0).select(
        F.col(ranks).alias("r"), F.explode(F.sequence(F.lit(1), F.size(ranks))).alias("depth"))
    p = p.select(F.concat_ws(";", F.slice("r", F.lit(1), F.col("depth"))).alias("path"), "depth").distinct()
    return (p.withColumn("parent", F.when(F.col("depth") > 1, F.regexp_replace("path", ";[^;]*$", "")))
            .withColumn("name", F.regexp_extract("path", "[^;]*$", 0)))


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, dist) including the node itself, by repeated squaring.

    ``edges`` is (child, parent) of a forest; a root may name itself. Each round joins paths of
    length d with all paths, so depth D needs log2(D) joins. A node that reaches itself raises.
    """
    edges = edges.where("child <> parent")
    nodes = edges.select(F.col("child").alias("node")).union(edges.select(F.col("parent").alias("node"))).distinct()
    step = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("dist"))
    reach, d = step, 1
    while True:
        jump = reach.select(F.col("node").alias("mid"), F.col("ancestor").alias("top"), F.col("dist").alias("d2"))
        longer = (reach.where(F.col("dist") == d).join(jump, reach["ancestor"] == jump["mid"])
                  .select("node", F.col("top").alias("ancestor"), (F.col("dist") + F.col("d2")).alias("dist")))
        longer = cut_lineage(longer)
        if longer.isEmpty():
            break
        if not longer.where("node = ancestor").isEmpty():
            raise ValueError("the edges hold a cycle")
        reach = reach.unionByName(longer)
        d *= 2
    return nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("dist")).unionByName(reach)


def clade_rollup(counts: DataFrame, close: DataFrame) -> DataFrame:
    """Counts of every node added to all its ancestors (GRF-03): clade = own + below.

    Leaves are summed per node before the join, so the root (an ancestor of every row)
    receives one partial row per task, not one per read.
    """
    own = counts.groupBy("node").agg(F.sum("n").alias("n"))
    return own.join(close, "node").groupBy(F.col("ancestor").alias("node")).agg(
        F.sum("n").alias("clade"), F.sum(F.when(F.col("dist") == 0, F.col("n")).otherwise(0)).alias("direct"))


def parents_from_order(rows: DataFrame, file: str, pos: str, depth: str, node: str) -> DataFrame:
    """Parent of each indented row: the last earlier row that is one level up (SRC-07).

    Each row stands in the window of its own level as a possible parent and in that of the
    level above as a child that looks back, so any depth takes two rows and one window.
    """
    stood = rows.withColumn("_level", F.col(depth)).withColumn("_v", F.col(node)).withColumn("_asks", F.lit(False))
    asks = rows.withColumn("_level", F.col(depth) - 1).withColumn("_v", F.lit(None).cast(rows.schema[node].dataType)).withColumn("_asks", F.lit(True))
    w = Window.partitionBy(file, "_level").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    seen = stood.unionByName(asks).withColumn("parent", F.last("_v", ignorenulls=True).over(w))
    return seen.where("_asks").drop("_level", "_v", "_asks")


def one_reference_hits(hits: DataFrame, key: str, band: float = 1.0) -> DataFrame:
    """Hits a lineage is agreed on (GRF-08): those of the reference that gave the best identity, ties by
    the longer alignment and then the reference that sorts first, within ``band`` points of its best.

    hits: (key, reference, identity, aligned, target); rank orders them by identity, alignment, target.
    """
    first = hits.groupBy(key).agg(F.min(F.struct((-F.col("identity")).alias("i"), (-F.col("aligned")).alias("a"), "reference")).alias("m")).select(
        key, F.col("m.reference").alias("reference"), (-F.col("m.i")).alias("_top"))
    kept = hits.join(first, [key, "reference"]).where(F.col("identity") >= F.col("_top") - band)
    w = Window.partitionBy(key).orderBy(F.desc("identity"), F.desc("aligned"), "target")
    return kept.withColumn("rank", F.row_number().over(w)).drop("_top")
