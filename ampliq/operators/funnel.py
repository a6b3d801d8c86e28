"""From all windows of a backbone to the pairs worth ordering, with every cut counted (OPT-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..functions import predicates as X
from ..session import cut_lineage
from . import design as D
from . import group_design as G
from . import kmers as K
from .ranking import top_n


class Funnel:
    """Stages whose rows are counted by the jobs that make them: an observation rides on each stage's plan, no stage is counted again."""

    def __init__(self) -> None:
        self.stages: list[tuple[str, Observation]] = []

    def through(self, name: str, df: DataFrame) -> DataFrame:
        seen = Observation(name)
        self.stages.append((name, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("n"))

    def table(self, spark: SparkSession) -> DataFrame:
        """(step, stage, rows_in, rows_out, cut); asks for stages whose jobs have run, and waits for them otherwise."""
        out, before = [], None
        for step, (name, seen) in enumerate(self.stages):
            n = seen.get["n"]
            out.append((step, name, before, n, None if before is None else before - n))
            before = n
        return spark.createDataFrame(out, "step int, stage string, rows_in long, rows_out long, cut long")


def design_funnel(backbones: DataFrame, reads: DataFrame, rules: G.Rules = G.Rules(), per_cell: int = 8, to_sample: int = 60, keep: int = 20) -> tuple[DataFrame, Funnel]:
    """(chosen pairs, funnel): windows, rules, grid cells, pairs, representatives per cell, picks for the sample, pairs with a product there, the best kept.

    The caps are the reference's own and are parameters. A pair is measured by the reads in which it forms a product; the best of a target are
    those with the most reads, then the strictest cell, then place. backbones: (target, seq); reads: (read_id, seq).
    """
    f = Funnel()
    w = f.through("windows", K.windows(backbones, *rules.lengths, keep=["target"]))
    w = f.through("rules", w.where(X.invariant_oligo_ok("oligo")))
    w = w.withColumn("m", D.measures("oligo")).select("target", "pos", "len", "dir", "oligo", "m.gc", "m.tm", "m.pm")
    cand = cut_lineage(f.through("grid cells", w.where("pm <> 0")))
    pairs = f.through("pairs", D.pair_band(cand, *rules.product))
    reps = f.through("representatives", D.cell_representatives(pairs, per_cell))
    reps = reps.withColumnRenamed("rank", "turn")
    picks = f.through("picked for the sample", top_n(reps, ["target"], [F.col("turn"), F.col("strictness"), F.col("cell")], to_sample, rank="pick"))
    picks = cut_lineage(picks.select(F.col("target").alias("grp"), F.concat_ws("-", "f_pos", "r_end", "fwd", "rev").alias("pair"), "fwd", "rev", "f_pos", "r_end", "bp", "strictness", "cell"))
    oligos = picks.select(F.col("fwd").alias("oligo")).unionByName(picks.select(F.col("rev").alias("oligo"))).distinct()
    found = cut_lineage(G.oligo_sites(reads.select(F.col("read_id").alias("seq_id"), "seq"), oligos, rules))
    n = G.pair_products(picks, found, *rules.product).groupBy("grp", "pair").agg(F.count(F.lit(1)).alias("reads"))
    measured = f.through("amplify in the sample", picks.join(n, ["grp", "pair"]))
    best = top_n(measured, ["grp"], [F.desc("reads"), F.col("strictness"), F.col("f_pos"), F.col("r_end"), F.col("pair")], keep)
    return cut_lineage(f.through("kept", best)).withColumnRenamed("grp", "target"), f
