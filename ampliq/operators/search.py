"""Searches whose trials are rows: racing of candidates (OPT-06) and plate assignment (OPT-05)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import stats as M
from ..session import cut_lineage
from .ranking import hash_sample, top_n

#: Hits of each candidate among the reads of its target: (target, cand, k, n).
Measure = Callable[[DataFrame, DataFrame], DataFrame]


def race(reads: DataFrame, candidates: DataFrame, measure: Measure, depth: int = P.SAMPLE_READS, z: float = P.WILSON_Z) -> DataFrame:
    """(target, cand, k, n, low, raced, kept, rows_read, rows_in_full): the best candidate of every target (OPT-06).

    All candidates are measured on ``depth`` reads per target, chosen by hash; those whose upper Wilson bound lies under the best lower
    bound of their target leave, the others are measured on all reads. The best is the highest lower bound, then rate, then name. ``z`` is
    how sure a bound is: the larger it is, the surer a winner of the full measurement stays in the race. rows_read counts what both
    measurements looked at, rows_in_full what measuring everybody on everything would have.

    reads: (target, read_id, ...); candidates: (target, cand, ...).
    """
    def bounds(found: DataFrame, z: float) -> DataFrame:
        return found.withColumn("low", M.wilson_lower("k", "n", z)).withColumn("high", M.wilson_upper("k", "n", z))

    quick = cut_lineage(bounds(measure(hash_sample(reads, ["target"], "read_id", depth), candidates), z))
    best = quick.groupBy("target").agg(F.max("low").alias("best_low"), F.sum("n").alias("quick_rows"), F.count(F.lit(1)).alias("raced"))
    stay = cut_lineage(quick.join(best, "target").where("high >= best_low").select("target", "cand"))
    full = cut_lineage(bounds(measure(reads, candidates.join(stay, ["target", "cand"], "left_semi")), P.WILSON_Z))
    read = full.groupBy("target").agg(F.sum("n").alias("full_rows"), F.count(F.lit(1)).alias("kept"), F.max("n").alias("depth"))
    win = top_n(full, ["target"], [F.desc("low"), F.desc(F.col("k") / F.col("n")), F.col("cand")], 1)
    return win.join(best, "target").join(read, "target").select(
        "target", "cand", "k", "n", F.round("low", 9).alias("low"), "raced", "kept", (F.col("quick_rows") + F.col("full_rows")).alias("rows_read"),
        (F.col("raced") * F.col("depth")).alias("rows_in_full"))


def draw(*parts: Column) -> Column:
    """A number of 32 bits that depends on ``parts`` only, the same on any partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def clashes(rows: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """(keys, clashes): pairs of rows of a key whose ``bp`` differ by less than ``gap``, counted by a range of the sorted lengths."""
    near = Window.partitionBy(*keys).orderBy("bp").rangeBetween(-(gap - 1), gap - 1)
    n = rows.withColumn("near", F.count(F.lit(1)).over(near) - 1)
    return n.groupBy(*keys).agg((F.sum("near") / 2).cast("long").alias("clashes"), F.count(F.lit(1)).alias("size"))


def assign_plates(targets: DataFrame, plates: DataFrame, trials: int = 20_000, gap: int = 10, slack: float = 0.6, chunk: int = 1_000_000) -> DataFrame:
    """(target, plate, proposed, seed, before, after): the best of ``trials`` random assignments of targets to plates (OPT-05).

    A target may go on plates whose annealing temperature is at most its lower Tm less ``P.TA_RULE`` and the measurement's ``slack``; a
    target with none stays where it is. A trial is a seed, its choices are drawn by hash of (seed, target), and it counts if every plate has
    two targets at least and at most half of all plus two. The fewest clashes win (products closer than ``gap`` on one plate), ties
    the smaller seed; if no trial beats the assignment as it is, that stays (seed null). Seeds are tried in runs of ``chunk`` rows, so what is
    shuffled at a time has a bound, and only (clashes, seed) of a run comes back.

    targets: (target, bp, tm_min, plate); plates: (plate, ta).
    """
    may = targets.select("target", "tm_min").join(F.broadcast(plates.select("plate", "ta")), F.col("ta") <= F.col("tm_min") - P.TA_RULE + slack)
    allowed = may.groupBy("target").agg(F.array_sort(F.collect_list("plate")).alias("may"))
    t = cut_lineage(targets.select("target", "bp", "plate").join(allowed, "target", "left").withColumn("may", F.coalesce("may", F.array("plate"))))
    total, n_plates = t.count(), plates.count()
    before = clashes(t, ["plate"], gap).agg(F.coalesce(F.sum("clashes"), F.lit(0))).first()[0]
    best = (before, None)
    step = max(1, chunk // max(total, 1))
    for lo in range(0, trials, step):
        seeds = F.explode(F.sequence(F.lit(lo), F.lit(min(lo + step, trials) - 1)))
        tried = t.select("target", "bp", "may", seeds.alias("seed"))
        tried = tried.withColumn("plate", F.element_at("may", (draw(F.col("seed"), F.col("target")) % F.size("may") + 1).cast("int")))
        per = clashes(tried, ["seed", "plate"], gap).groupBy("seed").agg(F.sum("clashes").alias("c"), F.count(F.lit(1)).alias("used"), F.min("size").alias("least"), F.max("size").alias("most"))
        fair = per.where((F.col("used") == n_plates) & (F.col("least") >= 2) & (F.col("most") <= total // 2 + 2))
        top = fair.agg(F.min(F.struct("c", "seed")).alias("b")).first().b
        if top is not None and top.c < best[0]:
            best = (top.c, top.seed)
        if best[0] == 0:
            break
    after, seed = best
    plate = F.col("plate") if seed is None else F.element_at("may", (draw(F.lit(seed), F.col("target")) % F.size("may") + 1).cast("int"))
    return t.select("target", "plate", plate.alias("proposed"), F.lit(seed).cast("int").alias("seed"), F.lit(before).cast("long").alias("before"), F.lit(after).cast("long").alias("after"))
