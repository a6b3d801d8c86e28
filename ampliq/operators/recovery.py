"""What can be done for targets under the threshold (OPT-03): routes in turn, each for what earlier ones left.

A table holds one row per target with the route that took it, the outcome and its evidence. Routes never look at each other's
targets (anti-joins) and never lower the threshold: an equivalent target that passes makes a row unnecessary (route 4); a universal target,
which has no competitors to divide by, is judged by coverage and spill (route 1); members that sequence identity shows to be other organisms
become competitors and the target is measured again (route 2). What is left waits for a new design (routes 3 and 5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import stats as M
from ..session import cut_lineage
from .graph import components

# Fixed values of the routes.
SAME_MEMBERS = 0.80
COVERED_BINS = 0.80
SPILL_MAX = 5.0  # per cent
SAME_ORGANISM = 99.0  # per cent


def folds(rates: DataFrame, roles: DataFrame) -> DataFrame:
    """(target, member_low, pool_high, fold): lowest member lower bound over the pooled competitors' upper bound; null where not measured.

    rates: (target, bin, k, n); roles: (target, bin, role).
    """
    r = rates.where("n > 0").join(roles, ["target", "bin"])
    comp = F.col("role") == "competitor"
    g = r.groupBy("target").agg(F.min(F.when(F.col("role") == "member", M.wilson_lower("k", "n"))).alias("member_low"),
                                F.sum(F.when(comp, F.col("k"))).alias("pk"), F.sum(F.when(comp, F.col("n"))).alias("pn"))
    g = g.withColumn("pool_high", F.when(F.col("pn") > 0, M.wilson_upper("pk", "pn")))
    return g.select("target", "member_low", "pool_high", M.ratio("member_low", "pool_high").alias("fold"))


def equivalents(failing: DataFrame, passing: DataFrame, roles: DataFrame, min_share: float = SAME_MEMBERS) -> DataFrame:
    """(target, twin, share): the first passing target whose members are (by Jaccard) ``min_share`` those of a failing one.

    Only targets that share a member are compared, through counts of shared members.
    """
    m = roles.where("role = 'member'").select("target", "bin").distinct()
    size = m.groupBy("target").agg(F.count(F.lit(1)).alias("size"))
    a = m.join(failing.select("target"), "target", "left_semi")
    b = m.join(passing.select("target"), "target", "left_semi").withColumnRenamed("target", "twin")
    shared = a.join(b, "bin").groupBy("target", "twin").agg(F.count(F.lit(1)).alias("shared"))
    s = shared.join(size, "target").join(size.select(F.col("target").alias("twin"), F.col("size").alias("twin_size")), "twin")
    s = s.withColumn("share", F.col("shared") / (F.col("size") + F.col("twin_size") - F.col("shared"))).where(F.col("share") >= min_share)
    return s.groupBy("target").agg(F.min("twin").alias("twin"), F.min_by("share", "twin").alias("share"))


def universal_verdict(targets: DataFrame, rates: DataFrame, roles: DataFrame) -> DataFrame:
    """(target, covered, bins, spill, passed): member bins with enough product, and the upper bound of the share of other reads with one.

    Bins without a role in a target are outside of it. No outside read: spill is null, and the target does not pass.
    """
    r = rates.where("n > 0").join(targets.select("target"), "target", "left_semi").join(roles, ["target", "bin"], "left")
    member = F.coalesce(F.col("role") == "member", F.lit(False))
    g = r.groupBy("target").agg(F.count_if(member & (F.col("k") / F.col("n") >= P.COVERAGE_SHARE)).alias("covered"), F.count_if(member).alias("bins"),
                                F.sum(F.when(~member, F.col("k"))).alias("ok"), F.sum(F.when(~member, F.col("n"))).alias("on"))
    g = g.withColumn("spill", F.when(F.col("on") > 0, F.round(100.0 * M.wilson_upper("ok", "on"), 6)))
    passed = (F.col("bins") > 0) & (F.col("covered") >= COVERED_BINS * F.col("bins")) & F.coalesce(F.col("spill") <= SPILL_MAX, F.lit(False))
    return g.select("target", "covered", "bins", "spill", passed.alias("passed"))


def narrowed_roles(targets: DataFrame, roles: DataFrame, identities: DataFrame, min_identity: float = SAME_ORGANISM) -> tuple[DataFrame, DataFrame]:
    """(roles, evidence): members outside of the largest cluster of one organism become competitors.

    Members are clustered by single linkage at ``min_identity``; the largest cluster (ties: the one with the smallest bin) is the target's.
    A target whose members are all apart is heterogeneous and stays as it is. The primer's result plays no part. evidence: (target, clusters,
    largest, moved). identities: (target, a, b, identity) of member bins.
    """
    node = lambda c: F.concat_ws("\x1f", F.col("target").cast("string"), F.col(c).cast("string"))
    m = roles.where("role = 'member'").join(targets.select("target"), "target", "left_semi").select("target", "bin", node("bin").alias("node"))
    m = cut_lineage(m)
    edges = identities.where(F.col("identity") >= min_identity).select(node("a").alias("a"), node("b").alias("b"))
    edges = edges.join(m.select(F.col("node").alias("a")), "a", "left_semi").join(m.select(F.col("node").alias("b")), "b", "left_semi")
    c = cut_lineage(m.join(components(edges, m.select("node")), "node"))
    sizes = c.groupBy("target", "component").agg(F.count(F.lit(1)).alias("size"), F.min("bin").alias("first"))
    pick = sizes.groupBy("target").agg(F.min(F.struct((-F.col("size")).alias("neg"), F.col("first"), F.col("component"))).alias("p"), F.count(F.lit(1)).alias("clusters"))
    pick = cut_lineage(pick.select("target", "clusters", (-F.col("p.neg")).alias("largest"), F.col("p.component").alias("own")))
    out = c.join(pick.where("largest >= 2"), "target").where("component <> own").select("target", "bin").withColumn("leaves", F.lit(True))
    out = cut_lineage(out)
    new = roles.join(targets.select("target"), "target", "left_semi").join(out, ["target", "bin"], "left").select(
        "target", "bin", F.when(F.col("leaves"), "competitor").otherwise(F.col("role")).alias("role"))
    moved = out.groupBy("target").agg(F.count(F.lit(1)).alias("moved"))
    return new, pick.select("target", "clusters", "largest").join(moved, "target", "left").withColumn("moved", F.coalesce("moved", F.lit(0)))


def recover(targets: DataFrame, rates: DataFrame, roles: DataFrame, identities: DataFrame, threshold: float = P.FOLD_THRESHOLD) -> DataFrame:
    """(target, route, outcome, fold, evidence) of every target under the threshold; route null where none took it.

    targets: (target, universal); a target is under the threshold if its fold is below it or can't be measured.
    """
    now = cut_lineage(targets.join(folds(rates, roles), "target", "left"))
    passing = now.where(F.coalesce(F.col("fold") >= threshold, F.lit(False)) & ~F.col("universal"))
    state = now.join(passing.select("target"), "target", "left_anti").select("target", "universal", "fold")
    state = cut_lineage(state)
    show = lambda c, d: F.format_string(f"%.{d}f", F.col(c).cast("double"))
    four = cut_lineage(equivalents(state, passing, roles).select(
        "target", F.lit(4).alias("route"), F.lit("equivalent").alias("outcome"), F.lit(None).cast("double").alias("fold"),
        F.concat(F.lit("same members as "), F.col("twin").cast("string"), F.lit(" at "), show("share", 2)).alias("evidence")))
    left = state.join(four, "target", "left_anti")
    uni = left.where("universal")
    one = universal_verdict(uni, rates, roles).select(
        "target", F.lit(1).alias("route"), F.when(F.col("passed"), "passes").otherwise("fails").alias("outcome"), F.lit(None).cast("double").alias("fold"),
        F.concat(F.lit("covered "), F.col("covered").cast("string"), F.lit("/"), F.col("bins").cast("string"), F.lit(", spill "), F.coalesce(show("spill", 4), F.lit("not measured"))).alias("evidence"))
    left = cut_lineage(left.where("not universal"))
    new, evidence = narrowed_roles(left, roles, identities)
    again = folds(rates, new).select("target", F.col("fold").alias("again"))
    two = evidence.where("moved > 0").join(again, "target", "left").select(
        "target", F.lit(2).alias("route"), F.when(F.coalesce(F.col("again") >= threshold, F.lit(False)), "passes").otherwise("fails").alias("outcome"), F.col("again").alias("fold"),
        F.concat(F.lit("moved "), F.col("moved").cast("string"), F.lit(", largest cluster "), F.col("largest").cast("string"), F.lit(" of "), F.col("clusters").cast("string")).alias("evidence"))
    taken = cut_lineage(four.unionByName(one).unionByName(two))
    rest = state.join(taken, "target", "left_anti").join(evidence, "target", "left").select(
        "target", F.lit(None).cast("int").alias("route"), F.lit("waits for a new design").alias("outcome"), "fold",
        F.when(F.col("universal"), "not measured").when((F.col("largest") < 2) & (F.col("clusters") > 1), "heterogeneous members").otherwise("members are one organism").alias("evidence"))
    return taken.unionByName(rest).select("target", "route", "outcome", F.round("fold", 6).alias("fold"), "evidence")
