"""Connected components and set matching (GRF-01, GRF-05, GRF-06)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..skew import salted_join

#: Edges that a task joins up at once.
HELD = 1 << 20


def joined_up(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable over these edges) of every node but the smallest ones; roots hook to smaller neighbours until no edge is left between two."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:u.size], at[u.size:]
    root = np.arange(nodes.size)
    while (on := a != b).any():
        a, b = np.minimum(a[on], b[on]), np.maximum(a[on], b[on])
        np.minimum.at(root, b, a)
        while not np.array_equal(root, far := root[root]):
            root = far
        a, b = root[a], root[b]
    away = root != np.arange(nodes.size)
    return nodes[away], nodes[root[away]]


def contracted(edges: DataFrame) -> DataFrame:
    """The edges (u, v) of BIGINT nodes with the same components, but of every ``HELD`` of a task only a star per component: fewer than nodes."""
    def contract(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            u, v = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in rows]) for i in range(2))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in joined_up(u, v)], ["u", "v"])

        rows, n = [], 0
        for batch in part:
            rows, n = [*rows, batch], n + batch.num_rows
            if n >= HELD:
                yield stars(rows)
                rows, n = [], 0
        if n:
            yield stars(rows)

    return edges.mapInArrow(contract, "u long, v long")


def components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 60, task_rows: int | None = None) -> DataFrame:
    """(node, component): smallest node id reachable over (a, b) edges.

    Edges of BIGINT nodes are first joined up where they lie, a bounded number at once (``contracted``). A node then has a label
    from each of those parts; it keeps the smallest, and only the labels that meet in a node are left to be joined: by one task if they
    are ``HELD`` at most, otherwise in rounds. Other nodes go by rounds from the start.
    """
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    if {t for _, t in e.dtypes} != {"bigint"}:
        roots = rounds(e.distinct(), max_rounds, task_rows)
    else:
        star = cut_lineage(contracted(e))
        first = cut_lineage(star.groupBy("u").agg(F.min("v").alias("m")))
        meet = star.join(first, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        above = first.join(star.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u", F.col("m").alias("v"))
        rest = cut_lineage(contracted(meet.unionByName(above).distinct()))
        few = rest.count() <= HELD
        top = cut_lineage(contracted(rest.coalesce(1))) if few else rounds(rest.distinct(), max_rounds, task_rows)
        label = first.unionByName(top.select("u", F.col("v").alias("m"))).groupBy("u").agg(F.min("m").alias("m"))
        top = top.select(F.col("u").alias("m"), F.col("v").alias("top"))
        found = label.join(F.broadcast(top), "m", "left") if few else salted_join(label, top, ["m"], "left")
        roots = found.select("u", F.coalesce("top", "m").alias("v"))
    return nodes.select("node").distinct().join(roots.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component"))


def rounds(e: DataFrame, max_rounds: int, task_rows: int | None = None) -> DataFrame:
    """(u, v): the smallest node v reachable from every other node u over distinct (u, v) edges.

    Alternating large-star and small-star steps: rounds grow with the logarithm of the
    component size, not with its diameter. Neighbourhood minima are partially aggregated,
    and the join back to a hub's edges is salted, so one hub with a third of all edges
    does not become one task. Each round is written to the checkpoint folder.
    """
    tasks = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def both_ways(e: DataFrame) -> DataFrame:
        return e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def star(e: DataFrame, large: bool, hub: int | None) -> DataFrame:
        both = both_ways(e)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        j = salted_join(both, low, ["u"], task_rows=hub) if hub else both.join(low, "u")
        if large:
            out = j.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            down = j.where(F.col("v") < F.col("u"))
            out = down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
                low.where(F.col("m") < F.col("u")).select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    e = cut_lineage(e)
    seen = None
    for _ in range(max_rounds):
        degree = both_ways(e).groupBy("u").agg(F.count(F.lit(1)).alias("d"), F.sum(F.hash("v").cast("long")).alias("h"))
        mark = degree.agg(F.max("d").alias("d"), F.sum("d").alias("n"), F.sum(F.xxhash64("u", "h").cast("decimal(38,0)"))
                          .alias("h")).first()
        if seen == mark:
            break
        share = task_rows or max(10_000, (mark["n"] or 0) // (2 * tasks))
        seen, hub = mark, share if (mark["d"] or 0) > share else None
        e = cut_lineage(star(star(e, True, hub), False, hub))
    else:
        raise RuntimeError("components did not converge")
    return e.groupBy("u").agg(F.min("v").alias("v"))


def _told(value) -> Column:
    """24 letters that tell a text from any other: the first 144 bits of its SHA-256."""
    return F.substring(F.base64(F.unhex(F.sha2(value, 256))), 1, 24)


def set_match(left: DataFrame, right: DataFrame, min_jaccard: float = 0.80, same: bool = False) -> DataFrame:
    """Pairs of sets with Jaccard at or above the floor (GRF-05), between class representatives.

    left: (a, member); right: (b, member), where repeated rows count once; ``same`` compares one family of
    sets with itself (``left``) and returns a < b. Equal sets are one class, told by its smallest key, and
    are not expanded: ``set_classes`` gives the membership. Members travel as digests, however long they are. Two exact reductions come first: equal sets are
    folded into one, and with members ordered from rare to common, a pair that reaches the
    floor must share one of the first n - ceil(t n) + 1 members of both, so a member held by
    a third of all sets is (almost) never joined on.
    """
    def fold(df, key):
        s = df.select(key, _told(F.col("member").cast("string")).alias("member")).groupBy(key).agg(F.array_sort(F.collect_set("member")).alias("members"))
        s = s.groupBy(_told(F.concat_ws("", "members")).alias("sig")).agg(F.min(key).alias("key"), F.min_by("members", key).alias("members"))
        return cut_lineage(s.where("key is not null").select("key", "members"))

    sets_l = fold(left, "a")
    sets_r = sets_l if same else fold(right, "b")
    rows = sets_l if same else sets_l.select("members").union(sets_r.select("members"))
    freq = rows.select(F.explode("members").alias("member")).groupBy("member").agg(F.count(F.lit(1)).alias("df")).where("df > 1")

    def prefix(sets, key, size):
        r = sets.select("key", F.explode("members").alias("member")).join(freq, "member", "left")
        g = r.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1).cast("long")).alias("df"), "member"))).alias("o"))
        n = F.size("o")
        keep = n - F.ceil(n * min_jaccard - 1e-9).cast("int") + 1
        g = g.select(F.col("key").alias(key), n.alias(size), F.explode(F.slice("o", F.lit(1), keep)).alias("p"))
        return g.where("p.df > 1").select(key, size, F.col("p.member").alias("member"))  # one set alone has the others

    p = cut_lineage(prefix(sets_l, "a", "na"))
    q = p.toDF("b", "nb", "member") if same else prefix(sets_r, "b", "nb")
    near = F.least("na", "nb") >= F.greatest("na", "nb") * min_jaccard - 1e-9
    cand = p.join(q, "member").where(near & (F.col("a") < F.col("b")) if same else near).select("a", "b").distinct()
    return (cand.join(sets_l.select(F.col("key").alias("a"), F.col("members").alias("ma")), "a")
            .join(sets_r.select(F.col("key").alias("b"), F.col("members").alias("mb")), "b")
            .withColumn("shared", F.size(F.array_intersect("ma", "mb")).cast("long"))
            .withColumn("jaccard", F.col("shared") / (F.size("ma") + F.size("mb") - F.col("shared")))
            .where(F.col("jaccard") >= min_jaccard).select("a", "b", "shared", "jaccard"))


def set_classes(sets: DataFrame, key: str) -> DataFrame:
    """(key, representative): the smallest key with an equal set. sets: distinct (key, member).

    A set is told by the sum, the exclusive or and the number of its members' hashes, which are
    partial aggregates; classes are counted before their rows are joined back.
    """
    h = F.xxhash64(F.col("member"))
    marks = sets.groupBy(key).agg(F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.col("member"), F.lit(1))).alias("x"), F.count(F.lit(1)).alias("n"))
    first = marks.groupBy("s", "x", "n").agg(F.min(key).alias("representative"))
    return salted_join(marks, first, ["s", "x", "n"]).select(key, "representative")


def reconcile(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows lost or invented between two sets (GRF-06): an empty result is conservation."""
    b = before.select(*keys).distinct().withColumn("in_before", F.lit(True))
    a = after.select(*keys).distinct().withColumn("in_after", F.lit(True))
    f = b.join(a, keys, "full_outer")
    return f.where(F.col("in_before").isNull() | F.col("in_after").isNull()).select(
        *keys, F.when(F.col("in_after").isNull(), "lost").otherwise("invented").alias("change"))
