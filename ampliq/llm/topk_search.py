"""Exact top-k inner products by a pivot-distance index.

With M the largest norm, the extra component sqrt(M^2 - |x|^2) lifts every vector onto one sphere, where a larger inner
product with q is a smaller distance: d^2 = M^2 + |q|^2 - 2<x, q>. Vectors are keyed by (nearest pivot, distance to it)
and sorted; stretches of that order are annuli. A query first searches the annulus it lies in, which bounds its k-th
score; then only annuli are expanded that the triangle inequality does not rule out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

#: Vectors of an annulus, at most.
ANNULUS = 2048
#: Pivots, taken in hash order; the result doesn't depend on them.
PIVOTS = 32
#: Relative slack of distances computed in floating point.
SLACK = 1e-7


def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, q array<long>): floor(scale * x). Vectors null, empty, or with a null or non-finite component take no part;
    a component that no long holds raises."""
    v = F.transform(vec_col, lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = lambda x: (x * scale >= -(2.0**63)) & (x * scale < 2.0**63)
    whole = F.transform("v", lambda x: F.when(fits(x), F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component doesn't fit a long")).cast("long")))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0").where(fine)
            .select("vec_id", whole.alias("q")))


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, top - (x * x).sum(axis=1)))


def _distances(x: np.ndarray, x_up: np.ndarray, p: np.ndarray, p_up: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + x_up[:, None] ** 2 + (p * p).sum(1)[None] + p_up[None] ** 2 - 2 * (x @ p.T + np.outer(x_up, p_up))
    return np.sqrt(np.maximum(0.0, d))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _pack(x: np.ndarray) -> bytes:
    """The components in the narrowest integers that hold them all."""
    peak = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    return x.astype(np.int8 if peak < 2**7 else np.int16 if peak < 2**15 else np.int32 if peak < 2**31 else np.int64).tobytes()


def _unpack(data: bytes, dim: int, rows: int) -> np.ndarray:
    width = len(data) // max(1, dim * rows)
    return np.frombuffer(data, {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}.get(width, np.int8)).reshape(rows, dim).astype(np.int64)


def _products(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; through doubles while these are exact, as matrix products of doubles are fast, and
    through Python's integers where a sum could outgrow a long; a score that does raises."""
    peak = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * x.shape[1]
    if peak < 2**53:
        return np.rint(queries.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if peak < 2**62:
        return queries @ x.T
    return (queries.astype(object) @ x.T.astype(object)).astype(np.int64)  # raises OverflowError


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids; None marks are the smallest long."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """The k highest integer inner products of each query row with all other rows: query_id, rank, vec_id, score.

    ``is_query`` is over vec_id. Rows of another length than a query's take no part in its search. Ties go to the smaller
    vec_id. A row's own vec_id is no candidate; rows repeated with one vec_id and equal vectors count once, with different
    vectors each has its own candidates. A query alone of its length gives no row; an empty table none.
    """
    spark = vectors.sparkSession
    base = quantised(vectors, scale, id_col, vec_col).distinct().withColumn("dim", F.size("q")).withColumn("ask", F.coalesce(is_query, F.lit(False)))
    base = written(base, "vectors")
    norm = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    tops = {r["dim"]: r["top"] for r in base.groupBy("dim").agg(F.max(norm).alias("top")).orderBy(F.desc("top")).limit(4096).collect()}
    # lengths beyond the 4096 met first all use one bound: any value at least as large as the true one is right
    most = max(tops.values(), default=0.0)
    pivots: dict[int, list] = {}
    seen = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("q"), "vec_id"))
    for r in base.select("dim", "q", "vec_id").withColumn("n", seen).where(f"n <= {PIVOTS}").limit(4096 * PIVOTS).select("dim", "q").toLocalIterator():
        pivots.setdefault(r["dim"], []).append(r["q"])

    def of(dim: int) -> tuple[float, np.ndarray, np.ndarray]:
        top = tops.get(dim, most)
        p = np.array(pivots.get(dim) or [[0] * dim], np.float64)
        return top, p, _lift(p, top)

    def key(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in part:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                x, (top, p, up) = _matrix(rows.column("q")).astype(np.float64), of(dim)
                d = _distances(x, _lift(x, top), p, up)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("q"), rows.column("dim"), rows.column("ask"), pa.array(near.astype(np.int32)),
                                                  pa.array(d[np.arange(len(near)), near])], names=["vec_id", "q", "dim", "ask", "pivot", "dist"])

    keyed = base.mapInArrow(key, "vec_id long, q array<long>, dim int, ask boolean, pivot int, dist double")
    keyed = keyed.repartitionByRange(partitions(spark), "dim", "pivot", "dist", "vec_id").sortWithinPartitions("dim", "pivot", "dist", "vec_id")
    shape = "dim int, pivot int, low double, high double, ids array<long>, mat binary, askers array<long>, ask_mat binary, floors array<long>, reach array<double>, near array<array<double>>"

    def annuli(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of the order, each searched by the queries it holds: floors are the k-th scores, reach the distances they allow."""
        held: list[pa.RecordBatch] = []

        def row() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            dim = rows.column("dim")[0].as_py()
            x, ids, d = _matrix(rows.column("q")).astype(np.int64), rows.column("vec_id").to_numpy(), rows.column("dist").to_numpy()
            ask = np.asarray(rows.column("ask")).astype(bool)
            q, q_ids, (top, p, up) = x[ask], ids[ask], of(dim)
            scores = _products(q, x)
            floors = []
            for s, i in zip(scores, q_ids, strict=True):
                other = s[ids != i]
                floors.append(int(np.partition(other, len(other) - k)[len(other) - k]) if len(other) >= k else None)
            fq = q.astype(np.float64)
            square = (fq * fq).sum(axis=1)
            reach = [float("inf") if f is None else float(np.sqrt(max(0.0, top + s - 2.0 * f))) for f, s in zip(floors, square, strict=True)]
            near = _distances(fq, np.zeros(len(fq)), p, up)  # a query is lifted by 0, which keeps the order of its scores
            return pa.RecordBatch.from_arrays([
                pa.array([dim], pa.int32()), pa.array([rows.column("pivot")[0].as_py()], pa.int32()), pa.array([d.min()]), pa.array([d.max()]), pa.array([ids.tolist()], pa.list_(pa.int64())),
                pa.array([_pack(x)]), pa.array([q_ids.tolist()], pa.list_(pa.int64())), pa.array([_pack(q)]), pa.array([floors], pa.list_(pa.int64())), pa.array([reach], pa.list_(pa.float64())),
                pa.array([near.tolist()], pa.list_(pa.list_(pa.float64())))], names=[c.split()[0] for c in shape.split(", ")])

        for batch in part:
            dims, near = batch.column("dim").to_numpy(), batch.column("pivot").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (dims[1:] != dims[:-1]) | (near[1:] != near[:-1]), True]) if len(dims) else np.array([0])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if held and ((held[-1].column("dim")[0].as_py(), held[-1].column("pivot")[0].as_py()) != (int(dims[lo]), int(near[lo]))):
                    yield row()
                    held = []
                while lo < hi:
                    room = ANNULUS - sum(map(len, held))
                    held.append(batch.slice(lo, min(room, hi - lo)))
                    lo += room
                    if sum(map(len, held)) >= ANNULUS:
                        yield row()
                        held = []
        if held:
            yield row()

    rings = written(keyed.mapInArrow(annuli, shape), "annuli").withColumn("ring", F.xxhash64("dim", "pivot", "low", "high", "ids"))
    rings = written(rings, "rings")
    # one row per query and pivot; an annulus is expanded if | d(q, pivot) - its distances | can lie within reach
    asks = (rings.where(F.size("askers") > 0).select("dim", F.col("ring").alias("asker"), F.explode(F.arrays_zip("reach", "near")).alias("z"))
            .select("dim", "asker", F.col("z.reach").alias("reach"), F.posexplode("z.near").alias("pivot", "d")))
    slack = (F.col("d") + F.col("high") + 1.0) * SLACK
    pairs = (asks.join(rings.select("dim", "pivot", "low", "high", "ring"), ["dim", "pivot"])
             .where((F.col("low") <= F.col("d") + F.col("reach") + slack) & (F.col("high") >= F.col("d") - F.col("reach") - slack))
             .select("asker", "ring").distinct())
    # an annulus travels once; the queries that expand it, twenty times fewer than vectors, follow it in the stream
    asking = pairs.join(rings.select(F.col("ring").alias("asker"), "dim", "askers", "ask_mat", "floors"), "asker")
    work = (rings.select("ring", F.lit(0).alias("kind"), "dim", "ids", "mat", F.lit(None).cast("array<long>").alias("floors"))
            .unionByName(asking.select("ring", F.lit(1).alias("kind"), "dim", F.col("askers").alias("ids"), F.col("ask_mat").alias("mat"), "floors"))
            .repartition(partitions(spark), "ring").sortWithinPartitions("ring", "kind"))

    def expand(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = x = None
        for batch in part:
            for row in batch.to_pylist():
                mat = _unpack(row["mat"], row["dim"], len(row["ids"]))
                if row["kind"] == 0:
                    ids, x = np.array(row["ids"], np.int64), mat
                    continue
                out: tuple[list, list, list] = ([], [], [])
                for s, i, f in zip(_products(mat, x), row["ids"], row["floors"], strict=True):
                    at = np.flatnonzero((ids != i) & (s >= (np.iinfo(np.int64).min if f is None else f)))
                    at = at[_best(s[at], ids[at], k)]
                    for o, v in zip(out, ([i] * len(at), ids[at].tolist(), s[at].tolist()), strict=True):
                        o.extend(v)
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = work.mapInArrow(expand, "query_id long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
