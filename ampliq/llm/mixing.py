"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power alpha, normalised. Lower exponents flatten the mixture: its entropy
and the repetition of small sources rise. The exponent is bisected to the one that meets a target, and the weights are
realised as permutations of each source's blocks, pass after pass, until its token budget is used up.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, written

#: Documents of a block, about; blocks of a source are permuted, and documents within a block.
BLOCK_DOCS = 256
#: Halvings of the interval of the exponent, and how many of them one job does.
HALVINGS, AT_ONCE = 30, 5


def word_tokens(text_col: str = "text") -> Column:
    """Tokens of a text: its runs of characters that are no white space. Null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_shares(rows: DataFrame) -> DataFrame:
    """source, n_docs, n_tokens of ``rows`` (source, tokens); a source without tokens takes part with weight 0."""
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("n_tokens"))


def bisect_exponent(shares: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None) -> float:
    """The exponent alpha in [0, 1]: with ``target_entropy`` (nats) the largest whose mixture is at least that mixed, else the
    smallest at which no source is passed over more than ``max_repeats`` times when every source gets one pass at least.

    Both measures fall as alpha rises. Each job evaluates the exponents of AT_ONCE halvings over the table of sources, as
    sums only. A target out of reach gives the nearer end; no source with tokens gives 1.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give target_entropy or max_repeats")
    live = shares.where("n_tokens > 0")
    total = live.agg(F.sum("n_tokens")).first()[0]
    if not total:
        return 1.0
    share = F.col("n_tokens") / F.lit(float(total))
    lo, hi = 0.0, 1.0

    def measure(points: list[float]) -> dict[float, float]:
        grid = live.select(share.alias("p"), F.explode(F.array(*[F.lit(x) for x in points])).alias("alpha"))
        power = F.pow("p", "alpha")
        # with w = p^alpha / z: entropy = ln z - sum(p^alpha ln p^alpha) / z; passes relative to the least repeated source = ratio
        got = grid.groupBy("alpha").agg(F.sum(power).alias("z"), F.sum(power * F.ln("p") * F.col("alpha")).alias("s"),
                                        (F.max(power / F.col("p")) / F.min(power / F.col("p"))).alias("ratio"))
        value = F.ln("z") - F.col("s") / F.col("z") if target_entropy is not None else F.col("ratio")
        return {r[0]: r[1] for r in got.select("alpha", value).collect()}  # as many rows as points

    enough = (lambda v: v >= target_entropy) if target_entropy is not None else (lambda v: v > max_repeats)
    ends = measure([lo, hi])
    if not enough(ends[0.0]):
        return 0.0
    if enough(ends[1.0]):
        return 1.0
    for _ in range(HALVINGS // AT_ONCE):
        n = 2**AT_ONCE
        points = [lo + (hi - lo) * i / n for i in range(n + 1)]
        got = measure(points[1:-1])
        k = max([0, *(i for i in range(1, n) if enough(got[points[i]]))])
        lo, hi = points[k], points[k + 1]
    return lo if target_entropy is not None else hi


def plan_weights(shares: DataFrame, alpha: float, budget: float | None = None) -> DataFrame:
    """source, n_docs, n_tokens, weight, quota (tokens), passes (whole ones), rest (tokens of the last, partial pass).

    Without a ``budget`` the mixture is as long as makes the least repeated source be passed over exactly once.
    """
    live = shares.where("n_tokens > 0")
    total = live.agg(F.sum("n_tokens")).first()[0] or 1
    p = F.col("n_tokens") / F.lit(float(total))
    z, least = live.agg(F.sum(F.pow(p, F.lit(alpha))), F.min(F.pow(p, F.lit(alpha)) / p)).first()
    weight = F.when(F.col("n_tokens") > 0, F.pow(p, F.lit(alpha)) / F.lit(z or 1.0)).otherwise(0.0)
    tokens = float(budget) if budget is not None else float(total) * (z or 1.0) / (least or 1.0)
    quota = F.round(F.col("weight") * F.lit(tokens)).cast("long")
    return (shares.withColumn("weight", weight).withColumn("quota", quota)
            .withColumn("passes", F.when(F.col("n_tokens") > 0, F.floor(F.col("quota") / F.col("n_tokens"))).otherwise(1).cast("long"))
            .withColumn("rest", F.col("quota") - F.col("passes") * F.col("n_tokens")))


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 2.0, budget: float | None = None, seed: int = 17,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, tokens, weight, pass, block, place of every draw of a document.

    In every pass the blocks of a source are permuted, and the documents of a block; ordering by (pass, block, place)
    within a source gives its stream. A source gets ``passes`` whole passes and a last one that ends with the document that
    reaches the rest of its quota. Null texts and texts without tokens count 0 tokens and are drawn in whole passes; a
    null source is a source of its own; a source without tokens gets one pass. Repeated rows are documents of their own.
    Blocks are sized by counts, so a source with a third of all rows is a third of all blocks; only block sums are
    ordered over a whole source, in two steps.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("\0")).alias("source"), word_tokens(text_col).alias("tokens"))
    rows = written(rows.withColumn("h", F.xxhash64("doc_id", F.lit(seed))), "mix-rows")
    shares = written(source_shares(rows), "shares")
    alpha = bisect_exponent(shares, target_entropy, max_repeats if target_entropy is None else None)
    plan = written(plan_weights(shares, alpha, budget), "plan")
    total = rows.count()
    placed = attach(rows, plan, "source", "n_docs", total).withColumn("block", F.pmod("h", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BLOCK_DOCS))).cast("long"))
    placed = written(placed, "placed")
    # the partial pass: where a block begins in its permutation, in tokens; a super-block holds some hundred blocks
    turn = lambda *c: F.xxhash64(*c, F.lit(seed + 1), "pass")
    last = F.col("passes").alias("pass")
    sums = (placed.where("rest > 0").groupBy("source", "block", last).agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
            .withColumn("place", turn("source", "block")).withColumn("super", F.shiftright(F.col("place"), 52)))
    coarse = (sums.groupBy("source", "pass", "super").agg(F.sum("t").alias("t")).withColumn("coarse", F.sum("t").over(Window.partitionBy("source").orderBy("super")) - F.col("t"))
              .select("source", "super", "coarse"))
    inner = Window.partitionBy("source", "super").orderBy("place", "block")
    starts = (sums.withColumn("fine", F.sum("t").over(inner) - F.col("t")).join(coarse, ["source", "super"])
              .withColumn("start", F.col("coarse") + F.col("fine")).where("start < rest").select("source", "block", "start"))
    within = Window.partitionBy("source", "block").orderBy("turn", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    part = (placed.where("rest > 0").join(starts, ["source", "block"]).withColumn("pass", F.col("passes")).withColumn("turn", turn("h"))
            .withColumn("at", F.col("start") + F.coalesce(F.sum("tokens").over(within), F.lit(0))).where("at < rest and tokens > 0"))
    whole = placed.where("passes > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)))
    out = [F.col("doc_id"), F.when(F.col("source") != "\0", F.col("source")).alias("source"), "tokens", "weight", "pass",
           turn("source", "block").alias("block"), turn("h").alias("place")]
    return whole.select(*out).unionByName(part.select(*out))
