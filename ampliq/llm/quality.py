"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text give the non-negative unbiased risk pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)); a
small network over shape features of a text minimises it. The class prior pi is the share of label 1 among the labelled
rows that may be learned from. Negatives' texts are never used as such.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_batches, text_or_empty

#: Bounded samples that the model is fitted on, in hash order of the ids.
POSITIVES, UNLABELLED = 6_000, 12_000
HIDDEN, EPOCHS, RATE, DECAY, SEED = 16, 200, 0.02, 1e-4, 11
#: Byte classes of the features: every ASCII sign, and groups.
SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]


def features(text: str) -> np.ndarray:
    """Shape of a whole text: shares of bytes by class, and of words by repetition, case and signs. Empty texts give zeros."""
    raw = text.encode("utf-8", "replace")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    n = max(1.0, float(len(raw)))
    words = text.split()
    m = max(1, len(words))
    seen = Counter(words)
    lower, upper, digit = hist[97:123].sum(), hist[65:91].sum(), hist[48:58].sum()
    top = seen.most_common(1)[0][1] if seen else 0
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    line_seen = Counter(lines)
    runs = sum(map(str.__eq__, words, words[1:]))
    ends = Counter(map(_last, words))
    letters = max(1.0, lower + upper)
    own = [lower / n, upper / n, upper / letters, digit / n, hist[128:].sum() / n, hist[32] / n, hist[10] / n, (hist[:32].sum() - hist[9:14].sum()) / n,
           np.sqrt(runs / m), np.sqrt(top / m), len(seen) / m, np.log1p(m) / 10, len(raw) / m / 20, len(line_seen) / k, np.log1p(len(words) / k) / 5,
           sum(n for c, n in ends.items() if not c.isalnum() and c not in ".,;:?!") / m, (ends["."] + ends[","]) / m, ends["!"] / m]
    return np.concatenate([own, np.sqrt(hist[SIGNS] / n)])


def _last(word: str) -> str:
    return word[-1]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(len(texts), 18 + len(SIGNS))


class Model:
    """Weights of a one-layer network over standardised features."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x), -30, 30)))


def nn_pu_risk(g_p: np.ndarray, g_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Non-negative risk with the logistic loss, and its slope in each output. Where the negative part falls below 0, the slope climbs back."""
    soft = lambda z: np.logaddexp(0.0, z)
    sig = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
    plus = prior * soft(-g_p).mean()
    minus = soft(g_u).mean() - prior * soft(g_p).mean()
    if minus >= 0:
        return plus + minus, (prior * (sig(g_p) - 1) - prior * sig(g_p)) / len(g_p), sig(g_u) / len(g_u)
    return plus, prior * sig(g_p) / len(g_p), -sig(g_u) / len(g_u)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Full-batch Adam on the bounded samples."""
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    zp, zu = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    rng = np.random.default_rng(SEED)
    p = [rng.normal(0, 1 / np.sqrt(zp.shape[1]), (zp.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.array(0.0)]
    first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, EPOCHS + 1):
        hp, hu = np.tanh(zp @ p[0] + p[1]), np.tanh(zu @ p[0] + p[1])
        _, dp, du = nn_pu_risk(hp @ p[2] + p[3], hu @ p[2] + p[3], prior)
        bp, bu = np.outer(dp, p[2]) * (1 - hp**2), np.outer(du, p[2]) * (1 - hu**2)
        slopes = [zp.T @ bp + zu.T @ bu + DECAY * p[0], bp.sum(0) + bu.sum(0), hp.T @ dp + hu.T @ du + DECAY * p[2], dp.sum() + du.sum()]
        for i, g in enumerate(slopes):
            first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
            p[i] = p[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, *p)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.1) -> float:
    """The share of positives among ``unlabelled``, from positives alone: of all thresholds that at least ``least`` of the
    positives reach, the smallest ratio of unlabelled to positive rows above, as no negative need be there.

    Scores rank rows by a fit to one half of both samples; the ratio is taken on the other half, with a margin for its size.
    """
    ranked = fit(positive[::2], unlabelled[::2], 0.5)
    p, u = np.sort(ranked.logits(positive[1::2] if len(positive) > 1 else positive)), np.sort(ranked.logits(unlabelled[1::2] if len(unlabelled) > 1 else unlabelled))
    cuts = p[:max(1, int(len(p) * (1 - least)) + 1)]
    above = lambda x: 1 - np.searchsorted(x, cuts, side="left") / len(x)
    margin = np.sqrt(np.log(20) / (2 * len(u))) + np.sqrt(np.log(20) / (2 * len(p)))
    best = int(np.argmin((above(u) + margin) / above(p)))
    return float(min(1.0, above(u)[best] / above(p)[best]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose crc32(id as text) mod 3 is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model from rows that are not held out. None without a usable positive: then every text scores 0.5.

    Unlabelled rows are chosen by hash of id and text (about UNLABELLED), positives by hash of their id (about POSITIVES);
    where repeated rows or ids bring more, twice as many stay at most. The prior is the share of 1 among the labels, or
    estimated from the samples where no label is 0.
    """
    short_batches(docs.sparkSession)
    seen = labels.select(F.col("doc_id").alias("_l"), F.col("quality").cast("int").alias("_q")).where("_q in (0, 1)").where(~held_out("_l"))
    share = seen.agg(F.avg("_q"), F.sum("_q")).first()
    if not share[1]:
        return None
    text, order = text_or_empty(text_col), F.xxhash64(F.col(id_col), text_or_empty(text_col), F.lit(SEED))

    @F.arrow_udf("array<double>")
    def shape_features(text: pa.Array) -> pa.Array:
        return pa.array(list(matrix(text.to_pylist())), pa.list_(pa.float64()))

    # rows are chosen by hash before their features are taken; the cut keeps the samples at their bounds as the table grows
    part = lambda col, most, n, salt: F.pmod(F.xxhash64(col, F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(1, n)))
    good = seen.where("_q = 1").select("_l").distinct().where(part("_l", POSITIVES, share[1], SEED)).limit(2 * POSITIVES).withColumn("_p", F.lit(1))
    rows = docs.select(F.col(id_col).alias("_l"), text.alias("_t"), order.alias("_o"))
    unlabelled = ~held_out("_l") & part("_o", UNLABELLED, docs.count() * 2 / 3, SEED + 1)
    picked = (rows.join(F.broadcast(good), "_l", "left").withColumn("_u", F.when(unlabelled, 1).otherwise(0)).withColumn("_p", F.coalesce("_p", F.lit(0)))
              .where("_p + _u > 0").select("_o", "_p", "_u", shape_features("_t").alias("_f")))
    # equal rows have equal hashes, so a bound by order ends what the cut can't thin out
    take = lambda flag, most: np.array([r[0] for r in picked.where(F.col(flag) == 1).orderBy("_o", "_f").limit(2 * most).select("_f").collect()])
    pos, unl = take("_p", POSITIVES), take("_u", UNLABELLED)
    if not len(pos) or not len(unl):
        return None
    prior = float(share[0]) if share[0] < 1 else estimated_prior(pos, unl)
    return fit(pos, unl, min(0.99, max(0.01, prior)))


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of the whole text in ``out``."""
    short_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.scores(matrix(text.to_pylist())), pa.float64())

    return docs.withColumn(out, F.lit(0.5) if model is None else score(text_or_empty(text_col)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Null counts as empty text; repeated rows each give a row; only ``text_col`` is an input of the score."""
    rows = scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), train(docs, labels, id_col, text_col))
    return rows.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
