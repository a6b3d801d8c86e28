"""Quality rules: document statistics, and an ordered decision list learned from labels. DataFrame functions only.

Sequential covering: a rule, a conjunction of thresholds on statistics, is grown on one part of the labelled documents by
information gain, pruned on the other part, and the documents it covers leave before the next rule is grown. The driver sees
counts per statistic and bin only (``CUTS`` + 1 bins each), whatever the number of labelled rows. The list becomes
``when(rule, false)...otherwise(true)``.

Defined results: a null text is an empty one and has no words; documents without words fail the base rules; labels other than 0
and 1, null ids and ids whose labels disagree teach nothing; without labels of both kinds the list is empty and every document that
passes the base rules is kept. Repeated rows are judged each by itself, equal texts alike. Columns of the input whose names clash with the statistics don't matter.
Windows of five words are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, text_or_empty, written

#: Fixed values of the base rules.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of words

#: Thresholds tried per statistic: quantiles of the labelled documents.
CUTS = 31
#: A rule has at most so many conditions, a list at most so many rules.
CONDITIONS, RULES = 4, 16
#: On the pruning part, at least this share of what a rule covers is of label 0.
PRECISION = 0.9

#: What conditions are about; every statistic is a share or a mean, so the length of a text decides nothing by itself but in n_words.
STATISTICS = {
    "n_words": "n_words",
    "mean_word": "word_chars / n_words",
    "symbol_share": "n_symbols / word_chars",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / n_words",
    "distinct_share": "n_distinct / n_words",
    "capital_share": "n_capitals / word_chars",
    "mark_share": "n_marks / n_words",
    "shout_share": "n_shouts / n_words",
    "digit_share": "n_digits / word_chars",
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals", "n_marks", "n_shouts", "n_digits"]


@dataclass(frozen=True)
class Condition:
    """``name`` above ``cut``, or at most ``cut``."""

    name: str
    above: bool
    cut: float

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut!r}"

    def column(self) -> Column:
        value = F.expr(f"({STATISTICS[self.name]})")
        return F.coalesce(value > self.cut if self.above else value <= self.cut, F.lit(False))


@dataclass
class DecisionList:
    """Ordered conjunctions; a document that any covers is dropped."""

    rules: list[list[Condition]] = field(default_factory=list)

    def covers(self, rule: list[Condition]) -> Column:
        out = F.lit(True)
        for c in rule:
            out = out & c.column()
        return out

    def verdict(self) -> Column:
        """Kept or not, as one conditional expression over the statistics."""
        if not self.rules:
            return F.lit(True)
        out = F.when(self.covers(self.rules[0]), F.lit(False))
        for rule in self.rules[1:]:
            out = out.when(self.covers(rule), F.lit(False))
        return out.otherwise(F.lit(True))

    def fired(self) -> Column:
        """Number of the first rule that covers, from 1; null if none does."""
        if not self.rules:
            return F.lit(None).cast("int")
        return F.coalesce(*[F.when(self.covers(r), F.lit(k)) for k, r in enumerate(self.rules, 1)])

    def __str__(self) -> str:
        return "\n".join([*("drop if " + " and ".join(map(str, r)) for r in self.rules), "else keep"])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``COUNTS`` of every document; the text is read once.

    Repeated windows: windows are hashed in place; only where a text repeats one are (hash, place) sorted, so that equal
    windows are neighbours. A repeated window covers its five words, less those up to the next repeated one.
    """
    d = docs.select("doc_id", text_or_empty().alias("t"))
    d = d.withColumn("w", F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).withColumn("n", F.size("w"))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)))
    d = d.withColumn("signs", F.regexp_replace("t", "[^A-Z0-9.,;:!?#*$%&|<>]+", ""))  # all that is counted below, a small part of the text
    count = lambda pattern: F.regexp_count("signs", F.lit(pattern)).cast("long")
    d = d.select("doc_id", "n", "w", F.length(F.array_join("w", "")).cast("long").alias("word_chars"), count(SYMBOLS).alias("n_symbols"),
                 F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 count("[A-Z]").alias("n_capitals"), count("[.,;:!?]").alias("n_marks"), count("!").alias("n_shouts"), count("[0-9]").alias("n_digits"),
                 F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    ahead = lambda x, i: F.xxhash64(x, *[F.get("h", i + k) for k in range(1, WINDOW)])
    d = d.withColumn("g", F.slice(F.transform("h", ahead), F.lit(1), F.greatest(F.col("n") - (WINDOW - 1), F.lit(0))))
    d = d.withColumn("n_distinct", F.size(F.array_distinct("h")).cast("long")).withColumn("again", F.size(F.array_distinct("g")) < F.size("g"))
    # places of repeated windows, ascending: in (hash, place) order a repeated window equals the one before or after it
    d = d.withColumn("s", F.when(F.col("again"), F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    twice = lambda e, j: F.when((e["x"] == F.get("s", j - 1)["x"]) | (e["x"] == F.get("s", j + 1)["x"]), e["i"])
    d = d.withColumn("p", F.when(F.col("again"), F.array_sort(F.array_compact(F.transform("s", twice)))))
    reach = lambda x, j: F.least(F.coalesce(F.get("p", j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))
    repeated = F.when(F.col("again"), F.aggregate(F.transform("p", reach), F.lit(0), lambda a, x: a + x)).otherwise(F.lit(0))
    return d.select("doc_id", F.col("n").cast("long").alias("n_words"), repeated.cast("long").alias("n_repeat_words"),
                    "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_distinct", "n_capitals", "n_marks", "n_shouts", "n_digits").select("doc_id", *COUNTS)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def labelled(stats: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The statistics of labelled documents that pass the base rules, with ``bad`` (label 0) and ``part`` (grow, or every third id: prune)."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id")
             .agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo = hi").select("doc_id", (F.col("lo") == 0).alias("bad")))
    part = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0, "prune").otherwise("grow")
    return stats.where(~base_failed()).join(bounded(written(known, "labels")), "doc_id").withColumn("part", part)


def gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gain of a condition that leaves p of p0 bad and n of n0 good documents."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def best_condition(bins: dict[str, dict[int, tuple[int, int]]], cuts: dict[str, list[float]], p0: int, n0: int) -> tuple[float, Condition | None]:
    """The condition of the highest gain given counts (bad, good) per statistic and bin; ties to the first in order."""
    top: tuple[float, Condition | None] = (0.0, None)
    for name in STATISTICS:
        p = n = 0
        for k, cut in enumerate(cuts[name]):
            b = bins.get(name, {}).get(k, (0, 0))
            p, n = p + b[0], n + b[1]
            for above, (pp, nn) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                g = gain(pp, nn, p0, n0)
                if g > top[0] + 1e-9:
                    top = (g, Condition(name, above, cut))
    return top


def learn(stats: DataFrame, labels: DataFrame, label: str = "quality", precision: float = PRECISION) -> DecisionList:
    """The decision list of the labelled documents.

    Growing adds the condition of the highest gain until a rule covers no good document, has ``CONDITIONS`` or gains nothing.
    Pruning cuts it back to the leading conditions with the best (bad - good) / (bad + good) on the pruning part, the shorter
    of equal ones. Learning ends with the first rule that falls short of ``precision`` there.
    """
    rows = written(labelled(stats, labels, label), "labelled")
    at = [k / (CUTS + 1) for k in range(1, CUTS + 1)]
    names = list(STATISTICS)
    found = rows.agg(*[F.percentile_approx(F.expr(STATISTICS[n]).cast("double"), at, 10_000).alias(n) for n in names]).first()
    cuts = {n: sorted(set(found[n] or [])) for n in names}
    if not any(cuts.values()):
        return DecisionList()
    # a statistic's bin: how many cuts lie under it, so that "at most cut k" are bins 0 to k
    bin_of = lambda n: sum((F.when(F.expr(STATISTICS[n]) > c, 1).otherwise(0) for c in cuts[n]), F.lit(0)).cast("int")
    grow = written(rows.where("part = 'grow'").select("bad", *COUNTS, F.array(*[bin_of(n) for n in names]).alias("bins")), "grow")
    prune = written(rows.where("part = 'prune'").select("bad", *COUNTS), "prune")
    tally = [F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")]
    out = DecisionList()
    while len(out.rules) < RULES:
        left, rule = grow.where(out.verdict()), []
        while len(rule) < CONDITIONS:
            here = left.where(out.covers(rule))
            counted = here.select("bad", F.posexplode("bins").alias("f", "b")).groupBy("f", "b").agg(*tally).collect()  # statistics x bins rows
            bins: dict[str, dict[int, tuple[int, int]]] = {}
            for r in counted:
                bins.setdefault(names[r.f], {})[r.b] = (r.p, r.n)
            p0, n0 = (sum(v[k] for v in bins.get(names[0], {}).values()) for k in (0, 1))
            if not p0 or not n0:
                break
            g, condition = best_condition(bins, cuts, p0, n0)
            if condition is None:
                break
            rule.append(condition)
        if not rule:
            break
        heads = [rule[:k] for k in range(1, len(rule) + 1)]
        held = prune.where(out.verdict()).agg(*[F.count_if(out.covers(h) & (F.col("bad") if bad else ~F.col("bad"))).alias(f"{'p' if bad else 'n'}{k}")
                                               for k, h in enumerate(heads) for bad in (True, False)]).first()
        worth = [((held[f"p{k}"] - held[f"n{k}"]) / max(held[f"p{k}"] + held[f"n{k}"], 1), -k) for k in range(len(heads))]
        k = -max(worth)[1]
        p, n = held[f"p{k}"], held[f"n{k}"]
        if not p or p < precision * (p + n):
            break
        out.rules.append(heads[k])
    return out


def judge(docs: DataFrame, labels: DataFrame, label: str = "quality", precision: float = PRECISION) -> DataFrame:
    """doc_id, ``COUNTS``, base_failed, kept and rule (the number of the learned rule that drops it) of every document."""
    stats = written(statistics(docs), "statistics")
    rules = learn(stats, labels, label, precision)
    return stats.select("*", base_failed().alias("base_failed")).select(
        "*", (~F.col("base_failed") & rules.verdict()).alias("kept"), F.when(~F.col("base_failed"), rules.fired()).alias("rule"))
