"""Shortlists, infix alignment and similarity between sequences
(JOIN-16, ALN-01, ALN-02, ALN-05, ALN-09..12, ALN-14, ALN-15, ALN-18, WIN-12, AGG-19)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import seq as S
from ..session import cut_lineage
from . import kmers as K
from . import ranking as R
from . import sites

# Short-list parameters.
SEED_LENGTH, SEED_STEP = 16, 25
LENGTH_WEIGHT = 0.75
SHORTLIST = 500
# Fixed value: reads below it have no orientation.
ORIENTATION_MIN = 200


def query_seeds(queries: DataFrame) -> DataFrame:
    """Distinct strided seeds of both strands: (query_id, kmer)."""
    both = queries.select("query_id", F.explode(F.array("seq", S.revcomp("seq"))).alias("seq"))
    p = K.positions(both, SEED_LENGTH, step=SEED_STEP, keep=["query_id"])
    return p.where(~F.col("kmer").contains("N")).select("query_id", "kmer").distinct()


def seed_hits(records: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, rec_id, kmer): the distinct seeds that occur in each record. Of records over A, C, G, T and N only the words that are (nearly
    all) seeds leave the tasks; those with other letters, or whose rec_id is no long, are cut into rows."""
    words = F.lit(dict(records.dtypes)["rec_id"] == "bigint") & ~F.col("seq").rlike("[^ACGTN]")
    pats = seeds.where(F.col("kmer").rlike("^[ACGT]+$")).select(F.col("kmer").alias("pair"), F.lit("+").alias("strand"), F.lit("L").alias("side"), F.col("kmer").alias("pattern")).distinct()
    found = K.positions(records.where(~words), SEED_LENGTH, keep=["rec_id"]).drop("pos")
    if dict(records.dtypes)["rec_id"] == "bigint":
        found = found.unionByName(sites.word_sites(records.where(words).select(F.col("rec_id").alias("read_id"), "seq"), pats, (SEED_LENGTH, SEED_LENGTH), plain_reads=True).select(
            F.col("read_id").alias("rec_id"), F.col("pair").alias("kmer")))
    return found.join(seeds, "kmer").select("query_id", "rec_id", "kmer").distinct()


def shortlist(queries: DataFrame, records: DataFrame, top: int = SHORTLIST, guaranteed: Column | None = None) -> DataFrame:
    """Most promising records per query by weighted seed containment (JOIN-16).

    queries: (query_id, seq); records: (rec_id, header, seq). score = sum over shared seeds of
    ln(N / (1 + df)), divided by 1 - b + b * length / mean length. Every record sharing a seed
    is scored; ``top`` is the size of the report. Records matching ``guaranteed`` are appended
    with the rank they would have had.

    Record k-mers meet the seeds before anything is shuffled (``seed_hits``). A seed shared by many records is one
    hot join key with two shuffled sides, which adaptive execution splits when the seed table is too large to broadcast.
    """
    records = S.bind(records.select("rec_id", "header", F.col("seq").alias("_s")), seq=F.col("_s")).drop("_s")
    rec = records.where(F.length("seq") >= 100)
    stats = records.agg(F.count(F.when(F.length("seq") >= 100, 1)).alias("N"), F.avg(F.length("seq")).alias("mean_len"))
    hits = cut_lineage(seed_hits(rec, cut_lineage(query_seeds(queries))))
    df = hits.groupBy("query_id", "kmer").agg(F.count(F.lit(1)).alias("df"))
    meta = rec.select("rec_id", "header", F.length("seq").alias("len"))
    idf = F.log(F.greatest(F.col("N"), F.lit(2)) / (1.0 + F.col("df")))
    scored = (hits.join(df, ["query_id", "kmer"]).join(F.broadcast(stats))  # stats is one row
              .groupBy("query_id", "rec_id", "mean_len").agg(F.count(F.lit(1)).alias("seeds"), F.sum(idf).alias("raw")))
    norm = 1.0 - LENGTH_WEIGHT + LENGTH_WEIGHT * F.col("len") / F.col("mean_len")
    scored = scored.join(meta, "rec_id").withColumn("score", F.round(F.col("raw") / norm, 9)).select(
        "query_id", "rec_id", "header", "seeds", "score")
    order = [F.desc("score"), F.col("header"), F.col("rec_id")]
    if guaranteed is None:
        return R.top_n(scored, ["query_id"], order, top)
    # guaranteed records do not take a place: their rank is 1 + the others that score higher, over all scored records.
    # Distinct scores are counted first, so the running count orders a few values of a query and not its records
    plain = R.top_n(scored.where(~guaranteed), ["query_id"], order, top).withColumn("source", F.lit("seed"))
    scores = scored.groupBy("query_id", "score").agg(F.count(F.when(~guaranteed, 1)).alias("n"))
    above = Window.partitionBy("query_id").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = scores.select("query_id", "score", (F.coalesce(F.sum("n").over(above), F.lit(0)) + 1).cast("int").alias("rank"))
    extra = scored.where(guaranteed).join(ranks, ["query_id", "score"])
    extra = extra.withColumn("source", F.when(F.col("rank") <= top, "seed").otherwise("guaranteed"))
    return plain.unionByName(extra.select(plain.columns))


def infix_distance(query: str, target: str) -> int:
    """Edits to place the whole query somewhere inside the target; N never matches.

    The column of the edit matrix is held as two bit vectors of its vertical steps, one bit per
    query base in one Python integer, so a target base costs a few whole-vector operations.
    Once the rest of the target cannot better the best end found, the walk stops.
    """
    size, left = len(query), len(target)
    if not size or not left:
        return size
    where: dict[str, int] = {}
    for i, base in enumerate(query):
        if base != "N":
            where[base] = where.get(base, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score, best = full, 0, size, size
    for base in target:
        match = where.get(base, 0)
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        rises, falls = down | (full & ~(diagonal | up)), up & diagonal
        if rises & top:
            score += 1
        elif falls & top:
            score -= 1
            best = min(best, score)
        left -= 1
        if score - left >= best:
            break
        rises, falls = rises << 1 & full, falls << 1 & full
        up, down = falls | (full & ~(diagonal | rises)), rises & diagonal
    return best


@F.pandas_udf(IntegerType())
def infix_distance_udf(q: pd.Series, t: pd.Series) -> pd.Series:
    return pd.Series([infix_distance(a, b) for a, b in zip(q, t)], dtype="int32")


def infix_identity(query: str, target: str) -> Column:
    """100 * (1 - edits / query length) with free target ends (ALN-01)."""
    return 100.0 * (1.0 - infix_distance_udf(F.col(query), F.col(target)) / F.length(query))


def align_shortlist(short: DataFrame, queries: DataFrame, records: DataFrame, keep: int = 10) -> DataFrame:
    """Align every shortlisted record on its better strand; best ``keep`` with the seed rank
    of the winner (ALN-15). The shorter sequence is the query of the alignment."""
    s = short.join(queries.select("query_id", F.col("seq").alias("q")), "query_id").join(
        records.select("rec_id", F.col("seq").alias("t")), "rec_id")
    # alignments are the expensive step: spread them over all tasks by pair
    s = s.repartition(F.col("query_id"), F.col("rec_id"))
    s = s.withColumn("a", F.when(F.length("q") <= F.length("t"), F.col("q")).otherwise(F.col("t"))).withColumn(
        "b", F.when(F.length("q") <= F.length("t"), F.col("t")).otherwise(F.col("q"))).withColumn("ra", S.revcomp("a"))
    s = s.withColumn("d", F.least(infix_distance_udf("a", "b"), infix_distance_udf("ra", "b")))
    s = s.withColumn("identity", F.round(100.0 * (1.0 - F.col("d") / F.length("a")), 2)).withColumn(
        "aligned", F.length("a"))
    s = s.select("query_id", "rec_id", "header", F.col("rank").alias("seed_rank"), "identity", "aligned")
    order = [F.desc("identity"), F.desc("aligned"), F.col("header"), F.col("rec_id")]
    return R.top_n(s, ["query_id"], order, keep).withColumn("late_winner", (F.col("rank") == 1) & (F.col("seed_rank") > 200))


def discriminating_window(best: DataFrame, queries: DataFrame, records: DataFrame, width: int = 120, step: int = 60) -> DataFrame:
    """Query window whose identities differ most among the best records (ALN-02).

    best: (query_id, rec_id), at most eight records per query.
    """
    w = queries.select("query_id", "seq", F.explode(F.sequence(
        F.lit(0), F.greatest(F.length("seq") - width, F.lit(0)), F.lit(step))).alias("at"))
    w = w.withColumn("win", F.substring(F.col("seq"), F.col("at") + 1, F.lit(width))).drop("seq")
    w = w.where((F.length("win") >= 60) & (F.length(F.regexp_replace("win", "[^N]", "")) <= 10))
    p = w.join(best.select("query_id", "rec_id"), "query_id").join(records.select("rec_id", F.col("seq").alias("t")), "rec_id")
    p = p.repartition("query_id", "rec_id", "at").withColumn("rw", S.revcomp("win"))
    d = F.least(infix_distance_udf("win", "t"), infix_distance_udf("rw", "t"))
    p = p.withColumn("identity", F.round(100.0 * (1.0 - d / F.length("win")), 2))
    g = p.groupBy("query_id", "at").agg((F.max("identity") - F.min("identity")).alias("spread"), F.count(F.lit(1)).alias("records"))
    m = g.where(F.col("records") >= 2).groupBy("query_id").agg(F.min(F.struct(
        (-F.col("spread")).alias("neg"), F.col("at"), F.col("records"))).alias("m"))
    return m.select("query_id", F.col("m.at").alias("at"), F.round(-F.col("m.neg"), 2).alias("spread"), F.col("m.records").alias("records"))


def sample_similarity(sample: DataFrame, k: int = 15) -> DataFrame:
    """Best-strand k-mer Jaccard between sampled reads of one bin (ALN-05).

    sample: (bin, read_id, seq), bounded to a fixed number of reads per bin by the sampler.
    Both orders of a pair are returned.
    """
    a = K.kmer_set(sample, k, ["bin", "read_id"])
    r = K.kmer_set(sample.withColumn("seq", S.revcomp("seq")), k, ["bin", "read_id"])
    size = a.groupBy("bin", "read_id").agg(F.count(F.lit(1)).alias("n"))
    strands = a.withColumn("s", F.lit("+")).unionByName(r.withColumn("s", F.lit("-")))
    left = a.select("bin", "kmer", F.col("read_id").alias("a"))
    right = strands.select("bin", "kmer", "s", F.col("read_id").alias("b"))
    sh = left.join(right.hint("merge"), ["bin", "kmer"]).where("a <> b").groupBy("bin", "a", "b", "s").agg(F.count(F.lit(1)).alias("c"))
    j = (sh.join(size.select("bin", F.col("read_id").alias("a"), F.col("n").alias("na")), ["bin", "a"])
         .join(size.select("bin", F.col("read_id").alias("b"), F.col("n").alias("nb")), ["bin", "b"]))
    return j.groupBy("bin", "a", "b").agg(F.max(F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("jaccard"))


def medoid(sample: DataFrame, similarity: DataFrame, min_length_share: float = 0.9) -> DataFrame:
    """Sampled read most similar to the others, among those near the median length (WIN-12)."""
    s = sample.select("bin", "read_id", F.length("seq").alias("len"))
    med = R.exact_median(s, ["bin"], "len")
    n = s.groupBy("bin").agg((F.count(F.lit(1)) - 1).alias("others"))
    total = similarity.groupBy("bin", F.col("a").alias("read_id")).agg(F.sum("jaccard").alias("total"))
    c = (s.join(med, "bin").join(n, "bin").where(F.col("len") >= min_length_share * F.col("median"))
         .join(total, ["bin", "read_id"], "left"))
    mean = F.when(F.col("others") > 0, F.round(F.coalesce("total", F.lit(0.0)) / F.col("others"), 9)).otherwise(F.lit(0.0))
    m = c.withColumn("mean", mean).groupBy("bin").agg(F.min(F.struct((-F.col("mean")).alias("neg"), F.col("read_id"))).alias("m"))
    return m.select("bin", F.col("m.read_id").alias("medoid"), (-F.col("m.neg")).alias("mean_similarity"))


def best_record(hits: DataFrame, key: list[str], min_aligned: int = 250) -> DataFrame:
    """Best record per read: identity, then aligned length, then title (ALN-09)."""
    ok = hits.where(F.col("aligned") >= min_aligned)
    m = ok.groupBy(*key).agg(F.min(F.struct((-F.col("identity")).alias("ni"), (-F.col("aligned")).alias("na"),
                                            F.col("title"))).alias("m"))
    return m.select(*key, "m.title", (-F.col("m.ni")).alias("identity"), (-F.col("m.na")).alias("aligned"))


def locus_window(reads: DataFrame, spans: DataFrame, flank: int = 60) -> DataFrame:
    """Part of each read around its mapped span; unmapped reads stay whole (ALN-10)."""
    j = reads.join(spans, "read_id", "left")
    lo = F.greatest(F.col("span_start") - flank, F.lit(0))
    cut = F.substring(F.col("seq").cast("binary"), lo + 1, F.col("span_end") + flank - lo).cast("string")
    return j.select("read_id", F.when(F.col("span_start").isNull(), F.col("seq")).otherwise(cut).alias("window"),
                    F.col("span_start").isNull().alias("whole"))


def leak_share(scores: DataFrame, key: str, own: str, other: str) -> DataFrame:
    """Share of a competitor's reads that score strictly higher on the target (ALN-11)."""
    return scores.groupBy(key).agg(F.count(F.when(F.col(other) > F.col(own), 1)).alias("leaked"), F.count(F.lit(1)).alias("n")
                                   ).withColumn("share", F.col("leaked") / F.col("n"))


def unique_best(hits: DataFrame, key: str, target: str, score: str) -> DataFrame:
    """Best target per read; a tie is unknown (ALN-12)."""
    m = hits.groupBy(key, target).agg(F.max(score).alias("s"))
    top = m.groupBy(key).agg(F.max(F.struct("s", target)).alias("m"), F.max("s").alias("best"))
    ties = m.join(top, key).where(F.col("s") == F.col("best")).groupBy(key).agg(
        F.count(F.lit(1)).alias("ties"), F.min(target).alias(target))
    return ties.select(key, F.when(F.col("ties") == 1, F.col(target).cast("string")).otherwise("unknown").alias("call"))


def orientation_call(votes: DataFrame) -> DataFrame:
    """Orientation from two independent criteria (ALN-14). votes: (id, length, f1, r1, f2, r2).

    Both silent or disagreeing stays undecided and is never flipped; so does a read too short to
    hold all motifs, whatever its counts.
    """
    long = F.col("length") >= ORIENTATION_MIN
    def side(f, r):
        return F.when(long & (F.col(f) > F.col(r)), "forward").when(long & (F.col(r) > F.col(f)), "reverse")

    a, b = side("f1", "r1"), side("f2", "r2")
    return votes.select("*", F.when(a.isNotNull() & b.isNotNull() & (a == b), a).when(a.isNotNull() & b.isNotNull(), "undecided")
                        .otherwise(F.coalesce(a, b, F.lit("undecided"))).alias("orientation"),
                        F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, "agree").otherwise("diverge"))
                        .when(a.isNotNull() | b.isNotNull(), "single").otherwise("none").alias("basis"))


def offset_similarity(pairs: DataFrame, step: int = 5) -> DataFrame:
    """Best ungapped identity of two sequences over strided offsets (ALN-18). pairs: (id, x, y)."""
    nx, ny = F.length("x"), F.length("y")
    o = pairs.select("id", "x", "y", F.explode(F.sequence(-((ny / 2).cast("int")), (nx / 2).cast("int"), F.lit(step))).alias("off"))
    lo, hi = F.greatest(F.col("off"), F.lit(0)), F.least(nx, ny + F.col("off"))
    o = o.withColumn("n", hi - lo).where(F.col("n") > 0)
    a = F.substring(F.col("x"), lo + 1, F.col("n"))
    b = F.substring(F.col("y"), lo - F.col("off") + 1, F.col("n"))
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda p, q: p == q), lambda m: m))
    o = o.withColumn("identity", F.round(same / F.col("n"), 9))
    m = o.groupBy("id").agg(F.min(F.struct((-F.col("identity")).alias("neg"), F.col("off"))).alias("m"))
    return m.select("id", F.col("m.off").alias("offset"), (-F.col("m.neg")).alias("identity"))


def identity_matrix(seqs: DataFrame, group: str) -> DataFrame:
    """Infix identity of every pair within a class of consensus sequences (AGG-19).

    One consensus per bin and one class per few bins make this a small table by definition;
    equal sequences are folded first and expanded afterwards.
    """
    u = seqs.groupBy(group, "seq").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn(
        "u", F.get("ids", F.lit(0)))
    a = u.select(group, F.col("u").alias("ua"), F.col("ids").alias("ia"), F.col("seq").alias("sa"))
    b = u.select(group, F.col("u").alias("ub"), F.col("ids").alias("ib"), F.col("seq").alias("sb"))
    p = a.join(b, group).where("ua < ub").repartition(F.col("ua"), F.col("ub"))
    p = p.withColumn("q", F.when(F.length("sa") <= F.length("sb"), F.col("sa")).otherwise(F.col("sb"))).withColumn(
        "t", F.when(F.length("sa") <= F.length("sb"), F.col("sb")).otherwise(F.col("sa")))
    p = p.withColumn("identity", F.round(infix_identity("q", "t"), 2))
    cross = p.select(group, F.explode("ia").alias("a"), "ib", "identity").select(group, "a", F.explode("ib").alias("b"), "identity")
    equal = u.where(F.size("ids") > 1).select(group, F.explode("ids").alias("a"), "ids").select(
        group, "a", F.explode("ids").alias("b"), F.lit(100.0).alias("identity")).where("a < b")
    return cross.select(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "identity").unionByName(equal)
