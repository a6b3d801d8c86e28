"""Scalar expressions over whole documents: SEQ, FLT and MTH families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as X
from ..functions import seq as S
from ..functions import stats as M
from ..operators import kmers as K
from .binding import READS, REFS, documents, reads, references, sql_kmers, sql_rc, table
from .panel import wilson_sql
from .registry import query

UP = "translate(text, 'acgtun', 'ACGTUN')"
CLEAN = f"replace(regexp_replace({UP}, '[^ACGTUN]', 'N', 'g'), 'U', 'T')"


@query("seq_clean_rc", "SEQ-01 SEQ-02 SEQ-03",
       f"""WITH c AS (SELECT doc_id, {CLEAN} AS s FROM documents)
SELECT doc_id, md5(s) AS clean_md5, md5({sql_rc('s')}) AS rc_md5,
  md5(translate(regexp_replace(s, '[^ACGT]', '4', 'g'), 'ACGT', '0123')) AS code_md5, length(s) AS n FROM c""")
def seq_clean_rc(spark, sf):
    c = documents(spark, sf).select("doc_id", S.clean("text").alias("s"))
    return c.select("doc_id", F.md5("s").alias("clean_md5"), F.md5(S.revcomp("s")).alias("rc_md5"),
                    F.md5(S.digits("s")).alias("code_md5"), F.length("s").cast("long").alias("n"))


IUPAC_SQL = """codes(code, bases) AS (VALUES ('A','A'),('C','C'),('G','G'),('T','T'),('R','AG'),('Y','CT'),('S','CG'),
 ('W','AT'),('K','GT'),('M','AC'),('B','CGT'),('D','AGT'),('H','ACT'),('V','ACG'),('N','ACGT'))"""
AMB = "regexp_replace(upper(word), '[^ACGTRYSWKMBDHVN]', '', 'g')"


def _ambiguous_words(spark, sf):
    """Distinct ambiguous oligos spelled by the ASCII words of all documents."""
    w = documents(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("word"))
    return w.select(F.regexp_replace(F.upper("word"), "[^ACGTRYSWKMBDHVN]", "").alias("oligo")).where("oligo <> ''").distinct()


WORDS_SQL = f"""words AS (SELECT DISTINCT {AMB} AS oligo FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word
  FROM documents) WHERE {AMB} <> '')"""


@query("iupac_match", "SEQ-04",
       f"""WITH {WORDS_SQL}, {IUPAC_SQL}, pos AS (SELECT oligo, unnest(range(1, length(oligo) + 1)) AS i FROM words)
SELECT oligo, count(*) FILTER (substr(reverse(oligo), i, 1) <> 'N' AND length(translate(a.bases, b.bases, '')) < length(a.bases))
  AS matches, count(*) AS n FROM pos JOIN codes a ON a.code = substr(oligo, i, 1)
  JOIN codes b ON b.code = substr(reverse(oligo), i, 1) GROUP BY 1""")
def iupac_match(spark, sf):
    w = _ambiguous_words(spark, sf)
    n = F.length("oligo")
    bad = S.mismatch_positions(S.primer_mask("oligo"), S.template_mask(F.reverse("oligo")), n)
    return w.select("oligo", (n - F.size(bad)).cast("long").alias("matches"), n.cast("long").alias("n"))


@query("iupac_expansion", "SEQ-05",
       f"""WITH RECURSIVE {WORDS_SQL}, {IUPAC_SQL},
size AS (SELECT oligo, product(length(bases)) AS variants FROM (SELECT oligo, unnest(string_split(oligo, '')) AS c FROM words)
  JOIN codes ON code = c GROUP BY 1),
grow(oligo, i, prefix) AS (SELECT oligo, 0, '' FROM size WHERE variants <= 64 UNION ALL
  SELECT oligo, i + 1, prefix || b FROM (SELECT g.*, unnest(string_split(bases, '')) AS b FROM grow g
    JOIN codes ON code = substr(oligo, i + 1, 1)))
SELECT oligo, prefix AS variant FROM grow WHERE i = length(oligo) UNION ALL SELECT oligo, NULL FROM size WHERE variants > 64""")
def iupac_expansion(spark, sf):
    return _ambiguous_words(spark, sf).select("oligo", F.explode_outer(S.expand_codes("oligo", 64)).alias("variant"))


@query("iupac_reject_reason", "SEQ-06",
       f"""WITH {WORDS_SQL} SELECT oligo, CASE WHEN contains(oligo, 'N') THEN 'template_n'
  WHEN length(regexp_replace(oligo, '[ACGT]', '', 'g')) > 2 THEN 'too_many_codes'
  WHEN regexp_matches(right(oligo, 5), '[^ACGT]') THEN 'code_in_3prime' END AS reason FROM words""")
def iupac_reject_reason(spark, sf):
    return _ambiguous_words(spark, sf).select("oligo", S.ambiguity_reject("oligo", 2, 5).alias("reason"))


@query("oligo_composition", "SEQ-07 SEQ-08 SEQ-09 THR-05",
       f"""WITH {READS} SELECT read_id, round(100.0 * length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq), 1) AS gc,
  coalesce(list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda x: length(x))), 0) AS longest_run,
  regexp_matches(seq, 'AAAA|CCCC|GGGG|TTTT') AS run_of_four, right(seq, 1) AS end_base,
  length(regexp_replace(right(seq, 5), '[^GC]', '', 'g')) AS gc_last5 FROM reads WHERE seq <> ''""")
def oligo_composition(spark, sf):
    r = reads(spark, sf).where("seq <> ''")
    return r.select("read_id", F.round(S.gc_percent("seq"), 1).alias("gc"), S.max_run("seq").cast("long").alias("longest_run"),
                    S.has_run_of_four("seq").alias("run_of_four"), S.last_base("seq").alias("end_base"),
                    S.gc_in_last5("seq").cast("long").alias("gc_last5"))


@query("kmer_profile", "SEQ-10",
       f"""WITH {READS}, {sql_kmers(21)} SELECT read_id, count(*) AS n_kmers, count(DISTINCT kmer) AS distinct_kmers,
  count(DISTINCT least(kmer, {sql_rc('kmer')})) AS canonical_kmers FROM kmers GROUP BY 1""")
def kmer_profile(spark, sf):
    return K.profile(reads(spark, sf), 21)


@query("strided_seeds", "SEQ-11",
       f"""WITH {READS}, {sql_kmers(16, step=25)} SELECT read_id, count(*) AS n_seeds, count(DISTINCT kmer) AS distinct_seeds
  FROM kmers GROUP BY 1""")
def strided_seeds(spark, sf):
    p = K.positions(reads(spark, sf), 16, step=25, keep=["read_id"])
    d = p.groupBy("read_id", "kmer").agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy("read_id").agg(F.sum("n").alias("n_seeds"), F.count(F.lit(1)).alias("distinct_seeds"))


@query("unique_kmer_index", "SEQ-12",
       f"""WITH {READS}, {sql_kmers(15)}, u AS (SELECT read_id, kmer, min(pos) AS pos FROM kmers GROUP BY ALL HAVING count(*) = 1)
SELECT read_id, count(*) AS unique_kmers, sum(pos)::BIGINT AS pos_sum FROM u GROUP BY 1""")
def unique_kmer_index(spark, sf):
    return K.unique_profile(reads(spark, sf), 15)


WIN_SQL = f"""wins AS (SELECT ref_id, pos, len, dir, CASE dir WHEN 'F' THEN w ELSE {sql_rc('w')} END AS oligo FROM (
  SELECT ref_id, pos, len, substr(seq, pos + 1, len) AS w FROM (
    SELECT ref_id, seq, len, unnest(range(0, length(seq) - len + 1)) AS pos FROM (
      SELECT ref_id, seq, unnest(range(18, 26)) AS len FROM refs) WHERE length(seq) >= len)),
  (VALUES ('F'), ('R')) d(dir))"""


def windows(spark, sf):
    return K.windows(references(spark, sf), 18, 25, ["ref_id"])


@query("oligo_windows", "SEQ-13", f"WITH {REFS}, {WIN_SQL} SELECT ref_id, pos, len, dir, oligo FROM wins")
def oligo_windows(spark, sf):
    return windows(spark, sf)


@query("least_n_window", "SEQ-14",
       f"""WITH c AS (SELECT doc_id, {CLEAN} AS s FROM documents WHERE length(text) > 200),
w AS (SELECT doc_id, s, unnest(range(0, length(s) - 199, greatest(1, (length(s) - 200) // 40))) AS p FROM c),
n AS (SELECT doc_id, p, length(regexp_replace(substr(s, p + 1, 200), '[^N]', '', 'g')) AS n FROM w)
SELECT doc_id, arg_min(p, n * 1000000 + p) AS start, min(n) AS n_count FROM n GROUP BY 1""")
def least_n_window(spark, sf):
    c = documents(spark, sf).where(F.length("text") > 200).select("doc_id", S.clean("text").alias("s"))
    span = F.length("s") - 200
    step = F.greatest(F.lit(1), F.floor(span / 40).cast("int"))
    w = c.select("doc_id", F.col("s").cast("binary").alias("b"), F.explode_outer(F.sequence(F.lit(0), span, step)).alias("p"))
    piece = F.substring("b", F.col("p") + 1, F.lit(200)).cast("string")
    n = w.select("doc_id", "p", F.length(F.regexp_replace(piece, "[^N]", "")).alias("n"))
    m = n.groupBy("doc_id").agg(F.min(F.struct("n", "p")).alias("m"))
    return m.select("doc_id", F.col("m.p").cast("long").alias("start"), F.col("m.n").cast("long").alias("n_count"))


@query("phred_error", "SEQ-15",
       """WITH q AS (SELECT doc_id, regexp_replace(text, '[^!-~]', '', 'g') AS qual FROM documents)
SELECT doc_id, round(avg(pow(10.0, -(ascii(c) - 33) / 10.0)), 8) AS mean_error FROM (
  SELECT doc_id, unnest(string_split(qual, '')) AS c FROM q WHERE qual <> '') GROUP BY 1""")
def phred_error(spark, sf):
    q = documents(spark, sf).select("doc_id", F.regexp_replace("text", "[^!-~]", "").alias("qual")).where("qual <> ''")
    return q.select("doc_id", F.round(S.phred_error("qual"), 8).alias("mean_error"))


CIGAR = """cig AS (SELECT l_orderkey, l_linenumber, l_linenumber || 'S' || l_quantity::INTEGER || 'M' || l_linenumber || 'I' ||
  (l_quantity * 2)::INTEGER || '=' || (l_partkey % 7 + 1) || 'D' || (l_suppkey % 5 + 1) || 'X' || l_linenumber || 'H' AS cigar,
  row_number() OVER () AS rid FROM lineitem)"""


def _cigars(spark, sf):
    li = table(spark, sf, "lineitem")
    n = F.col("l_linenumber").cast("string")
    q = F.col("l_quantity").cast("int").cast("string")
    cigar = F.concat(n, F.lit("S"), q, F.lit("M"), n, F.lit("I"), (F.col("l_quantity") * 2).cast("int").cast("string"),
                     F.lit("="), (F.col("l_partkey") % 7 + 1).cast("string"), F.lit("D"),
                     (F.col("l_suppkey") % 5 + 1).cast("string"), F.lit("X"), n, F.lit("H"))
    return li.select("l_orderkey", "l_linenumber", cigar.alias("cigar"))


@query("cigar_walk", "SEQ-16",
       f"""WITH {CIGAR}, o AS (SELECT *, regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 1) AS ln,
  regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 2) AS op FROM cig),
x AS (SELECT l_orderkey, l_linenumber, cigar, rid, unnest(ln)::BIGINT AS n, unnest(op) AS op, generate_subscripts(ln, 1) AS i FROM o)
SELECT l_orderkey, l_linenumber, cigar, coalesce(sum(n) FILTER (op IN ('M','D','N','=','X')), 0)::BIGINT AS ref_len,
  coalesce(sum(n) FILTER (op IN ('M','I','=','X')), 0)::BIGINT AS query_len,
  coalesce(max(n) FILTER (i = 1 AND op IN ('S','H')), 0)::BIGINT AS clip, count(*) AS ops FROM x GROUP BY rid, l_orderkey, l_linenumber, cigar""")
def cigar_walk(spark, sf):
    c = S.bind(_cigars(spark, sf), m=S.cigar_measures("cigar"))
    return c.select("l_orderkey", "l_linenumber", "cigar", *[F.col(f"m.{x}").cast("long").alias(x) for x in ("ref_len", "query_len", "clip")],
                    F.size("m.walk").cast("long").alias("ops"))


# ---- predicates ------------------------------------------------------------------------

@query("length_class", "FLT-07 FLT-10",
       f"""WITH {READS}, c AS (SELECT bin, CASE WHEN length(seq) < 300 THEN 'short' WHEN length(seq) < 0.8 * 1500 THEN 'fragment'
  WHEN length(seq) <= 1.25 * 1500 THEN 'full' ELSE 'concatemer' END AS class FROM reads)
SELECT bin, class, count(*) AS n FROM c GROUP BY ALL""")
def length_class(spark, sf):
    r = reads(spark, sf).select("bin", X.length_class(F.length("seq"), F.lit(1500)).alias("class"))
    return r.groupBy("bin", "class").agg(F.count(F.lit(1)).alias("n"))


@query("long_read_filter", "FLT-10",
       f"""WITH {READS} SELECT bin, count(*) FILTER (length(seq) <= 1875) AS kept, count(*) FILTER (length(seq) > 1875) AS dropped
  FROM reads GROUP BY 1""")
def long_read_filter(spark, sf):
    r = reads(spark, sf).select("bin", F.length("seq").alias("n"))
    return r.groupBy("bin").agg(F.count(F.when(F.col("n") <= 1875, 1)).alias("kept"),
                                F.count(F.when(F.col("n") > 1875, 1)).alias("dropped"))


@query("concatemer_bins", "FLT-08",
       f"""WITH {READS} SELECT bin, round(quantile_cont(length(seq), 0.5), 3) AS median_len,
  quantile_cont(length(seq), 0.5) > 1.6 * 600 AS concatemer FROM reads GROUP BY 1""")
def concatemer_bins(spark, sf):
    from ..operators.ranking import exact_median
    m = exact_median(reads(spark, sf).select("bin", F.length("seq").alias("len")), ["bin"], "len")
    return m.select("bin", F.round("median", 3).alias("median_len"),
                    X.is_concatemer("median", F.lit(600)).alias("concatemer"))


@query("alignment_sufficient", "FLT-09",
       """SELECT l_orderkey, l_linenumber, l_quantity * 20 >= 600 OR (l_partkey > 0 AND l_quantity * 20 >= 250
  AND l_quantity * 20 >= 0.9 * l_partkey) AS ok FROM lineitem""")
def alignment_sufficient(spark, sf):
    li = table(spark, sf, "lineitem")
    ok = X.alignment_sufficient(F.col("l_quantity") * 20, F.lit(600), F.col("l_partkey"))
    return li.select("l_orderkey", "l_linenumber", ok.alias("ok"))


@query("composition_reject_counts", "FLT-04",
       f"""WITH {REFS}, {WIN_SQL}, r AS (SELECT CASE
  WHEN 100.0 * length(regexp_replace(oligo, '[^GC]', '', 'g')) / length(oligo) NOT BETWEEN 40 AND 60 THEN 'gc'
  WHEN regexp_matches(oligo, 'AAAAA|CCCCC|GGGGG|TTTTT') THEN 'run' WHEN right(oligo, 1) NOT IN ('G', 'C') THEN 'end_not_gc'
  WHEN length(regexp_replace(right(oligo, 5), '[^GC]', '', 'g')) > 3 THEN 'last5_gc' ELSE 'ok' END AS reason FROM wins)
SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def composition_reject_counts(spark, sf):
    w = windows(spark, sf).select(F.coalesce(X.composition_reason("oligo"), F.lit("ok")).alias("reason"))
    return w.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("invariant_oligo_filter", "FLT-02",
       f"""WITH {REFS}, {WIN_SQL} SELECT ref_id, dir, count(*) AS n, count(*) FILTER (NOT regexp_matches(oligo,
  'AAAA|CCCC|GGGG|TTTT')) AS passed FROM wins GROUP BY ALL""")
def invariant_oligo_filter(spark, sf):
    w = windows(spark, sf)
    return w.groupBy("ref_id", "dir").agg(F.count(F.lit(1)).alias("n"),
                                          F.count(F.when(X.invariant_oligo_ok("oligo"), 1)).alias("passed"))


@query("same_size_split", "FLT-15",
       """SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 100 + o_custkey % 30 END AS expected,
  count(*) FILTER (abs(l_quantity * 3 - CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 100 + o_custkey % 30 END) <= 10) AS same_size,
  count(*) FILTER (NOT coalesce(abs(l_quantity * 3 - CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 100 + o_custkey % 30 END) <= 10, false)) AS off_target
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def same_size_split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 30 + 100)
                                          .alias("expected"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_quantity") * 3).alias("bp"))
    same = X.same_size("bp", "expected")
    return o.join(li, "o_orderkey").groupBy("o_orderkey", "expected").agg(
        F.count(F.when(same, 1)).alias("same_size"), F.count(F.when(~same, 1)).alias("off_target"))


# ---- statistics ------------------------------------------------------------------------

@query("wilson_bounds", "MTH-01",
       f"""WITH c AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS k, count(*) FILTER (l_linestatus = 'O') +
  count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'O') AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, k, n, round({wilson_sql('k', 'n', False)}, 8) AS low, round({wilson_sql('k', 'n', True)}, 8) AS high FROM c""")
def wilson_bounds(spark, sf):
    r, o = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    c = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.when(r, 1)).alias("k"), F.count(F.when(r | o, 1)).alias("n"))
    return c.select("l_suppkey", "k", "n", F.round(M.wilson_lower("k", "n"), 8).alias("low"),
                    F.round(M.wilson_upper("k", "n"), 8).alias("high"))


@query("fold_dcq", "MTH-02 MTH-08 DEC-25",
       """WITH f AS (SELECT o_orderkey, o_totalprice / 40000.0 - 1.0 AS fold FROM orders)
SELECT o_orderkey, CASE WHEN fold > 0 THEN round(ln(fold) / ln(2.0), 6) END AS dcq,
  CASE WHEN fold > 0 THEN round(ln(fold) / ln(1.9), 6) END AS dcq_90,
  round(greatest(CASE WHEN fold > 0 THEN log2(fold) + 4.3 ELSE 3.32 END, 3.32), 6) AS required,
  CASE WHEN fold IS NULL THEN 'UNIVERSAL' WHEN fold >= 8 THEN 'CERTAIN' WHEN fold >= 4 THEN 'CONDITIONAL'
    ELSE 'NOT RECOMMENDED' END AS class FROM f""")
def fold_dcq(spark, sf):
    f = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 40000.0 - 1.0).alias("fold"))
    return f.select("o_orderkey", F.round(M.fold_to_dcq("fold"), 6).alias("dcq"),
                    F.round(M.fold_to_dcq("fold", 0.9), 6).alias("dcq_90"),
                    F.round(M.required_dcq("fold"), 6).alias("required"), M.fold_class("fold").alias("class"))


@query("abundance_threshold", "MTH-03",
       """WITH a AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A')::DOUBLE AS target,
  count(*) FILTER (l_returnflag <> 'A')::DOUBLE AS other FROM lineitem GROUP BY 1),
t AS (SELECT l_suppkey, CASE WHEN target > 0 THEN other / target END AS r FROM a)
SELECT l_suppkey, round(r, 8) AS ratio, round(greatest(CASE WHEN r > 0 THEN log2(r) + 4.3 ELSE 3.32 END, 3.32), 6) AS required,
  greatest(CASE WHEN r > 0 THEN log2(r) + 4.3 ELSE 3.32 END, 3.32) > 3.0 AS disagrees FROM t""")
def abundance_threshold(spark, sf):
    a = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.when(F.col("l_returnflag") == "A", 1)).cast("double").alias("target"),
        F.count(F.when(F.col("l_returnflag") != "A", 1)).cast("double").alias("other"))
    t = a.withColumn("r", M.ratio("other", "target")).withColumn("q", M.required_dcq("r"))
    return t.select("l_suppkey", F.round("r", 8).alias("ratio"), F.round("q", 6).alias("required"),
                    (F.col("q") > 3.0).alias("disagrees"))


@query("mixture_threshold", "MTH-04",
       """WITH e AS (SELECT l_suppkey, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE avg(l_discount) / 2 END AS eps FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(least(greatest(100.0 - 2.5 * 2.0 * coalesce(eps, 0.02) * 100.0, 88.0), 99.0), 6) AS threshold FROM e""")
def mixture_threshold(spark, sf):
    e = table(spark, sf, "lineitem").groupBy("l_suppkey").agg((F.avg("l_discount") / 2).alias("eps"))
    eps = F.when(F.col("l_suppkey") % 9 != 0, F.col("eps"))
    return e.select("l_suppkey", F.round(M.mixture_threshold(eps), 6).alias("threshold"))


@query("separability", "MTH-05",
       """SELECT l_orderkey, l_linenumber, l_partkey % 60 >= greatest(3.0, 3.0 * sqrt(l_discount * l_quantity * 30 + 1.0)) AS by_reference,
  abs(l_quantity - l_linenumber) >= 3.0 * sqrt(l_quantity + l_linenumber + 1.0) AS by_measurement FROM lineitem""")
def separability(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     M.reference_separable(F.col("l_partkey") % 60, F.col("l_discount"), F.col("l_quantity") * 30).alias("by_reference"),
                     M.measurement_separable("l_quantity", "l_linenumber").alias("by_measurement"))
