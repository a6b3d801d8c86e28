"""Shortlist, alignment and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import kmers as K
from ..operators import ranking as R
from ..operators import similarity as A
from ..operators import sites
from .binding import PANEL, READS, REFS, panel, reads, references, sql_kmers, sql_rc, table
from .panel import BASE, PRODUCTS, BEST, _best, _sites
from .registry import query
from .scalars import CIGAR, _ambiguous_words, _cigars, WORDS_SQL, IUPAC_SQL


def _queries(spark, sf):
    return references(spark, sf).withColumnRenamed("ref_id", "query_id")


def _records(spark, sf):
    return reads(spark, sf).select(F.col("read_id").alias("rec_id"), F.concat("bin", F.lit(":"), "library").alias("header"), "seq")


SHORT_SQL = f"""q2 AS (SELECT ref_id AS query_id, seq FROM refs UNION ALL SELECT ref_id, {sql_rc('seq')} FROM refs),
seeds AS (SELECT DISTINCT query_id, substr(seq, p + 1, 16) AS kmer FROM (SELECT query_id, seq, unnest(range(0, length(seq) - 15, 25)) AS p FROM q2)),
rec AS (SELECT * FROM reads WHERE length(seq) >= 100), {sql_kmers(16, 'rec')},
hits AS (SELECT DISTINCT query_id, read_id, kmer FROM kmers JOIN seeds USING (kmer)),
df AS (SELECT query_id, kmer, count(*) AS df FROM hits GROUP BY ALL),
st AS (SELECT (SELECT count(*) FROM rec) AS n_all, (SELECT avg(length(seq)) FROM reads) AS mean_len),
sc AS (SELECT h.query_id, h.read_id AS rec_id, bin || ':' || library AS header, count(*) AS seeds,
  round(sum(ln(greatest(n_all, 2) / (1.0 + df))) / (0.25 + 0.75 * any_value(length(seq)) / any_value(mean_len)), 9) AS score
  FROM hits h JOIN df USING (query_id, kmer) JOIN rec USING (read_id) CROSS JOIN st GROUP BY h.query_id, h.read_id, bin, library)"""


@query("seed_shortlist_topk", "JOIN-16 WIN-04 SRC-14",
       f"""WITH {READS}, {REFS}, {SHORT_SQL} SELECT query_id, rec_id, header, seeds, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, header, rec_id) AS rank FROM sc) WHERE rank <= 20""")
def seed_shortlist_topk(spark, sf):
    return A.shortlist(_queries(spark, sf), _records(spark, sf), top=20).withColumn("score", F.round("score", 6))


@query("seed_shortlist_guaranteed", "JOIN-16",
       f"""WITH {READS}, {REFS}, {SHORT_SQL}, pl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, header, rec_id) AS rank
  FROM sc WHERE header NOT LIKE 'src1:%') WHERE rank <= 5)
SELECT query_id, rec_id, seeds, rank, 'seed' AS source FROM pl UNION ALL
SELECT g.query_id, g.rec_id, g.seeds, 1 + (SELECT count(*) FROM sc o WHERE o.header NOT LIKE 'src1:%' AND o.query_id = g.query_id AND o.score > g.score) AS rank,
  CASE WHEN 1 + (SELECT count(*) FROM sc o WHERE o.header NOT LIKE 'src1:%' AND o.query_id = g.query_id AND o.score > g.score) <= 5 THEN 'seed' ELSE 'guaranteed' END
FROM sc g WHERE header LIKE 'src1:%'""")
def seed_shortlist_guaranteed(spark, sf):
    s = A.shortlist(_queries(spark, sf), _records(spark, sf), top=5, guaranteed=F.col("header").startswith("src1:"))
    return s.select("query_id", "rec_id", "seeds", "rank", "source")


@query("infix_alignment", "ALN-01 ALN-15")
def infix_alignment(spark, sf):
    q, r = _queries(spark, sf), _records(spark, sf)
    return A.align_shortlist(A.shortlist(q, r), q, r)


@query("infix_words", "ALN-01",
       """WITH p AS (SELECT p_partkey AS k, upper(replace(p_name, ' ', '')) AS t, upper(split_part(p_name, ' ', -1)) AS w FROM part),
j AS (SELECT a.k, a.w AS q, b.t FROM p a JOIN p b ON b.k = a.k + 1),
s AS (SELECT k, any_value(length(q)) AS n, min(levenshtein(replace(q, 'N', '#'), substr(t, i, l))) AS d FROM (
  SELECT k, q, t, i, unnest(range(0, length(t) - i + 2)) AS l FROM (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM j)) GROUP BY k)
SELECT k, d::INTEGER AS edits, round(100.0 * (1.0 - d / n), 6) AS identity FROM s""")
def infix_words(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.upper(F.regexp_replace("p_name", " ", "")).alias("t"), F.upper(F.element_at(F.split("p_name", " "), -1)).alias("q"))
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("t").alias("next"))
    j = p.join(nxt, "p_partkey")
    return j.select(F.col("p_partkey").alias("k"), A.infix_distance_udf("q", "next").alias("edits"), F.round(A.infix_identity("q", "next"), 6).alias("identity"))


@query("discriminating_window", "ALN-02")
def discriminating_window(spark, sf):
    q, r = _queries(spark, sf), _records(spark, sf)
    best = A.align_shortlist(A.shortlist(q, r), q, r, keep=8)
    return A.discriminating_window(best, q, r)


@query("reference_containment", "ALN-06",
       f"""WITH {READS}, {REFS}, {sql_kmers(21)}, a AS (SELECT DISTINCT ref_id AS a, substr(seq, p + 1, 21) AS kmer FROM (
  SELECT ref_id, seq, unnest(range(0, length(seq) - 20)) AS p FROM refs)), b AS (SELECT DISTINCT read_id AS b, kmer FROM kmers),
na AS (SELECT a, count(*) AS na FROM a GROUP BY 1), nb AS (SELECT b, count(*) AS nb FROM b GROUP BY 1)
SELECT a, b, count(*) AS shared, round(count(*) / least(any_value(na), any_value(nb)), 6) AS containment FROM a JOIN b USING (kmer)
JOIN na USING (a) JOIN nb USING (b) GROUP BY ALL HAVING count(*) / least(any_value(na), any_value(nb)) >= 0.3""")
def reference_containment(spark, sf):
    a = K.packed_sets(references(spark, sf).withColumnRenamed("ref_id", "a"), 21, "a").withColumnRenamed("n", "na")
    b = K.packed_sets(reads(spark, sf).select(F.col("read_id").alias("b"), "seq"), 21, "b").withColumnRenamed("n", "nb")
    return K.containment(a, b, 0.3).select("a", "b", "shared", F.round("containment", 6).alias("containment"))


def _sample(spark, sf):
    r = reads(spark, sf).where(F.length("seq") >= 400).select("bin", "read_id", "seq")
    return R.hash_sample(r, ["bin"], "read_id", 12, seed=3)


SAMPLE_SQL = """smp AS (SELECT bin, read_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5('3:' || read_id), read_id) AS rn
  FROM reads WHERE length(seq) >= 400) WHERE rn <= 12),
both_s AS (SELECT bin, read_id, '+' AS sd, seq FROM smp UNION ALL SELECT bin, read_id, '-', """ + sql_rc("seq") + """ FROM smp)"""
JACC_SQL = f"""{SAMPLE_SQL}, {sql_kmers(15, 'both_s', 'bin, read_id, sd')}, dk AS (SELECT DISTINCT bin, read_id, sd, kmer FROM kmers),
sz AS (SELECT bin, read_id, count(*) AS n FROM dk WHERE sd = '+' GROUP BY ALL),
sh AS (SELECT x.bin, x.read_id AS a, y.read_id AS b, y.sd, count(*) AS c FROM dk x JOIN dk y ON x.bin = y.bin AND x.kmer = y.kmer
  WHERE x.sd = '+' AND x.read_id <> y.read_id GROUP BY ALL),
jac AS (SELECT sh.bin, a, b, max(c / (na.n + nb.n - c)) AS jaccard FROM sh JOIN sz na ON na.bin = sh.bin AND na.read_id = a
  JOIN sz nb ON nb.bin = sh.bin AND nb.read_id = b GROUP BY ALL)"""


@query("kmer_jaccard", "ALN-05", f"WITH {READS}, {JACC_SQL} SELECT bin, a, b, round(jaccard, 8) AS jaccard FROM jac")
def kmer_jaccard(spark, sf):
    return A.sample_similarity(_sample(spark, sf)).withColumn("jaccard", F.round("jaccard", 8))


@query("medoid", "WIN-12",
       f"""WITH {READS}, {JACC_SQL}, md AS (SELECT bin, quantile_cont(length(seq), 0.5) AS med, count(*) - 1 AS others FROM smp GROUP BY 1),
tt AS (SELECT bin, a AS read_id, sum(jaccard) AS total FROM jac GROUP BY ALL),
c AS (SELECT smp.bin, smp.read_id, CASE WHEN others > 0 THEN round(coalesce(total, 0) / others, 9) ELSE 0 END AS mean
  FROM smp JOIN md USING (bin) LEFT JOIN tt ON tt.bin = smp.bin AND tt.read_id = smp.read_id WHERE length(seq) >= 0.9 * med)
SELECT bin, read_id AS medoid, round(mean, 7) AS mean_similarity FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY mean DESC, read_id) AS rn FROM c) WHERE rn = 1""")
def medoid(spark, sf):
    s = _sample(spark, sf)
    return A.medoid(s, A.sample_similarity(s)).withColumn("mean_similarity", F.round("mean_similarity", 7))


@query("discriminating_kmers", "AGG-11",
       f"""WITH {READS}, {sql_kmers(21, key='library, read_id')}, rk AS (SELECT DISTINCT library, read_id, kmer FROM kmers),
own AS (SELECT kmer, min(library) AS grp FROM rk GROUP BY 1 HAVING count(DISTINCT library) = 1),
ng AS (SELECT grp, count(*) AS ng FROM own GROUP BY 1), nr AS (SELECT read_id, count(*) AS nr FROM rk GROUP BY 1),
c AS (SELECT read_id, grp, count(*) AS c FROM rk JOIN own USING (kmer) GROUP BY ALL),
s AS (SELECT read_id, grp, c / least(ng, nr) AS share FROM c JOIN ng USING (grp) JOIN nr USING (read_id))
SELECT read_id, grp, round(share, 8) AS share FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY share DESC, grp) AS rn FROM s WHERE share >= 0.3) WHERE rn = 1""")
def discriminating_kmers(spark, sf):
    return K.assign_by_markers(reads(spark, sf), 21, "library").withColumn("share", F.round("share", 8))


@query("consensus_read_support", "AGG-14 SRC-18",
       f"""WITH {READS}, {SAMPLE_SQL}, cand AS (SELECT bin, library AS "set", arg_max(seq, length(seq) * 10000000::BIGINT - read_id) AS seq FROM reads GROUP BY ALL),
{sql_kmers(21, 'both_s', 'bin')}, ck AS (SELECT DISTINCT bin, "set", substr(s, i + 1, 21) AS kmer FROM (SELECT *, unnest(range(0, 256)) AS i FROM (
  SELECT bin, "set", length(seq) AS n, c, substr(seq, c * 256 + 1, 277) AS s FROM (SELECT *, unnest(range(0, length(seq) // 256 + 1)) AS c FROM cand)))
  WHERE c * 256 + i + 21 <= n), seen AS (SELECT DISTINCT bin, kmer FROM kmers),
sup AS (SELECT ck.bin, "set", count(*) AS total, count(seen.kmer) AS found FROM ck LEFT JOIN seen ON seen.bin = ck.bin AND seen.kmer = ck.kmer GROUP BY ALL)
SELECT bin, "set", found, total, round(100.0 * found / total, 6) AS support FROM sup""")
def consensus_read_support(spark, sf):
    r = reads(spark, sf)
    cand = r.groupBy("bin", F.col("library").alias("set")).agg(F.max(F.struct(
        F.length("seq").alias("n"), (-F.col("read_id")).alias("neg"), F.col("seq"))).alias("m")).select("bin", "set", "m.seq")
    s = K.read_support(cand, _sample(spark, sf)).where("total > 0")
    return s.select("bin", "set", "found", "total", F.round("support", 6).alias("support"))


@query("strict_vs_code_identity", "ALN-07",
       f"""WITH {WORDS_SQL}, {IUPAC_SQL}, pos AS (SELECT oligo, unnest(range(1, length(oligo) + 1)) AS i FROM words)
SELECT oligo, round(100.0 * count(*) FILTER (substr(oligo, i, 1) = substr(reverse(oligo), i, 1)) / count(*), 6) AS strict,
  round(100.0 * count(*) FILTER (a.code <> 'N' AND b.code <> 'N' AND length(translate(a.bases, b.bases, '')) < length(a.bases)) / count(*), 6) AS overlapping
FROM pos JOIN codes a ON a.code = substr(oligo, i, 1) JOIN codes b ON b.code = substr(reverse(oligo), i, 1) GROUP BY 1""")
def strict_vs_code_identity(spark, sf):
    w = _ambiguous_words(spark, sf)
    n = F.length("oligo")
    strict = F.size(F.filter(F.zip_with(F.split("oligo", ""), F.split(F.reverse("oligo"), ""), lambda a, b: a == b), lambda x: x))
    # N on either side counts as no match, so both sides use the template masks
    bad = S.mismatch_positions(S.template_mask("oligo"), S.template_mask(F.reverse("oligo")), n)
    return w.select("oligo", F.round(100.0 * strict / n, 6).alias("strict"), F.round(100.0 * (n - F.size(bad)) / n, 6).alias("overlapping"))


@query("substitution_indel_rates", "ALN-08",
       f"""WITH {CIGAR}, o AS (SELECT rid, l_orderkey, l_linenumber, regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 1) AS ln,
  regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 2) AS op FROM cig),
x AS (SELECT rid, l_orderkey, l_linenumber, unnest(ln)::BIGINT AS n, unnest(op) AS op FROM o),
r AS (SELECT rid, l_orderkey, l_linenumber, sum(n) FILTER (op = 'X') / sum(n) FILTER (op IN ('=', 'X', 'M')) AS sub, sum(n) FILTER (op IN ('I', 'D')) / sum(n) FILTER (op IN ('=', 'X', 'M')) AS indel
  FROM x GROUP BY ALL)
SELECT l_orderkey, round(min(sub), 8) AS sub, round(arg_min(indel, sub * 1000 + indel / 1000), 8) AS indel FROM r GROUP BY 1""")
def substitution_indel_rates(spark, sf):
    def n(letters):
        return F.aggregate("ops", F.lit(0), lambda a, o: a + F.when(o["op"].isin(*letters), o["len"]).otherwise(0))

    c = _cigars(spark, sf).withColumn("ops", S.cigar_ops("cigar"))
    aligned = n("M=X")
    r = c.select("l_orderkey", (n("X") / aligned).alias("sub"), (n("ID") / aligned).alias("indel"))
    m = r.groupBy("l_orderkey").agg(F.min_by(F.struct("sub", "indel"), F.col("sub") * 1000 + F.col("indel") / 1000).alias("m"))
    return m.select("l_orderkey", F.round("m.sub", 8).alias("sub"), F.round("m.indel", 8).alias("indel"))


@query("best_record_per_read", "ALN-09 ALN-16 SRC-11",
       """SELECT l_orderkey % 5 AS grp, l_orderkey, title, identity, aligned FROM (SELECT l_orderkey, l_suppkey::VARCHAR AS title, round(1 - l_discount, 4) AS identity, l_quantity * 10 AS aligned,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY round(1 - l_discount, 4) DESC, l_quantity DESC, l_suppkey::VARCHAR) AS rn FROM lineitem WHERE l_quantity * 10 >= 250) WHERE rn = 1""")
def best_record_per_read(spark, sf):
    h = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 5).alias("grp"), "l_orderkey", F.col("l_suppkey").cast("string").alias("title"),
                                            F.round(1 - F.col("l_discount"), 4).alias("identity"), (F.col("l_quantity") * 10).alias("aligned"))
    return A.best_record(h, ["grp", "l_orderkey"])


@query("locus_window", "ALN-10",
       f"""{BASE}, {PRODUCTS}, {BEST}, sp AS (SELECT read_id, min(l_start) AS s, max("end") AS e FROM best GROUP BY 1)
SELECT read_id, md5(CASE WHEN s IS NULL THEN seq ELSE substr(seq, greatest(s - 60, 0) + 1, e + 60 - greatest(s - 60, 0)) END) AS window_md5, s IS NULL AS whole
FROM reads LEFT JOIN sp USING (read_id)""")
def locus_window(spark, sf):
    spans = _best(spark, sf).groupBy("read_id").agg(F.min("l_start").alias("span_start"), F.max("end").alias("span_end"))
    w = A.locus_window(reads(spark, sf).select("read_id", "seq"), spans)
    return w.select("read_id", F.md5("window").alias("window_md5"), "whole")


@query("read_leak_share", "ALN-11",
       """SELECT l_suppkey, count(*) FILTER (l_tax > l_discount) AS leaked, count(*) AS n, round(count(*) FILTER (l_tax > l_discount) / count(*), 8) AS share
FROM lineitem GROUP BY 1""")
def read_leak_share(spark, sf):
    return A.leak_share(table(spark, sf, "lineitem"), "l_suppkey", "l_discount", "l_tax").withColumn("share", F.round("share", 8))


@query("bin_identity_calls", "ALN-12 AGG-03",
       """WITH m AS (SELECT l_orderkey, l_suppkey, max(l_quantity) AS s FROM lineitem GROUP BY ALL),
b AS (SELECT l_orderkey, max(s) AS best FROM m GROUP BY 1), c AS (SELECT l_orderkey, CASE WHEN count(*) = 1 THEN min(l_suppkey)::VARCHAR ELSE 'unknown' END AS call
  FROM m JOIN b USING (l_orderkey) WHERE s = best GROUP BY 1),
g AS (SELECT o_custkey, call, count(*) AS n FROM c JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, call) AS rn FROM g)
SELECT o_custkey, call AS dominant, n, round(n / total, 8) AS share FROM t WHERE rn = 1""")
def bin_identity_calls(spark, sf):
    from ..operators.identity import dominant_category
    c = A.unique_best(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", "l_quantity")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    d = dominant_category(c.join(o, "l_orderkey"), ["o_custkey"], "call")
    return d.select("o_custkey", F.col("category").alias("dominant"), "n", F.round("share", 8).alias("share"))


@query("orientation_calls", "ALN-14 AUD-09",
       f"""{BASE}, v AS (SELECT read_id, count(*) FILTER (strand = '+') AS f1, count(*) FILTER (strand = '-') AS r1 FROM sites GROUP BY 1),
m AS (SELECT read_id, length(seq) AS n, len(regexp_extract_all(seq, 'ACGTA')) AS f2, len(regexp_extract_all(seq, 'TACGT')) AS r2 FROM reads),
s AS (SELECT read_id, f1, r1, f2, r2, CASE WHEN n < 200 THEN NULL WHEN f1 > r1 THEN 'forward' WHEN r1 > f1 THEN 'reverse' END AS a, CASE WHEN n < 200 THEN NULL WHEN f2 > r2 THEN 'forward' WHEN r2 > f2 THEN 'reverse' END AS b
  FROM (SELECT read_id, n, coalesce(f1, 0) AS f1, coalesce(r1, 0) AS r1, f2, r2 FROM m LEFT JOIN v USING (read_id)))
SELECT read_id, CASE WHEN a = b THEN a WHEN a IS NOT NULL AND b IS NOT NULL THEN 'undecided' ELSE coalesce(a, b, 'undecided') END AS orientation,
  CASE WHEN a = b THEN 'agree' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'diverge' WHEN a IS NOT NULL OR b IS NOT NULL THEN 'single' ELSE 'none' END AS basis FROM s""")
def orientation_calls(spark, sf):
    v = _sites(spark, sf).groupBy("read_id").agg(F.count(F.when(F.col("strand") == "+", 1)).alias("f1"),
                                                 F.count(F.when(F.col("strand") == "-", 1)).alias("r1"))
    m = reads(spark, sf).select("read_id", F.length("seq").alias("length"), F.regexp_count("seq", F.lit("ACGTA")).alias("f2"), F.regexp_count("seq", F.lit("TACGT")).alias("r2"))
    return A.orientation_call(m.join(v, "read_id", "left").na.fill(0, ["f1", "r1"])).select("read_id", "orientation", "basis")


@query("offset_similarity", "ALN-18",
       f"""WITH {REFS}, p AS (SELECT a.ref_id AS id, a.seq AS x, b.seq AS y FROM refs a JOIN refs b ON b.ref_id = a.ref_id + 1),
o AS (SELECT *, unnest(range(-(length(y) // 2), length(x) // 2 + 1, 5)) AS off FROM p),
c AS (SELECT id, off, unnest(range(greatest(off, 0), least(length(x), length(y) + off))) AS i, x, y FROM o),
s AS (SELECT id, off, round(count(*) FILTER (substr(x, i + 1, 1) = substr(y, i - off + 1, 1)) / count(*), 9) AS identity FROM c GROUP BY ALL)
SELECT id, off AS "offset", identity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY identity DESC, off) AS rn FROM s) WHERE rn = 1""")
def offset_similarity(spark, sf):
    r = references(spark, sf)
    nxt = r.select((F.col("ref_id") - 1).alias("ref_id"), F.col("seq").alias("y"))
    return A.offset_similarity(r.join(nxt, "ref_id").select(F.col("ref_id").alias("id"), F.col("seq").alias("x"), "y"))


@query("identity_matrix", "AGG-19")
def identity_matrix(spark, sf):
    r = references(spark, sf).select(F.col("ref_id").alias("id"), (F.col("ref_id") % 10).alias("class"), "seq")
    return A.identity_matrix(r, "class")


OVERHANG_SQL = f"""ol AS (SELECT pair AS oligo_id, fwd AS oligo FROM panel),
ori AS (SELECT read_id, '+' AS orient, seq FROM reads UNION ALL SELECT read_id, '-', {sql_rc('seq')} FROM reads),
opiece AS (SELECT read_id, orient, length(seq) AS n, c, substr('NNNNNNNNNNNNNNNNNNNN' || seq, c * 256 + 1, 300) AS s FROM (
  SELECT *, unnest(range(0, length(seq) // 256 + 1)) AS c FROM ori)),
opos AS (SELECT read_id, orient, n, s, i, c * 256 + i AS e FROM (SELECT *, unnest(range(0, 256)) AS i FROM opiece) WHERE c * 256 + i < n AND c * 256 + i >= 1),
ocand AS (SELECT read_id, orient, oligo_id, e, substr(s, i + 2, 20) AS win, oligo, e - 19 AS start FROM opos JOIN ol ON substr(s, i + 20, 2) = right(oligo, 2)
  WHERE hamming(substr(s, i + 17, 5), right(oligo, 5)) <= 1),
obind AS (SELECT read_id, oligo_id, orient, e AS end3, hamming(win, oligo) - greatest(-start, 0) AS mm, start FROM ocand WHERE e + 1 >= 12)"""


@query("overhang_bindings", "JOIN-10 FLT-05",
       f"""WITH {READS}, {REFS}, {PANEL}, {OVERHANG_SQL} SELECT read_id, oligo_id, orient, end3, mm FROM obind WHERE mm <= 3""")
def overhang_bindings(spark, sf):
    o = panel(spark, sf).select(F.col("pair").alias("oligo_id"), F.col("fwd").alias("oligo"))
    return sites.oligo_bindings(reads(spark, sf), o, shortest=20, longest=20)


@query("tolerant_sites", "JOIN-23 FLT-05 FLT-06",
       f"""WITH {READS}, {REFS}, {PANEL}, {OVERHANG_SQL} SELECT read_id, oligo_id, orient, count(*) AS n_sites, min(mm) AS best_mm FROM obind WHERE mm <= 3 AND start >= 0 GROUP BY ALL""")
def tolerant_sites(spark, sf):
    p = panel(spark, sf).select("pair", "fwd", F.col("fwd").alias("rev"))
    pats = sites.patterns(p).where("strand = '+'")
    s = sites.scan_sites(reads(spark, sf), pats, 3, 2, keep_positions=True).where(sites.end_rule("from_3prime"))
    return s.groupBy("read_id", F.col("pair").alias("oligo_id"), F.when(F.col("side") == "L", "+").otherwise("-").alias("orient")).agg(
        F.count(F.lit(1)).alias("n_sites"), F.min("mm").cast("long").alias("best_mm"))
