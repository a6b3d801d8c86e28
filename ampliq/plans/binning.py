"""Binning, consensus and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import binning as B
from ..operators import consensus as C
from ..operators import graph as G
from ..operators import ranking as R
from ..operators import splitting as SP
from ..session import cut_lineage
from .binding import READS, reads, sql_kmers, table
from .registry import query

HITS = """hits AS (SELECT l_orderkey AS q, 50 AS qlen, l_linenumber AS qs, l_linenumber + l_quantity::INTEGER AS qe, l_suppkey % 10 AS t,
  (30 + l_partkey % 25)::INTEGER AS tlen, 0 AS ts, l_quantity::INTEGER AS te, round(1.0 - l_discount / 2, 4) AS identity FROM lineitem)"""


def hits(spark, sf):
    li = table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("int")
    return li.select(F.col("l_orderkey").alias("q"), F.lit(50).alias("qlen"), F.col("l_linenumber").alias("qs"),
                     (F.col("l_linenumber") + q).alias("qe"), (F.col("l_suppkey") % 10).alias("t"),
                     (F.col("l_partkey") % 25 + 30).cast("int").alias("tlen"), F.lit(0).alias("ts"), q.alias("te"),
                     F.round(1.0 - F.col("l_discount") / 2, 4).alias("identity"))


@query("tiered_assignment", "JOIN-13",
       f"""WITH {HITS}, b AS (SELECT q, t, max(identity) AS identity FROM hits WHERE (qe - qs) / qlen >= 0.85 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY identity DESC, t) AS rn,
  lead(identity, 1, 0.0) OVER (PARTITION BY q ORDER BY identity DESC, t) AS second FROM b)
SELECT q, t, identity FROM r WHERE rn = 1 AND (identity >= 0.97 OR (identity >= 0.95 AND identity - second >= 0.02))""")
def tiered_assignment(spark, sf):
    return B.tiered_assignment(hits(spark, sf))


@query("simple_assignment", "JOIN-14",
       f"""WITH {HITS} SELECT q, t, identity FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY identity DESC, t) AS rn FROM hits
  WHERE (qe - qs) / qlen >= 0.80 AND identity >= 0.90) WHERE rn = 1""")
def simple_assignment(spark, sf):
    return B.simple_assignment(hits(spark, sf))


@query("overlap_pairs", "JOIN-15 SRC-10",
       f"""WITH {HITS} SELECT q, t, identity FROM hits WHERE q <> t AND least(qe - qs, te - ts) / least(qlen, tlen) >= 0.85
  AND identity >= 0.97""")
def overlap_pairs(spark, sf):
    return B.overlap_pairs(hits(spark, sf), 0.97, 0.85)


@query("concatemer_segments", "WIN-14",
       f"""WITH RECURSIVE {HITS}, c AS (SELECT q, qs, qe, t, identity, row_number() OVER (PARTITION BY q ORDER BY (qe - qs) * identity DESC, qs, qe, t) AS rn
  FROM hits WHERE identity >= 0.95 AND te - ts >= 0.8 * tlen AND qe - qs <= 1.25 * tlen),
f(q, rn, s, e, taken) AS (SELECT q, 0::BIGINT, []::INTEGER[], []::INTEGER[], NULL::BOOLEAN FROM (SELECT DISTINCT q FROM c) UNION ALL
  SELECT q, rn + 1, CASE WHEN free THEN list_append(s, qs) ELSE s END, CASE WHEN free THEN list_append(e, qe) ELSE e END, free FROM (
    SELECT f.*, c.qs, c.qe, len(list_filter(range(1, len(f.s) + 1), lambda i: NOT (c.qe <= f.s[i] OR c.qs >= f.e[i]))) = 0 AS free
    FROM f JOIN c ON c.q = f.q AND c.rn = f.rn + 1))
SELECT c.q, qs, qe, t, identity FROM f JOIN c ON c.q = f.q AND c.rn = f.rn WHERE taken""")
def concatemer_segments(spark, sf):
    return B.segments(hits(spark, sf), 0.95)


@query("satellite_parent", "GRF-04",
       f"""WITH {HITS}, x AS (SELECT q % 40 AS bin, q, t, identity FROM hits WHERE identity >= 0.97 AND te - ts >= 0.8 * tlen),
b AS (SELECT bin, q, t FROM (SELECT *, row_number() OVER (PARTITION BY bin, q ORDER BY identity DESC, t) AS rn FROM x) WHERE rn = 1),
n AS (SELECT q % 40 AS bin, count(DISTINCT q) AS sampled FROM hits GROUP BY 1),
c AS (SELECT bin, t AS parent, count(*) AS hits FROM b GROUP BY ALL),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY hits DESC, parent) AS rn FROM c) WHERE rn = 1)
SELECT bin, parent, hits, sampled FROM p JOIN n USING (bin) WHERE hits >= 0.08 * sampled""")
def satellite_parent(spark, sf):
    h = hits(spark, sf).withColumn("bin", F.col("q") % 40)
    n = h.groupBy("bin").agg(F.countDistinct("q").alias("sampled"))
    return B.satellite_parent(h, n, share=0.08)


#: Reads of a bin of a barcode against the centres of other bins.
BIN_HITS = """bh AS (SELECT barcode, bin, q, centre, max(identity) AS identity FROM (SELECT (['de', 'en', 'es', 'fr'])[q % 4 + 1] AS barcode, 'src' || (q // 4 % 20) AS bin, q,
  'src' || ((t + 10 * (q % 2)) % 20) AS centre, identity FROM hits WHERE identity >= 0.97 AND te - ts >= 0.8 * tlen) GROUP BY ALL),
bn AS (SELECT (['de', 'en', 'es', 'fr'])[q % 4 + 1] AS barcode, 'src' || (q // 4 % 20) AS bin, count(DISTINCT q) AS sampled FROM hits GROUP BY ALL)"""


def bin_hits(spark, sf):
    """(hits, sampled) as ``B.select_bins`` takes them."""
    bar = F.element_at(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), (F.col("q") % 4 + 1).cast("int"))
    h = hits(spark, sf).select(bar.alias("barcode"), F.concat(F.lit("src"), F.floor(F.col("q") / 4) % 20).alias("bin"), "q", F.concat(F.lit("src"), (F.col("t") + 10 * (F.col("q") % 2)) % 20).alias("centre"),
                               "identity", "te", "ts", "tlen")
    good = h.where((F.col("identity") >= 0.97) & (F.col("te") - F.col("ts") >= 0.8 * F.col("tlen")))
    return (good.groupBy("barcode", "bin", "q", "centre").agg(F.max("identity").alias("identity")),
            h.groupBy("barcode", "bin").agg(F.countDistinct("q").alias("sampled")))


@query("bin_selection", "WIN-07 GRF-04",
       f"""WITH RECURSIVE {READS}, {HITS}, {BIN_HITS}, b AS (SELECT library AS barcode, bin, CASE WHEN length(bin) > 4 THEN 'long' ELSE 'full' END AS "window", count(*) AS reads FROM reads GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY barcode, "window" ORDER BY reads DESC, bin) AS pos, row_number() OVER (PARTITION BY barcode ORDER BY reads DESC, bin) AS place FROM b),
w AS (SELECT *, reads >= 10 OR pos <= 3 AS wanted FROM r),
hl AS (SELECT barcode, bin, list(c) AS per_read FROM (SELECT barcode, bin, q, list({{'i': -identity, 'c': centre}} ORDER BY identity DESC, centre) AS c FROM bh GROUP BY ALL) GROUP BY ALL),
s AS (SELECT barcode, 0::BIGINT AS place, []::VARCHAR[] AS chosen, NULL::VARCHAR AS bin, false AS satellite, 0::BIGINT AS before FROM (SELECT DISTINCT barcode FROM w)
  UNION ALL
  SELECT barcode, place, CASE WHEN wanted AND NOT satellite AND len(chosen) < 8 THEN list_append(chosen, bin) ELSE chosen END, bin, satellite, len(chosen) FROM (
    SELECT s.barcode, w.place, s.chosen, w.bin, w.wanted, coalesce(list_max(map_values(histogram_of)), 0) >= 0.10 * bn.sampled AND w.wanted IS TRUE AS satellite FROM (
      SELECT s.*, CASE WHEN hl.per_read IS NULL THEN MAP {{}} ELSE list_histogram([list_filter(x, lambda y: list_contains(s.chosen, y.c))[1].c for x in hl.per_read]) END AS histogram_of
      FROM s LEFT JOIN w ON w.barcode = s.barcode AND w.place = s.place + 1 LEFT JOIN hl ON hl.barcode = w.barcode AND hl.bin = w.bin) s
    JOIN w ON w.barcode = s.barcode AND w.place = s.place + 1 LEFT JOIN bn ON bn.barcode = w.barcode AND bn.bin = w.bin))
SELECT barcode, w.bin, reads, pos, CASE WHEN before >= 8 THEN 'ceiling' WHEN coalesce(satellite, false) THEN 'satellite' WHEN reads >= 10 THEN 'reads'
  WHEN pos <= 3 THEN 'top_of_window' ELSE 'too_few' END AS reason FROM w JOIN s USING (barcode, place)""")
def bin_selection(spark, sf):
    b = reads(spark, sf).groupBy(F.col("library").alias("barcode"), "bin").agg(F.count(F.lit(1)).alias("reads"))
    b = b.withColumn("window", F.when(F.length("bin") > 4, "long").otherwise("full"))
    return B.select_bins(b, *bin_hits(spark, sf), 10, 3, 8, share=0.10).select("barcode", "bin", "reads", "pos", "reason")


#: Suppliers of a nation as members of a group; a part number serves a supplier that sold 48 or more of it at once.
SUPPORTS = """mem AS (SELECT s_nationkey AS grp, s_suppkey AS member FROM supplier),
sup AS (SELECT DISTINCT s_nationkey AS grp, l_partkey % 60 AS pair, l_suppkey AS member FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 48)"""


@query("split_groups", "GRF-07",
       f"""WITH RECURSIVE {SUPPORTS}, o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY member) AS no FROM mem),
l AS (SELECT grp, list(lacks ORDER BY pair) AS lacking FROM (SELECT p.grp, pair, list(o.no ORDER BY o.no) FILTER (s.grp IS NULL) AS lacks FROM (SELECT DISTINCT grp, pair FROM sup) p
  JOIN o USING (grp) LEFT JOIN (SELECT sup.grp, pair, no FROM sup JOIN o USING (grp, member)) s USING (grp, pair, no) GROUP BY ALL) GROUP BY 1),
z AS (SELECT grp, 0 AS step, 1 AS set_no, list(no ORDER BY no) AS cur, []::BIGINT[] AS gone, NULL::VARCHAR AS verdict, []::BIGINT[] AS placed, 0::BIGINT AS pairs, false AS ended FROM o GROUP BY 1
  UNION ALL
  SELECT grp, step + 1, CASE WHEN v = 'set' THEN set_no + 1 ELSE set_no END, CASE v WHEN 'set' THEN gone WHEN 'on' THEN list_filter(cur, lambda x: x <> worst) ELSE [] END,
    CASE v WHEN 'on' THEN list_append(gone, worst) ELSE [] END, v, CASE v WHEN 'set' THEN cur WHEN 'rest' THEN cur || gone ELSE [] END, CASE WHEN v = 'set' THEN ok ELSE 0 END, v = 'rest' OR v = 'set' AND len(gone) = 0 FROM (
    SELECT *, CASE WHEN len(cur) < 2 THEN 'rest' WHEN ok > 0 THEN 'set' WHEN worst IS NULL THEN 'rest' ELSE 'on' END AS v FROM (
      SELECT *, len(list_filter(blamed, lambda x: x IS NULL)) AS ok,
        list_sort([{{'k': -len(list_filter(blamed, lambda y: y = x)), 'no': x}} for x in list_distinct(blamed)])[1].no AS worst FROM (
        SELECT z.*, [list_filter(coalesce(x, []), lambda y: list_contains(cur, y))[1] for x in coalesce(lacking, [])] AS blamed FROM z LEFT JOIN l USING (grp) WHERE NOT ended))))
SELECT z.grp, o.member, CASE WHEN verdict = 'set' THEN set_no - 1 END AS set_no, pairs FROM (SELECT *, unnest(placed) AS no FROM z) z JOIN o USING (grp, no)""")
def split_groups(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("member"))
    li = table(spark, sf, "lineitem").where("l_quantity >= 48").select(F.col("l_suppkey").alias("member"), (F.col("l_partkey") % 60).alias("pair"))
    return SP.split_groups(s, li.join(s, "member").select("grp", "pair", "member").distinct())


@query("length_histogram", "AGG-08 AGG-25 OPT-07",
       f"""WITH {READS} SELECT bin, (length(seq) // 100)::INTEGER AS bucket, count(*) AS n, max(length(seq)) AS longest FROM reads
  WHERE length(seq) >= 300 GROUP BY ALL""")
def length_histogram(spark, sf):
    r = reads(spark, sf).select("bin", F.length("seq").alias("len")).where("len >= 300")
    return r.groupBy("bin", F.floor(F.col("len") / 100).cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.max("len").cast("long").alias("longest"))


@query("length_peaks", "AGG-08",
       f"""WITH RECURSIVE {READS}, l AS (SELECT library, length(seq) AS len FROM reads),
b AS (SELECT *, floor(peak * 0.85)::INTEGER AS low, floor(peak * 1.15)::INTEGER AS high FROM (SELECT library, len // 100 AS bucket, len // 100 * 100 + 50 AS peak,
  count(*) AS bn FROM l WHERE len >= 300 GROUP BY ALL)),
s AS (SELECT b.*, (SELECT count(*) FROM l WHERE l.library = b.library AND len BETWEEN low AND high)::DOUBLE /
  (SELECT count(*) FROM l WHERE l.library = b.library) AS share FROM b),
c AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY bn DESC, bucket) AS rn FROM s),
f(library, rn, lo, hi, taken) AS (SELECT DISTINCT library, 0::BIGINT, []::INTEGER[], []::INTEGER[], false FROM c UNION ALL
  SELECT library, rn, CASE WHEN ok THEN list_append(lo, low) ELSE lo END, CASE WHEN ok THEN list_append(hi, high) ELSE hi END, ok FROM (
    SELECT c.library, c.rn, f.lo, f.hi, c.low, c.high, len(f.lo) < 4 AND c.share >= 0.03
      AND len(list_filter(range(1, len(f.lo) + 1), lambda i: NOT (c.high < f.lo[i] OR c.low > f.hi[i]))) = 0 AS ok
    FROM f JOIN c ON c.library = f.library AND c.rn = f.rn + 1))
SELECT c.library, c.low, c.high, c.peak, round(100.0 * c.share, 6) AS share_pct FROM f JOIN c ON c.library = f.library AND c.rn = f.rn WHERE taken""")
def length_peaks(spark, sf):
    r = reads(spark, sf).select("library", F.length("seq").alias("len"))
    return B.length_peaks(r, ["library"]).withColumn("share_pct", F.round("share_pct", 6))


@query("centre_pick", "WIN-11",
       f"""WITH {READS}, s AS (SELECT bin, read_id, length(seq) AS len, row_number() OVER (PARTITION BY bin ORDER BY length(seq), read_id) AS rn,
  count(*) OVER (PARTITION BY bin) AS n FROM reads),
m AS (SELECT bin, len AS median FROM s WHERE rn = n // 2 + 1),
d AS (SELECT bin, read_id, abs(len - median) AS distance, row_number() OVER (PARTITION BY bin ORDER BY abs(len - median), read_id) AS k FROM s JOIN m USING (bin))
SELECT bin, read_id AS centre, distance FROM d WHERE k = 1""")
def centre_pick(spark, sf):
    r = reads(spark, sf).select("bin", "read_id", F.length("seq").alias("len"))
    return B.centre_pick(r, "bin", "read_id", "len")


@query("length_window", "MTH-07",
       f"""WITH {READS}, s AS (SELECT bin, length(seq) AS len, row_number() OVER (PARTITION BY bin ORDER BY length(seq)) AS rn,
  count(*) OVER (PARTITION BY bin) AS n FROM reads)
SELECT bin, max(len) FILTER (rn = least(floor(n * 0.1) + 1, n)) AS p10, max(len) FILTER (rn = least(floor(n * 0.9) + 1, n)) AS p90 FROM s GROUP BY 1""")
def length_window(spark, sf):
    r = reads(spark, sf).select("bin", F.length("seq").alias("len"))
    p10 = R.nth_value(r, ["bin"], "len", 0.1).withColumnRenamed("value", "p10")
    return p10.join(R.nth_value(r, ["bin"], "len", 0.9).withColumnRenamed("value", "p90"), "bin")


@query("hash_sample", "WIN-08 WIN-09 MTH-07",
       f"""WITH {READS} SELECT bin, read_id FROM (SELECT bin, read_id, row_number() OVER (PARTITION BY bin ORDER BY md5('7:' || read_id), read_id) AS rn
  FROM reads WHERE length(seq) >= 400) WHERE rn <= 20""")
def hash_sample(spark, sf):
    r = reads(spark, sf).where(F.length("seq") >= 400).select("bin", "read_id")
    return R.hash_sample(r, ["bin"], "read_id", 20, seed=7)


@query("systematic_sample", "WIN-10",
       """SELECT source AS bin, doc_id AS read_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p,
  count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE p % greatest(n // 10, 1) = 0""")
def systematic_sample(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("bin"), F.col("doc_id").alias("read_id"))
    return R.systematic_sample(d, ["bin"], "read_id", 10)


@query("backbone_clusters", "WIN-13",
       """WITH RECURSIVE l AS (SELECT source AS bin, n_chars AS len, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC) AS rn
  FROM (SELECT DISTINCT source, n_chars FROM documents)),
f(bin, rn, heads) AS (SELECT DISTINCT bin, 0::BIGINT, []::BIGINT[] FROM l UNION ALL
  SELECT l.bin, l.rn, CASE WHEN len(list_filter(heads, lambda h: h / l.len < 1.5)) > 0 THEN heads ELSE list_append(heads, l.len) END
  FROM f JOIN l ON l.bin = f.bin AND l.rn = f.rn + 1)
SELECT bin, array_to_string(arg_max(heads, rn), ',') AS heads FROM f GROUP BY 1""")
def backbone_clusters(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("bin"), F.col("n_chars").cast("long").alias("len")).distinct()
    g = d.groupBy("bin").agg(F.collect_set("len").alias("lens"))
    return g.select("bin", F.concat_ws(",", F.transform(B.backbone_clusters(F.col("lens")), lambda x: x.cast("string"))).alias("heads"))


# ---- consensus ---------------------------------------------------------------------------

VOTES = f"""WITH {READS}, kp AS (SELECT bin, c, substr(seq, c * 256 + 1, 256) AS s FROM (
  SELECT bin, seq, unnest(range(0, length(seq) // 256 + 1)) AS c FROM reads)),
v AS (SELECT bin, c * 256 + i AS col, substr(s, i + 1, 1) AS base FROM (SELECT *, unnest(range(0, length(s))) AS i FROM kp)),
t AS (SELECT bin, col, base, count(*) AS n, sum(1.0 - pow(10.0, -(10 + (col % 30)) / 10.0)) AS w FROM v GROUP BY ALL)"""


@query("dominant_allele_columns", "AGG-06",
       f"""{VOTES}, g AS (SELECT bin, col, sum(n)::BIGINT AS depth, max(n) AS top, count(*) FILTER (n = mx) AS tops, arg_min(base, -n) AS b
  FROM (SELECT *, max(n) OVER (PARTITION BY bin, col) AS mx FROM t) GROUP BY ALL)
SELECT bin, col, depth, CASE WHEN depth < 20 OR tops > 1 OR top / depth < 0.5 THEN 'N' ELSE b END AS base,
  round(CASE WHEN depth < 20 THEN 0 ELSE top / depth END, 6) AS share FROM g""")
def dominant_allele_columns(spark, sf):
    t = C.tally(C.column_votes(reads(spark, sf), "bin"), ["bin"])
    d = C.dominant_alleles(t, ["bin"])
    return d.select("bin", F.col("col").cast("long").alias("col"), "depth", "base", F.round("share", 6).alias("share"))


@query("dominant_allele_consensus", "AGG-06 AGG-22",
       f"""{VOTES}, g AS (SELECT bin, col, sum(n)::BIGINT AS depth, max(n) AS top, count(*) FILTER (n = mx) AS tops, arg_min(base, -n) AS b
  FROM (SELECT *, max(n) OVER (PARTITION BY bin, col) AS mx FROM t) GROUP BY ALL),
s AS (SELECT bin, string_agg(CASE WHEN depth < 20 OR tops > 1 OR top / depth < 0.3 THEN 'N' ELSE b END, '' ORDER BY col) AS s FROM g GROUP BY 1)
SELECT bin, regexp_replace(regexp_replace(s, '^N+', ''), 'N+$', '') AS consensus FROM s""")
def dominant_allele_consensus(spark, sf):
    t = C.tally(C.column_votes(reads(spark, sf), "bin"), ["bin"])
    s = C.spell(C.dominant_alleles(t, ["bin"], min_share=0.3), ["bin"])
    return s.select("bin", C.trim_ends("consensus").alias("consensus"))


@query("two_method_consensus", "AGG-05 SEQ-15",
       f"""WITH {READS}, kp AS (SELECT bin, read_id, c, substr(seq, c * 256 + 1, 256) AS s FROM (SELECT bin, read_id, seq, unnest(range(0, length(seq) // 256 + 1)) AS c FROM reads)),
v AS (SELECT bin, read_id, c * 256 + i AS col, substr(s, i + 1, 1) AS base FROM (SELECT *, unnest(range(0, length(s))) AS i FROM kp)),
t AS (SELECT bin, col, base, count(*) AS n, sum((1.0::DOUBLE - pow(10.0, -(1 + (read_id * 7 + col) % 12) / 10.0))::DECIMAL(12, 6))::DOUBLE AS w FROM v GROUP BY ALL),
g AS (SELECT bin, col, sum(n)::BIGINT AS depth, sum(w::DECIMAL(18, 6))::DOUBLE AS tw FROM t GROUP BY ALL),
a AS (SELECT bin, col, base, w FROM (SELECT *, row_number() OVER (PARTITION BY bin, col ORDER BY w DESC, base) AS rn FROM t) WHERE rn = 1),
b AS (SELECT bin, col, base, n FROM (SELECT *, row_number() OVER (PARTITION BY bin, col ORDER BY n DESC, base) AS rn FROM t) WHERE rn = 1),
c AS (SELECT bin, col, depth, CASE WHEN depth >= 5 AND a.w / tw >= 0.3 THEN a.base ELSE 'N' END AS weighted, CASE WHEN depth >= 5 AND b.n / depth >= 0.3 THEN b.base ELSE 'N' END AS plain FROM g JOIN a USING (bin, col) JOIN b USING (bin, col))
SELECT bin, col, depth, weighted, plain, CASE WHEN weighted = plain THEN plain ELSE 'N' END AS base FROM c""")
def two_method_consensus(spark, sf):
    r = reads(spark, sf).select(F.struct("bin", "read_id").alias("k"), "seq")
    v = C.column_votes(r, "k").select("k.bin", "k.read_id", "col", "base")
    # quality differs from read to read and column to column; sums of decimals don't depend on their order
    q = 1 + (F.col("read_id") * 7 + F.col("col")) % 12
    v = v.withColumn("w", (1.0 - F.pow(F.lit(10.0), -q / 10.0)).cast("decimal(12,6)"))
    t = C.tally(v, ["bin"], "w").withColumn("w", F.col("w").cast("double"))
    return C.two_method_consensus(t, ["bin"], 5, 0.3, 0.3).withColumn("col", F.col("col").cast("long"))


@query("modal_length_products", "AGG-07",
       """WITH w AS (SELECT source AS bin, unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM documents),
c AS (SELECT bin, length(word) AS len, count(*) AS n FROM w GROUP BY ALL),
m AS (SELECT bin, arg_max(len, n * 1000 - len) AS len, max(n) AS n_products, count(*) AS lengths FROM c GROUP BY 1),
b AS (SELECT w.bin, i, substr(word, i, 1) AS ch, count(*) AS n FROM (SELECT w.bin, w.word, unnest(range(1, len + 1)) AS i FROM w JOIN m
  ON w.bin = m.bin AND length(word) = len) w GROUP BY ALL),
t AS (SELECT bin, i, ch FROM (SELECT *, row_number() OVER (PARTITION BY bin, i ORDER BY n DESC, ch) AS rn FROM b) WHERE rn = 1)
SELECT bin, any_value(len) AS len, any_value(n_products) AS n_products, any_value(lengths) AS lengths, string_agg(ch, '' ORDER BY i) AS consensus
FROM t JOIN m USING (bin) GROUP BY 1""")
def modal_length_products(spark, sf):
    w = table(spark, sf, "documents").select(F.col("source").alias("bin"), F.explode(
        F.regexp_extract_all("text", F.lit("([a-z]+)"), F.lit(1))).alias("word"))
    m = C.modal_length_products(w, "bin", "word")
    v = m.select("bin", "len", "n_products", "lengths", F.posexplode(F.split("word", "")).alias("col", "base"))
    t = v.groupBy("bin", "len", "n_products", "lengths", "col", "base").agg(F.count(F.lit(1)).alias("n"))
    b = t.groupBy("bin", "len", "n_products", "lengths", "col").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("base").alias("b"))).alias("m"))
    s = b.groupBy("bin", "len", "n_products", "lengths").agg(F.array_sort(F.collect_list(F.struct("col", F.col("m.b").alias("b")))).alias("c"))
    return s.select("bin", F.col("len").cast("long").alias("len"), "n_products", "lengths",
                    F.concat_ws("", F.transform("c", lambda x: x["b"])).alias("consensus"))


@query("msa_columns", "SEQ-17",
       """WITH r AS (SELECT conv_id, turn, regexp_replace(role || text, '[^a-z]', '-', 'g') AS s FROM conversations),
v AS (SELECT conv_id, turn, unnest(range(0, length(s))) AS i, s FROM r),
n AS (SELECT conv_id, count(*) AS rows FROM r GROUP BY 1),
c AS (SELECT conv_id, i, substr(s, i + 1, 1) AS base, count(*) AS n FROM v WHERE substr(s, i + 1, 1) <> '-' GROUP BY ALL),
g AS (SELECT conv_id, i, sum(n)::BIGINT AS filled, arg_max(base, n * 1000 - ascii(base)) AS base FROM c GROUP BY ALL)
SELECT conv_id, i AS col, base, filled, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS pos FROM g JOIN n USING (conv_id) WHERE filled / rows >= 0.5""")
def msa_columns(spark, sf):
    r = table(spark, sf, "conversations")
    s = F.regexp_replace(F.concat("role", "text"), "[^a-z]", "-")
    return C.occupied_columns(r.select("conv_id", F.col("turn").alias("row"), s.alias("seq")), ["conv_id"], 0.5)


@query("anchored_diagonals", "ALN-03 SEQ-12",
       f"""WITH {READS}, {sql_kmers(15, key="bin, read_id")}, tpl AS (SELECT bin, min(read_id) AS tid FROM reads WHERE length(seq) >= 100 GROUP BY 1),
idx AS (SELECT bin, kmer, min(pos) AS tpos FROM kmers SEMI JOIN tpl ON tpl.bin = kmers.bin AND tpl.tid = kmers.read_id GROUP BY ALL HAVING count(*) = 1),
d AS (SELECT k.bin, read_id, tpos - pos AS diag, count(*) AS hits, min(tpos) AS t_start, max(tpos) AS t_end FROM kmers k JOIN idx USING (bin, kmer) GROUP BY ALL HAVING count(*) >= 3)
SELECT bin, read_id, diag, hits, t_start, t_end FROM (SELECT *, row_number() OVER (PARTITION BY bin, read_id ORDER BY hits DESC, diag) AS rn FROM d) WHERE rn <= 8""")
def anchored_diagonals(spark, sf):
    r = reads(spark, sf)
    tpl = cut_lineage(r.where(F.length("seq") >= 100).groupBy("bin").agg(F.min("read_id").alias("read_id")))
    return C.anchored_diagonals(r, r.join(tpl, ["bin", "read_id"], "left_semi"), 15, "bin", "read_id").drop("rank")


# ---- graphs and sets ---------------------------------------------------------------------

EDGES = """edges AS (SELECT l_orderkey AS a, 1000000000 + l_partkey AS b FROM lineitem)"""


@query("connected_components", "GRF-01",
       f"""WITH RECURSIVE {EDGES}, e AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
cc(n, c) USING KEY (n) AS (SELECT a AS n, min(least(a, b)) AS c FROM e GROUP BY a UNION
  SELECT e.a, min(cc.c) FROM cc JOIN e ON e.b = cc.n JOIN recurring.cc AS old ON old.n = e.a WHERE cc.c < old.c GROUP BY e.a)
SELECT n AS node, c AS component FROM cc""")
def connected_components(spark, sf):
    li = table(spark, sf, "lineitem")
    e = li.select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") + 1000000000).alias("b"))
    nodes = e.select(F.col("a").alias("node")).union(e.select("b"))
    return G.components(e, nodes)


@query("set_match", "GRF-05",
       """WITH s AS (SELECT DISTINCT doc_id AS k, unnest(string_split(text, chr(10))) AS m FROM documents),
g AS (SELECT min(k) AS k FROM (SELECT k, list_sort(list(m)) AS ms FROM s GROUP BY 1) GROUP BY ms),
n AS (SELECT k, count(*) AS n FROM s SEMI JOIN g USING (k) GROUP BY 1),
j AS (SELECT a.k AS a, b.k AS b, count(*) AS shared FROM s a JOIN s b ON a.m = b.m AND a.k < b.k WHERE a.k IN (SELECT k FROM g) AND b.k IN (SELECT k FROM g) GROUP BY ALL)
SELECT a, b, shared, round(shared / (na.n + nb.n - shared), 6) AS jaccard FROM j JOIN n na ON na.k = a JOIN n nb ON nb.k = b
WHERE shared / (na.n + nb.n - shared) >= 0.8""")
def set_match(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("member"))
    m = G.set_match(s.withColumnRenamed("doc_id", "a"), s.withColumnRenamed("doc_id", "b"), same=True)
    return m.withColumn("jaccard", F.round("jaccard", 6))


@query("set_classes", "GRF-05",
       """WITH s AS (SELECT DISTINCT doc_id AS k, unnest(string_split(text, chr(10))) AS m FROM documents), g AS (SELECT k, list_sort(list(m)) AS ms FROM s GROUP BY 1)
SELECT k AS doc_id, min(k) OVER (PARTITION BY ms) AS representative FROM g""")
def set_classes(spark, sf):
    return G.set_classes(table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("member")).distinct(), "doc_id")


@query("membership_reconcile", "GRF-06",
       """WITH b AS (SELECT DISTINCT o_custkey AS k FROM orders), a AS (SELECT user_id AS k FROM events)
SELECT k, CASE WHEN k NOT IN (SELECT k FROM a) THEN 'lost' ELSE 'invented' END AS change FROM (
  (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL (SELECT k FROM a EXCEPT SELECT k FROM b))""")
def membership_reconcile(spark, sf):
    b = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    a = table(spark, sf, "events").select(F.col("user_id").alias("k"))
    return G.reconcile(b, a, ["k"])
