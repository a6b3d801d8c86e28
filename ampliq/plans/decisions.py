"""Choices, membership rules and audits over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import audit as A
from ..operators import consensus as C
from ..operators import design as D
from ..operators import identity as I
from ..operators import kmers as K
from ..operators import lineage as L
from ..operators import membership as MB
from .binding import READS, reads, sql_kmers, table
from .registry import query
from .similarity import SAMPLE_SQL, _sample
from .taxonomy import HEADERS, ORGANISM_SQL, headers


def _bins(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("class"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return o.join(c, "c_custkey").select(F.concat_ws(":", "o_orderpriority", "class").alias("bin"), "class").distinct()


BINS = """bins AS (SELECT DISTINCT o_orderpriority || ':' || c_mktsegment AS bin, c_mktsegment AS class FROM orders JOIN customer ON c_custkey = o_custkey)"""


@query("consensus_choice", "AGG-14",
       f"""WITH {READS}, {SAMPLE_SQL}, cand AS (SELECT bin, library AS "set", arg_max(seq, length(seq) * 10000000::BIGINT - read_id) AS seq FROM (
  SELECT bin, library, read_id, replace(seq, 'TT', 'NN') AS seq FROM reads) GROUP BY ALL),
{sql_kmers(21, 'both_s', 'bin')}, ck AS (SELECT DISTINCT bin, "set", substr(s, i + 1, 21) AS kmer FROM (SELECT *, unnest(range(0, 256)) AS i FROM (
  SELECT bin, "set", length(seq) AS n, c, substr(seq, c * 256 + 1, 277) AS s FROM (SELECT *, unnest(range(0, length(seq) // 256 + 1)) AS c FROM cand)))
  WHERE c * 256 + i + 21 <= n AND NOT contains(substr(s, i + 1, 21), 'N')), seen AS (SELECT DISTINCT bin, kmer FROM kmers),
sup AS (SELECT ck.bin, "set", 100.0 * count(seen.kmer) / count(*) AS support FROM ck LEFT JOIN seen ON seen.bin = ck.bin AND seen.kmer = ck.kmer GROUP BY ALL),
m AS (SELECT c.bin, c."set", coalesce(support, 0) AS support, 100.0 * (length(seq) - length(replace(seq, 'N', ''))) / length(seq) AS n_percent, length(seq) AS len FROM cand c LEFT JOIN sup USING (bin, "set") WHERE length(seq) > 0),
k AS (SELECT *, max(support) OVER (PARTITION BY bin) AS top FROM m WHERE n_percent <= 50)
SELECT bin, "set", round(support, 6) AS support, round(n_percent, 6) AS n_percent, len::INTEGER AS len FROM (
  SELECT *, row_number() OVER (PARTITION BY bin ORDER BY n_percent, len DESC, support DESC, "set") AS rn FROM k WHERE support >= top - 1) WHERE rn = 1""")
def consensus_choice(spark, sf):
    r = reads(spark, sf).withColumn("seq", F.replace("seq", F.lit("TT"), F.lit("NN")))
    cand = r.groupBy("bin", F.col("library").alias("set")).agg(F.max(F.struct(
        F.length("seq").alias("n"), (-F.col("read_id")).alias("neg"), F.col("seq"))).alias("m")).select("bin", "set", "m.seq").where("seq <> ''")
    s = K.choose_supported(K.read_support(cand, _sample(spark, sf)))
    return s.select("bin", "set", F.round("support", 6).alias("support"), F.round("n_percent", 6).alias("n_percent"), "len")


@query("regenerated_gate", "AGG-22",
       """WITH c AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', 'N', 'g') AS seq, length(text) % 31 AS diverging FROM documents WHERE text <> '')
SELECT doc_id, CASE WHEN 100.0 * length(regexp_replace(seq, '[^N]', '', 'g')) / length(seq) > 75 THEN 'too_many_n' WHEN diverging > 15 THEN 'methods_diverge' END AS reason FROM c""")
def regenerated_gate(spark, sf):
    """One base per letter: upper() would make two of some, as SS of a sharp s."""
    d = table(spark, sf, "documents").where("text <> ''").select("doc_id", F.regexp_replace(F.translate("text", "acgt", "ACGT"), "[^ACGT]", "N").alias("seq"), (F.length("text") % 31).alias("diverging"))
    return d.select("doc_id", C.quality_gate("seq", "diverging", max_n_percent=75.0).alias("reason"))


@query("related_competitors", "JOIN-20",
       f"""WITH {BINS}, t AS (SELECT c_custkey AS target, c_mktsegment AS class FROM customer),
p(a, b) AS (VALUES ('AUTOMOBILE', 'MACHINERY'), ('BUILDING', 'FURNITURE')),
n AS (SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT class, class FROM t)
SELECT DISTINCT target, bin FROM t JOIN n ON n.a = t.class JOIN bins ON bins.class = n.b""")
def related_competitors(spark, sf):
    t = table(spark, sf, "customer").select(F.col("c_custkey").alias("target"), F.col("c_mktsegment").alias("class"))
    p = spark.createDataFrame([("AUTOMOBILE", "MACHINERY"), ("BUILDING", "FURNITURE")], "a string, b string")
    return MB.competitor_bins(t, _bins(spark, sf), p)


@query("wildcard_members", "JOIN-26",
       f"""WITH {BINS}, r AS (SELECT s_suppkey AS target, CASE s_suppkey % 4 WHEN 0 THEN '*' || left(c_mktsegment, 1 + s_suppkey % 3) WHEN 1 THEN '*' ELSE o_orderpriority || ':' || c_mktsegment END AS pattern, o_orderpriority || ':' || c_mktsegment AS gone
  FROM supplier JOIN customer ON c_custkey = s_suppkey JOIN orders ON o_custkey = c_custkey)
SELECT DISTINCT target, bin FROM r JOIN bins ON (pattern LIKE '*%' AND starts_with(class, substr(pattern, 2))) OR pattern = bin WHERE bin <> gone OR target % 2 = 1""")
def wildcard_members(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_suppkey").alias("c_custkey"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    j = s.join(table(spark, sf, "customer"), "c_custkey").join(o, "c_custkey").withColumn("bin", F.concat_ws(":", "o_orderpriority", "c_mktsegment"))
    k = F.col("s_suppkey") % 4
    pattern = (F.when(k == 0, F.concat(F.lit("*"), F.left("c_mktsegment", (1 + F.col("s_suppkey") % 3).cast("int")))).when(k == 1, "*").otherwise(F.col("bin")))
    rules = j.select(F.col("s_suppkey").alias("target"), pattern.alias("pattern"), F.when(F.col("s_suppkey") % 2 == 0, F.array("bin")).otherwise(F.array().cast("array<string>")).alias("excluded"))
    return MB.expand_wildcards(rules, _bins(spark, sf))


@query("hit_headers", "JOIN-27",
       """SELECT user_id AS hit, count(*) AS n, any_value(c_name) AS header FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY 1""")
def hit_headers(spark, sf):
    h = table(spark, sf, "customer").select(F.col("c_custkey").alias("hit"), F.col("c_name").alias("header"))
    return MB.headers_of_hits(table(spark, sf, "events").select(F.col("user_id").alias("hit")), h, "hit")


@query("foreign_members", "AUD-07",
       """WITH m AS (SELECT DISTINCT o_orderpriority AS library, c_custkey AS taxon FROM orders JOIN customer ON c_custkey = o_custkey),
cl AS (SELECT c_custkey AS taxon, 1000000 + n_regionkey AS clade FROM customer JOIN nation ON n_nationkey = c_nationkey),
al AS (SELECT DISTINCT o_orderpriority AS library, 1000000 + left(o_orderpriority, 1)::INT % 5 AS clade FROM orders)
SELECT library, taxon FROM m WHERE NOT EXISTS (SELECT 1 FROM cl JOIN al USING (clade) WHERE cl.taxon = m.taxon AND al.library = m.library)""")
def foreign_members(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("library"), F.col("o_custkey").alias("c_custkey"))
    close = c.join(n, "c_nationkey").select(F.col("c_custkey").alias("node"), (F.lit(1000000) + F.col("n_regionkey")).alias("ancestor"))
    members = o.join(c, "c_custkey").select("library", F.col("c_custkey").alias("taxon")).distinct()
    allowed = o.select("library", (F.lit(1000000) + F.left("library", F.lit(1)).cast("int") % 5).alias("clade")).distinct()
    return A.foreign_members(members, close, allowed)


@query("stale_stages", "ORC-02",
       """WITH c AS (SELECT o_custkey AS stage, md5(count(*)::VARCHAR || '|' || o_custkey) AS signature FROM orders GROUP BY o_custkey),
m AS (SELECT c_custkey AS stage, md5((SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND (c_nationkey % 3 > 0 OR o_orderstatus = 'O'))::VARCHAR || '|' || c_custkey) AS signature,
  CASE WHEN c_nationkey % 5 = 1 THEN 'failed' ELSE 'done' END AS status, CASE WHEN c_acctbal < 0 THEN 0 ELSE 7 END AS rows_out FROM customer WHERE c_nationkey <> 4)
SELECT stage, CASE WHEN m.signature IS NULL THEN 'run: never' WHEN status <> 'done' THEN 'run: unfinished' WHEN m.signature <> c.signature THEN 'run: inputs changed'
  WHEN rows_out = 0 THEN 'run: empty output' ELSE 'skip' END AS decision FROM c LEFT JOIN m USING (stage)""")
def stale_stages(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "stage")
    sign = lambda n: F.md5(F.concat_ws("|", n.cast("string"), F.col("stage").cast("string")))
    current = o.groupBy("stage").agg(F.count(F.lit(1)).alias("n")).select("stage", sign(F.col("n")).alias("signature"))
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "stage").where("c_nationkey <> 4")
    old = c.join(o.select("stage", "o_orderstatus"), "stage", "left").groupBy("stage", "c_nationkey", "c_acctbal").agg(
        F.count(F.when(F.col("o_orderstatus").isNotNull() & ((F.col("c_nationkey") % 3 > 0) | (F.col("o_orderstatus") == "O")), 1)).alias("n"))
    manifest = old.select("stage", sign(F.col("n")).alias("signature"), F.when(F.col("c_nationkey") % 5 == 1, "failed").otherwise("done").alias("status"),
                          F.when(F.col("c_acctbal") < 0, 0).otherwise(7).cast("long").alias("rows_out"))
    return A.stale_stages(manifest, current)


@query("name_claims", "DEC-12 TAX-08",
       f"""WITH {HEADERS}, {ORGANISM_SQL}, n AS (SELECT doc_id, idx, CASE (doc_id + idx) % 5 WHEN 0 THEN name || ' sp.' WHEN 1 THEN regexp_replace(name, ' ', ' cf. ') WHEN 2 THEN 'cannot be named' WHEN 3 THEN 'Candidatus ' || name ELSE name END AS name FROM org WHERE name IS NOT NULL)
SELECT doc_id, idx, CASE WHEN contains(name, 'cf.') THEN 'cf.' WHEN suffix(name, 'sp.') THEN 'genus' WHEN contains(name, ' ') AND name <> 'cannot be named' THEN 'species' ELSE 'unnamed' END AS level,
  regexp_extract(regexp_replace(name, '^Candidatus ', ''), '^(\\S+)', 1) AS genus FROM n""")
def name_claims(spark, sf):
    k = (F.col("doc_id") + F.col("idx")) % 5
    h = headers(spark, sf).select("doc_id", "idx", N.organism("header").alias("name")).where("name IS NOT NULL")
    name = (F.when(k == 0, F.concat("name", F.lit(" sp."))).when(k == 1, F.regexp_replace("name", "^(\\S+) ", "$1 cf. ")).when(k == 2, "cannot be named")
            .when(k == 3, F.concat(F.lit("Candidatus "), "name")).otherwise(F.col("name")))
    return h.select("doc_id", "idx", name.alias("name")).select("doc_id", "idx", I.name_level("name").alias("level"), N.genus_skipping_candidatus("name").alias("genus"))


@query("best_reference_hits", "GRF-08",
       """WITH h AS (SELECT DISTINCT l_orderkey AS doc, l_returnflag AS reference, 90 + (l_discount * 50)::DOUBLE AS identity, l_quantity::BIGINT AS aligned, l_partkey AS target FROM lineitem),
r AS (SELECT doc, reference, identity AS top FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY identity DESC, aligned DESC, reference) AS rn FROM h) WHERE rn = 1)
SELECT doc, reference, round(identity, 6) AS identity, aligned, target, row_number() OVER (PARTITION BY doc ORDER BY identity DESC, aligned DESC, target) AS rank
FROM h JOIN r USING (doc, reference) WHERE identity >= top - 1.0""")
def best_reference_hits(spark, sf):
    h = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("reference"), (90 + (F.col("l_discount") * 50).cast("double")).alias("identity"),
                                            F.col("l_quantity").cast("long").alias("aligned"), F.col("l_partkey").alias("target")).distinct()
    return L.one_reference_hits(h, "doc").withColumn("identity", F.round("identity", 6))


@query("locus_windows", "OPT-02",
       f"""WITH {READS}, w AS (SELECT read_id, seq, length(seq) AS n, unnest(range(0, greatest(1, floor((length(seq) - 700) / 300)::INT + 2))) AS i FROM reads),
x AS (SELECT read_id, i, least(i * 300, greatest(0, n - 700)) AS s, seq, n FROM w)
SELECT read_id, i::INTEGER AS "window", s::INTEGER AS start, least(n, s + 700)::INTEGER AS "end", md5(substr(seq, s::INT + 1, (least(n, s + 700) - s)::INT)) AS digest FROM x WHERE least(n, s + 700) - s >= 120""")
def locus_windows(spark, sf):
    w = D.locus_windows(reads(spark, sf).select("read_id", "seq"), "read_id")
    return w.select("read_id", "window", "start", "end", F.md5("seq").alias("digest"))


@query("genus_coverage", "ALN-13 AGG-16",
       f"""WITH {READS}, s AS (SELECT library AS genus, read_id AS doc_id, substr(replace(seq, 'GTA', '---'), 1, 9) AS f, substr(replace(seq, 'GTA', '---'), 21, 9) AS r FROM reads),
b AS (SELECT genus, doc_id, k, substr(f, k, 1) AS fb, substr(r, k, 1) AS rb, ['ACGT', 'AG', 'ACGT', 'ACGT', 'CT', 'ACGT', 'ACG', 'ACGT', 'AGT'][k] AS ok FROM s, (SELECT unnest(range(1, 10)) AS k) WHERE length(f) = 9 AND length(r) = 9),
m AS (SELECT genus, doc_id,
  CASE WHEN count(*) FILTER (fb <> '-') >= 0.8 * 9 AND count(*) FILTER (k > 6 AND NOT contains(ok, fb)) = 0 THEN count(*) FILTER (NOT contains(ok, fb)) END AS fm,
  CASE WHEN count(*) FILTER (rb <> '-') >= 0.8 * 9 AND count(*) FILTER (k > 6 AND NOT contains(ok, rb)) = 0 THEN count(*) FILTER (NOT contains(ok, rb)) END AS rm FROM b GROUP BY ALL)
SELECT genus, count(*) FILTER (fm <= 1 AND rm <= 1) AS amplified, count(*) AS tested FROM m WHERE fm IS NOT NULL OR rm IS NOT NULL GROUP BY 1""")
def genus_coverage(spark, sf):
    seq = F.replace("seq", F.lit("GTA"), F.lit("---"))
    s = reads(spark, sf).select(F.col("library").alias("genus"), F.substring(seq, 1, 9).alias("f"), F.substring(seq, 21, 9).alias("r")).where("length(f) = 9 and length(r) = 9")
    p = F.lit("NRNNYNVND")
    return D.coverage_by_genus(s.select("genus", D.site_mismatch("f", p).alias("forward"), D.site_mismatch("r", p).alias("reverse")))


@query("target_genera", "TAX-17",
       """WITH d AS (SELECT c_custkey AS target, ['urgent', 'high', 'medium', 'known'][c_nationkey % 5 + 1] AS genus FROM customer WHERE c_nationkey % 5 < 4),
m AS (SELECT DISTINCT o_custkey AS target, lower(split_part(substr(o_orderpriority, 3), ' ', -1)) AS genus FROM orders WHERE o_orderpriority NOT LIKE '%LOW')
SELECT coalesce(d.target, m.target) AS target, coalesce(d.genus, m.genus) AS genus, d.target IS NOT NULL AS declared, m.target IS NOT NULL AS measured FROM d FULL JOIN m ON d.target = m.target AND d.genus = m.genus""")
def target_genera(spark, sf):
    names = F.array(*[F.lit(x) for x in ("uncultured Urgent alba", "High sp.", "Medium", "Ca. Not known", "Low (type)")])
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("target"), F.get(names, (F.col("c_nationkey") % 5).cast("int")).alias("name"))
    part = F.concat(F.initcap(F.lower(F.substring("o_orderpriority", 3, 99))), F.lit(" sp. (measured, twice)"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("target"), F.regexp_replace(part, ",", "").alias("part")).distinct()
    m = o.groupBy("target").agg(F.concat_ws("; ", F.sort_array(F.collect_list("part"))).alias("identity"))
    return MB.target_genera(d, m)
