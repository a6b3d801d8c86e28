"""Membership, reconciliation and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import membership as MB
from ..operators import sites
from .binding import MEMBERSHIP, documents, headers, HEADERS, membership, panel, reads, table
from .panel import BASE, BEST, PRODUCTS, RATES, _rates, wilson_sql
from .registry import query


@query("keyword_pool", "JOIN-17",
       f"""WITH {HEADERS}, k(class, key) AS (VALUES ('A', 'bacteria'), ('A', 'archaea'), ('B', 'fungi'), ('B', 'mycota'), ('B', 'us b'))
SELECT DISTINCT class, database, doc_id, idx FROM headers JOIN k ON contains(lower(header), lower(key)) WHERE length(header) >= 50""")
def keyword_pool(spark, sf):
    h = headers(spark, sf).select(F.struct("database", "doc_id", "idx").alias("rec_id"), "header", F.col("header").alias("seq"))
    k = spark.createDataFrame([("A", "bacteria"), ("A", "archaea"), ("B", "fungi"), ("B", "mycota"), ("B", "us b")], "class string, key string")
    return MB.keyword_pool(h, k, 50).select("class", "rec_id.database", "rec_id.doc_id", "rec_id.idx")


@query("target_context", "JOIN-19",
       """WITH t AS (SELECT c_custkey AS target, c_mktsegment AS class FROM customer), b AS (SELECT DISTINCT o_orderpriority || ':' || c_mktsegment AS bin, c_mktsegment AS class FROM orders JOIN customer ON c_custkey = o_custkey),
x AS (SELECT DISTINCT o_custkey AS target, o_orderpriority || ':' || c_mktsegment AS bin, CASE WHEN o_orderpriority = '1-URGENT' THEN 'mixed' ELSE 'member' END AS role FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 400000),
a AS (SELECT DISTINCT o_custkey AS target, o_orderpriority || ':' || c_mktsegment AS bin, 'member' AS role FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P'),
k AS (SELECT * FROM x UNION ALL SELECT * FROM a WHERE target NOT IN (SELECT target FROM x) UNION ALL
  SELECT target, bin, 'member' FROM t JOIN b USING (class) WHERE target NOT IN (SELECT target FROM x) AND target NOT IN (SELECT target FROM a))
SELECT * FROM k UNION ALL SELECT target, bin, 'competitor' FROM (SELECT target, bin FROM t JOIN b USING (class) EXCEPT SELECT target, bin FROM k)""")
def target_context(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey").join(c, "c_custkey")
    o = o.withColumn("bin", F.concat_ws(":", "o_orderpriority", "c_mktsegment"))
    t = c.select(F.col("c_custkey").alias("target"), F.col("c_mktsegment").alias("class"))
    bins = o.select("bin", F.col("c_mktsegment").alias("class")).distinct()
    x = o.where("o_totalprice > 400000").select(F.col("c_custkey").alias("target"), "bin", F.when(
        F.col("o_orderpriority") == "1-URGENT", "mixed").otherwise("member").alias("role")).distinct()
    a = o.where("o_orderstatus = 'P'").select(F.col("c_custkey").alias("target"), "bin", F.lit("member").alias("role")).distinct()
    return MB.resolve_context(t, x, a, bins)


@query("order_mapping", "JOIN-21",
       """WITH l AS (SELECT s_nationkey AS class, s_name AS a, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS rn, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
r AS (SELECT class, b, row_number() OVER (PARTITION BY class ORDER BY b) AS rn, count(*) OVER (PARTITION BY class) AS n FROM (SELECT DISTINCT o_custkey % 25 AS class, o_orderpriority AS b FROM orders))
SELECT l.class, a, b FROM l JOIN r ON l.class = r.class AND l.rn = r.rn AND l.n = r.n""")
def order_mapping(spark, sf):
    left = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("class"), F.col("s_name").alias("a"))
    right = table(spark, sf, "orders").select((F.col("o_custkey") % 25).alias("class"), F.col("o_orderpriority").alias("b"))
    return MB.order_mapping(left, right, "class", "a", "b")


@query("target_name_resolution", "JOIN-22",
       """WITH t AS (SELECT DISTINCT replace(p_name, ' ', '_') AS target FROM part UNION SELECT DISTINCT p_type FROM part),
r AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS ref FROM part UNION SELECT DISTINCT p_type FROM part UNION SELECT DISTINCT p_brand FROM part)
SELECT ref, CASE WHEN ref IN (SELECT target FROM t) THEN ref WHEN (SELECT count(*) FROM t WHERE starts_with(target, ref || '_')) = 1 THEN (SELECT min(target) FROM t WHERE starts_with(target, ref || '_')) END AS target FROM r""")
def target_name_resolution(spark, sf):
    p = table(spark, sf, "part")
    t = p.select(F.regexp_replace("p_name", " ", "_").alias("target")).union(p.select("p_type")).distinct()
    r = p.select(F.split("p_name", " ")[0].alias("ref")).union(p.select("p_type")).union(p.select("p_brand")).distinct()
    return MB.resolve_names(r, t)


@query("paired_primer_hits", "JOIN-18",
       """WITH h AS (SELECT l_linenumber AS pair, l_suppkey AS subject, CASE WHEN l_returnflag = 'R' THEN 'F' ELSE 'R' END AS primer, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand,
  l_partkey * 10 AS start, l_partkey * 10 + 20 AS "end" FROM lineitem)
SELECT a.pair, a.subject, a.primer AS p1, a.start AS s, b."end" AS e, b."end" - a.start AS bp FROM h a JOIN h b ON a.pair = b.pair AND a.subject = b.subject AND a.strand = '+' AND b.strand = '-'
  AND a.primer <> b.primer AND b."end" - a.start BETWEEN 60 AND 400""")
def paired_primer_hits(spark, sf):
    li = table(spark, sf, "lineitem")
    h = li.select(F.col("l_linenumber").alias("pair"), F.col("l_suppkey").alias("subject"), F.when(F.col("l_returnflag") == "R", "F").otherwise("R").alias("primer"),
                  F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"), (F.col("l_partkey") * 10).alias("start"),
                  (F.col("l_partkey") * 10 + 20).alias("end"))
    return MB.paired_hits(h, 60, 400)


@query("membership_rederived", "DEC-14",
       """WITH o AS (SELECT l_suppkey % 7 AS target, l_suppkey AS bin, CASE WHEN count(*) % 2 = 0 THEN 'member' ELSE 'competitor' END AS role FROM lineitem GROUP BY ALL),
s AS (SELECT s_suppkey % 7 AS target, s_suppkey AS bin, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal / 10000 END AS share FROM supplier),
j AS (SELECT target, bin, role AS old, CASE WHEN share >= 0.5 THEN 'member' WHEN share >= 0.15 THEN 'mixed' ELSE coalesce(role, 'none') END AS new FROM o FULL JOIN s USING (target, bin))
SELECT target, bin, old, new, new <> coalesce(old, 'none') AS changed FROM j""")
def membership_rederived(spark, sf):
    o = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("target"), F.col("l_suppkey").alias("bin")).agg(
        F.when(F.count(F.lit(1)) % 2 == 0, "member").otherwise("competitor").alias("role"))
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") % 7).alias("target"), F.col("s_suppkey").alias("bin"),
                                            F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal") / 10000).alias("share"))
    return MB.rederive(o, s)


@query("membership_scenarios", "DEC-15 AGG-27",
       f"""{BASE}, {PRODUCTS}, {BEST}, {RATES}, {MEMBERSHIP}, d AS (SELECT 'labels' AS scenario, bin, role FROM membership UNION ALL
  SELECT 'library', source, CASE WHEN count(*) FILTER (lang = 'en') * 2 >= count(*) THEN 'member' ELSE 'competitor' END FROM documents GROUP BY source UNION ALL
  SELECT 'name', bin, CASE WHEN length(bin) = 4 THEN 'member' ELSE 'competitor' END FROM membership),
g AS (SELECT scenario, pair, min({wilson_sql('k', 'n', False)}) FILTER (role = 'member') AS lo, max({wilson_sql('k', 'n', True)}) FILTER (role = 'competitor') AS hi FROM rates JOIN d USING (bin) GROUP BY ALL)
SELECT scenario, pair, round(lo, 8) AS member_low, round(hi, 8) AS rival_high, round(CASE WHEN hi > 0 THEN lo / hi END, 8) AS fold FROM g""")
def membership_scenarios(spark, sf):
    m = membership(spark, sf)
    d = table(spark, sf, "documents").groupBy(F.col("source").alias("bin")).agg(F.when(
        F.count(F.when(F.col("lang") == "en", 1)) * 2 >= F.count(F.lit(1)), "member").otherwise("competitor").alias("role"))
    defs = (m.select(F.lit("labels").alias("scenario"), "bin", "role").union(d.select(F.lit("library"), "bin", "role"))
            .union(m.select(F.lit("name"), "bin", F.when(F.length("bin") == 4, "member").otherwise("competitor"))))
    s = MB.scenario_rates(_rates(spark, sf), defs)
    return s.select("scenario", "pair", *[F.round(c, 8).alias(c) for c in ("member_low", "rival_high", "fold")])


@query("level_test", "DEC-16",
       """WITH p AS (SELECT c_nationkey AS target, o_orderpriority AS species, left(o_orderpriority, 1) < '3' AS g, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
t AS (SELECT n_nationkey AS target, '1-URGENT' AS species, true AS g FROM nation),
s AS (SELECT p.target, sum(n) AS records, coalesce(sum(n) FILTER (p.species = t.species), 0) AS own_species, coalesce(sum(n) FILTER (p.g = t.g), 0) AS own_genus FROM p JOIN t USING (target) GROUP BY 1)
SELECT t.target, CASE WHEN records IS NULL THEN 'NO PANEL' WHEN own_species = records THEN 'SPECIES SPECIFIC' WHEN own_genus = records THEN 'GENUS SPECIFIC' ELSE 'NOT SPECIFIC' END AS level FROM t LEFT JOIN s USING (target)""")
def level_test(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey").join(table(spark, sf, "customer"), "c_custkey")
    p = o.groupBy(F.col("c_nationkey").alias("target"), F.col("o_orderpriority").alias("species"), (F.left("o_orderpriority", F.lit(1)) < "3").alias("genus")).agg(
        F.count(F.lit(1)).alias("n"))
    t = table(spark, sf, "nation").select(F.col("n_nationkey").alias("target"), F.lit("1-URGENT").alias("species"), F.lit(True).alias("genus"))
    return MB.level_test(p, t).select("target", "level")


@query("source_precedence", "WIN-15",
       """WITH s AS (SELECT source AS bin, lang AS "set", doc_id AS rec_id, n_chars AS len, coalesce(toxic = 1, false) AS undecided FROM documents LEFT JOIN labels USING (doc_id)),
b AS (SELECT bin, rec_id AS best FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY list_position(['de', 'fr', 'en'], "set"), len DESC, rec_id) AS rn FROM s WHERE NOT undecided AND "set" IN ('de', 'fr', 'en')) WHERE rn = 1)
SELECT s.bin, "set", rec_id, CASE WHEN rec_id = best THEN 'chosen' WHEN undecided THEN 'undecided' WHEN "set" NOT IN ('de', 'fr', 'en') THEN 'unknown_set' ELSE 'superseded' END AS status FROM s LEFT JOIN b USING (bin)""")
def source_precedence(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    s = d.select(F.col("source").alias("bin"), F.col("lang").alias("set"), F.col("doc_id").alias("rec_id"), F.col("n_chars").alias("len"),
                 F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("undecided"))
    return MB.source_precedence(s, ["de", "fr", "en"])


@query("template_fill", "WIN-16",
       """WITH p AS (SELECT conv_id, turn, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGTRYSWKMBDHVN]', '', 'g') AS core, lead(regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGTRYSWKMBDHVN]', '', 'g')) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations),
c AS (SELECT conv_id, turn, core, coalesce(ref, '') AS ref FROM p WHERE core <> ''),
x AS (SELECT conv_id, turn, i, substr(core, i, 1) AS a, CASE WHEN length(ref) = length(core) THEN substr(ref, i, 1) ELSE substr(core, i, 1) END AS b FROM (SELECT *, unnest(range(1, length(core) + 1)) AS i FROM c))
SELECT conv_id, turn, md5(string_agg(CASE WHEN a IN ('A','C','G','T') THEN a WHEN b IN ('A','R','W','M','D','H','V') THEN 'A' WHEN b IN ('C','Y','S','B') THEN 'C' WHEN b IN ('G','K') THEN 'G' WHEN b = 'T' THEN 'T' ELSE 'N' END, '' ORDER BY i)) AS filled_md5 FROM x GROUP BY ALL""")
def template_fill(spark, sf):
    from pyspark.sql import Window
    c = table(spark, sf, "conversations")
    up = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    ref = F.lead(F.regexp_replace(up, "[^ACGTRYSWKMBDHVN]", "")).over(Window.partitionBy("conv_id").orderBy("turn"))
    c = c.select("conv_id", "turn", F.regexp_replace(up, "[^ACGTRYSWKMBDHVN]", "").alias("core"), F.coalesce(ref, F.lit("")).alias("ref"))
    return c.where("core <> ''").select("conv_id", "turn", F.md5(MB.fill_codes("core", "ref")).alias("filled_md5"))


@query("capped_species", "WIN-17",
       """WITH r AS (SELECT l_returnflag || l_linestatus AS genus, l_suppkey AS species, l_orderkey * 10 + l_linenumber AS rec_id, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS rr FROM lineitem),
f AS (SELECT genus, species, min(rec_id) AS f, count(*) AS n FROM r GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY genus ORDER BY f, species) AS sr FROM f),
k AS (SELECT genus, count(*) AS kr, count(DISTINCT species) AS ks FROM r JOIN s USING (genus, species) WHERE rr <= 5 AND sr <= 8 GROUP BY 1)
SELECT genus, kr AS kept_records, ks AS kept_species, (sum(n) - any_value(kr))::BIGINT AS cut_records, count(*) - any_value(ks) AS cut_species FROM f JOIN k USING (genus) GROUP BY ALL""")
def capped_species(spark, sf):
    # (l_orderkey, l_linenumber) repeats in these tables, and equal record ids are interchangeable here
    r = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("genus"), F.col("l_suppkey").alias("species"),
                                            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rec_id"))
    return MB.capped_species(r, 8, 5)


@query("purity_verdict", "AGG-17",
       """WITH c AS (SELECT source AS bin, lang AS cluster, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT bin, sum(n) AS total, arg_max(cluster, n * 1000 + ascii(cluster)) AS top, max(n) AS mx FROM c GROUP BY 1)
SELECT bin, count(*) FILTER (cluster <> top AND n >= 3 AND n / total >= 0.05) AS secondary, round(max(mx / total), 8) AS dominant_share,
  CASE WHEN count(*) FILTER (cluster <> top AND n >= 3 AND n / total >= 0.05) > 0 OR max(mx / total) < 0.5 THEN 'MIXED' ELSE 'PURE' END AS purity FROM c JOIN t USING (bin) GROUP BY 1""")
def purity_verdict(spark, sf):
    c = table(spark, sf, "documents").groupBy(F.col("source").alias("bin"), F.col("lang").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    return MB.purity(c, "bin").withColumn("dominant_share", F.round("dominant_share", 8))


@query("class_representatives", "AGG-23",
       """WITH c AS (SELECT lang, source, doc_id AS bin, length(replace(regexp_replace(translate(text, 'acgtun', 'ACGTUN'), '[^ACGTUN]', 'N', 'g'), 'N', '')) AS covered FROM documents)
SELECT lang, source, bin, covered FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY covered DESC, bin) AS rn FROM c WHERE covered >= 200) WHERE rn = 1""")
def class_representatives(spark, sf):
    from ..functions import seq as S
    d = documents(spark, sf).select("lang", "source", F.col("doc_id").alias("bin"), S.clean("text").alias("seq"))
    return MB.representatives(d, ["lang", "source"]).withColumn("covered", F.col("covered").cast("long"))


# ---- audits -------------------------------------------------------------------------------

@query("audit_key_gaps", "AUD-01 AUD-12",
       """SELECT k, 'right' AS missing_in FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT user_id FROM events) UNION ALL
SELECT k, 'left' FROM (SELECT user_id AS k FROM events EXCEPT SELECT c_custkey FROM customer)""")
def audit_key_gaps(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, sf, "events").select(F.col("user_id").alias("k"))
    return A.missing_keys(c, o, ["k"])


@query("audit_values", "AUD-01 AUD-05",
       """WITH a AS (SELECT doc_id, n_chars AS v FROM documents), b AS (SELECT doc_id, length(text) AS v FROM documents WHERE lang <> 'es')
SELECT doc_id, a.v AS left_value, b.v AS right_value FROM a FULL JOIN b USING (doc_id) WHERE a.v IS DISTINCT FROM b.v""")
def audit_values(spark, sf):
    d = table(spark, sf, "documents")
    a = d.select("doc_id", F.col("n_chars").alias("v"))
    b = d.where("lang <> 'es'").select("doc_id", F.length("text").cast("long").alias("v"))
    return A.differing_values(a, b, ["doc_id"], "v")


@query("audit_row_drift", "AUD-08 AUD-04",
       """WITH a AS (SELECT o_custkey, o_orderpriority, o_orderstatus FROM orders), b AS (SELECT o_custkey, o_orderpriority, CASE WHEN o_totalprice > 480000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def audit_row_drift(spark, sf):
    o = table(spark, sf, "orders")
    a = o.select("o_custkey", "o_orderpriority", "o_orderstatus")
    b = o.select("o_custkey", "o_orderpriority", F.when(F.col("o_totalprice") > 480000, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return A.row_drift(a, b)


@query("audit_alphabet", "AUD-01 AUD-12",
       """WITH t AS (SELECT lang, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS s FROM documents)
SELECT lang, sum(length(regexp_replace(s, '[^U]', '', 'g')))::BIGINT AS u, sum(length(regexp_replace(s, '[^T]', '', 'g')))::BIGINT AS t, count(*) AS records FROM t GROUP BY 1""")
def audit_alphabet(spark, sf):
    d = documents(spark, sf).select("lang", F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("s"))
    return A.alphabet_profile(d, "lang", "s").drop("foreign")


@query("audit_acceptance", "AUD-06",
       """SELECT count(*) AS rows, count(*) FILTER (quality IS NULL) AS null_quality, count(*) FILTER (toxic IS NULL) AS null_toxic,
  count(*) >= 10 AND count(*) FILTER (quality IS NULL) = 0 AND count(*) FILTER (toxic IS NULL) = 0 AS accepted FROM documents LEFT JOIN labels USING (doc_id)""")
def audit_acceptance(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return A.acceptance(d, 10, ["quality", "toxic"])


@query("audit_access", "AUD-13 SRC-14",
       """WITH e(lang, m) AS (VALUES ('en', 10), ('de', 100000000), ('xx', 1), ('fr', 5)), g AS (SELECT lang, count(*) AS records, max(length(text)) AS longest FROM documents GROUP BY 1)
SELECT e.lang, coalesce(records, 0) AS records, longest, CASE WHEN records IS NULL THEN 'NOT READ' WHEN records < m THEN 'SHORT' ELSE 'OK' END AS status FROM e LEFT JOIN g USING (lang)""")
def audit_access(spark, sf):
    e = spark.createDataFrame([("en", 10), ("de", 100000000), ("xx", 1), ("fr", 5)], "lang string, min_records long")
    return A.access_proof(table(spark, sf, "documents").select("lang", F.col("text").alias("seq")), e, "lang")


@query("audit_engines_agree", "AUD-03 JOIN-01 JOIN-04",
       f"{BASE} SELECT pair, strand, side, count(*) AS seeded, count(*) AS scanned FROM sites GROUP BY ALL")
def audit_engines_agree(spark, sf):
    """Seeded plan and seedless scan counted side by side; the panel is one row per reference."""
    r, p = reads(spark, sf), panel(spark, sf)
    keys = ["pair", "strand", "side"]
    a = sites.seeded_sites(r, p, 1, shortest=20, longest=20).groupBy(*keys).agg(F.count(F.lit(1)).alias("seeded"))
    b = sites.scan_sites(r, sites.patterns(p), 1).groupBy(*keys).agg(F.count(F.lit(1)).alias("scanned"))
    return a.join(b, keys, "full_outer")


@query("four_method_table", "AUD-10",
       """WITH a AS (SELECT doc_id, lang AS base FROM documents), b AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label FROM labels), c AS (SELECT page_id AS doc_id, left(url, 4) AS page FROM pages),
d AS (SELECT conv_id AS doc_id, min(role) AS conversation FROM conversations GROUP BY 1)
SELECT doc_id, base, label, page, conversation FROM a FULL JOIN b USING (doc_id) FULL JOIN c USING (doc_id) FULL JOIN d USING (doc_id)""")
def four_method_table(spark, sf):
    a = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("base"))
    b = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("name"))
    c = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.left("url", F.lit(4)).alias("name"))
    d = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.min("role").alias("name"))
    return A.four_columns(a, [("label", b), ("page", c), ("conversation", d)], "doc_id")


@query("status_counts", "AUD-14",
       """SELECT s AS o_orderpriority, (SELECT count(*) FROM orders WHERE o_orderpriority = s) AS n FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('9-NONE')) v(s)""")
def status_counts(spark, sf):
    return A.status_counts(table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "9-NONE"])


@query("remeasured_rates", "AUD-11 AGG-27",
       """WITH o AS (SELECT l_suppkey, 100.0 * count(*) FILTER (l_returnflag = 'R') / count(*) AS p FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), n AS (SELECT l_suppkey, 100.0 * count(*) FILTER (l_returnflag = 'R') / count(*) AS p FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(o.p, 8) AS old_pct, round(n.p, 8) AS new_pct, round(n.p - o.p, 8) AS delta FROM o FULL JOIN n USING (l_suppkey)""")
def remeasured_rates(spark, sf):
    li = table(spark, sf, "lineitem")

    def pct(df):
        return df.groupBy("l_suppkey").agg((100.0 * F.count(F.when(F.col("l_returnflag") == "R", 1)) / F.count(F.lit(1))).alias("pct"))

    m = A.remeasured(pct(li.where("l_linestatus = 'O'")), pct(li), ["l_suppkey"])
    return m.select("l_suppkey", *[F.round(c, 8).alias(c) for c in ("old_pct", "new_pct", "delta")])


@query("stage_signatures", "ORC-02 SNK-03",
       """WITH d AS (SELECT o_orderpriority, sum(('0x' || substr(md5(o_orderkey || '|' || o_orderstatus || '|' || o_custkey), 1, 12))::HUGEINT)::VARCHAR AS digest, count(*) AS rows FROM orders GROUP BY 1)
SELECT o_orderpriority, rows, md5(o_orderpriority || '|' || rows || '|' || digest) AS signature FROM d""")
def stage_signatures(spark, sf):
    return A.signature(table(spark, sf, "orders"), "o_orderpriority", ["o_orderkey", "o_orderstatus", "o_custkey"])
