"""Naming and verdict queries (DEC-01..08, DEC-12, DEC-20, AGG-04, WIN-05, WIN-06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import identity as I
from ..operators import specificity as P
from .binding import HEADERS, headers, table
from .panel import wilson_sql
from .registry import query
from .taxonomy import ORGANISM_SQL, PLACE

# hits: every sentence header is a record hit of its document, with an identity and an
# aligned length derived from its position
LOCI = ("ITS", "28S", "18S", "16S")
HIT_SQL = f"""{HEADERS}, {ORGANISM_SQL},
h0 AS (SELECT doc_id, idx, header, name AS o, round(100.0 - (idx * 7 + doc_id) % 90 * 0.1, 2) AS identity, (200 + (idx * 131 + doc_id) % 1500)::INTEGER AS aligned,
  CASE WHEN idx % 3 = 0 THEN NULL ELSE 1300 END AS record_len, ['ITS', '28S', '18S', '16S'][idx % 4 + 1] AS locus FROM org),
hits AS (SELECT doc_id, idx, header, identity, aligned, record_len, locus, name, regexp_extract(name, '^(Candidatus \\S+|\\S+)', 1) AS genus,
  CASE WHEN lower(regexp_extract(name, '^(?:Candidatus \\S+|\\S+)\\s+(\\S+)', 1)) NOT IN {PLACE} THEN nullif(regexp_extract(name, '^(?:Candidatus \\S+|\\S+)\\s+(\\S+)', 1), '') END AS epithet
  FROM (SELECT *, CASE WHEN NOT regexp_matches(lower(o), '{"|".join(N.UNNAMED_TOKENS)}') THEN o END AS name FROM h0))"""


def hits(spark, sf):
    h = headers(spark, sf)
    locus = F.element_at(F.array(*map(F.lit, LOCI)), F.col("idx") % 4 + 1)
    return h.select("doc_id", "idx", "header", F.round(100.0 - (F.col("idx") * 7 + F.col("doc_id")) % 90 * 0.1, 2).alias("identity"),
                    (F.lit(200) + (F.col("idx") * 131 + F.col("doc_id")) % 1500).cast("int").alias("aligned"),
                    F.when(F.col("idx") % 3 != 0, F.lit(1300)).alias("record_len"), locus.alias("locus"))


DECIDE_SQL = """ok AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY identity DESC, aligned DESC, header) AS rn FROM hits WHERE aligned >= 250),
top AS (SELECT * FROM ok WHERE rn = 1),
sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY rn) AS k FROM ok WHERE epithet IS NOT NULL) WHERE k = 1),
pick AS (SELECT t.{kk}, CASE WHEN t.epithet IS NULL AND s.rn IS NOT NULL AND t.identity - s.identity < 0.5 THEN s.rn ELSE t.rn END AS prn
  FROM top t LEFT JOIN sp s USING ({k})),
p AS (SELECT ok.* FROM ok JOIN pick USING ({k}) WHERE rn = prn),
rv AS (SELECT {pk}, min(ok.name) AS any_rival, arg_min(ok.name, ok.rn) AS rival FROM p JOIN ok USING ({k}) WHERE ok.epithet IS NOT NULL AND ok.name <> p.name AND p.identity - ok.identity < 0.5 GROUP BY {pk}),
weak AS (SELECT {k}, max(identity) AS wi FROM hits GROUP BY ALL),
dec AS (SELECT {k}, p.name, p.genus, p.epithet, p.identity, p.aligned, CASE WHEN p.rn IS NULL THEN 'no_evidence' WHEN p.genus IS NULL THEN 'unnamed_record'
  WHEN p.identity < {ce} THEN 'below_genus' WHEN p.identity < {te} THEN 'below_species' WHEN p.epithet IS NULL THEN 'no_species_name'
  WHEN NOT (p.aligned >= {fl} OR coalesce(p.aligned >= 0.9 * p.record_len, false)) THEN 'short_alignment' WHEN rival IS NOT NULL THEN 'rival' ELSE 'species' END AS reason
  FROM weak LEFT JOIN p USING ({k}) LEFT JOIN rv USING ({k})),
named AS (SELECT {k}, CASE WHEN reason IN ('no_evidence', 'unnamed_record', 'below_genus') THEN 'cannot be named' WHEN reason = 'species' THEN name
  WHEN reason = 'rival' THEN genus || ' cf. ' || epithet ELSE genus || ' sp.' END AS name, reason,
  CASE WHEN reason NOT IN ('no_evidence', 'unnamed_record', 'below_genus') THEN genus END AS genus,
  CASE WHEN reason = 'species' THEN name END AS species, CASE WHEN reason IN ('no_evidence', 'unnamed_record', 'below_genus') THEN 'none'
  WHEN reason = 'species' THEN 'species' ELSE 'genus' END AS level, identity, aligned FROM dec)"""


def _decide(k, te, ce, fl):
    pk = ", ".join(f"p.{c}" for c in k.split(", "))
    return (DECIDE_SQL.replace("t.{kk}", ", ".join(f"t.{c}" for c in k.split(", "))).replace("{pk}", pk)
            .replace("{k}", k).replace("{te}", te).replace("{ce}", ce).replace("{fl}", fl))


@query("single_locus_level", "DEC-01 DEC-02 FLT-09",
       f"WITH {HIT_SQL}, {_decide('doc_id', '98.7', '94.5', '1200')} SELECT doc_id, name, level, reason FROM named")
def single_locus_level(spark, sf):
    d = I.locus_decision(hits(spark, sf), ["doc_id"], F.lit("SSU"))
    return d.select("doc_id", "name", "level", "reason")


TE = "CASE p.locus WHEN 'ITS' THEN 99.6 ELSE 98.7 END"
CE = "CASE p.locus WHEN 'ITS' THEN 94.3 ELSE 94.5 END"
FL = "600"


@query("locus_decisions", "DEC-02",
       f"WITH {HIT_SQL}, {_decide('doc_id, locus', TE, CE, FL)} SELECT doc_id, locus, name, level, reason FROM named")
def locus_decisions(spark, sf):
    # loci other than ITS take the default thresholds of the table
    d = I.locus_decision(hits(spark, sf), ["doc_id", "locus"], F.col("locus"))
    return d.select("doc_id", "locus", "name", "level", "reason")


MERGE_SQL = """u AS (SELECT *, CASE locus WHEN 'ITS' THEN 3 WHEN '28S' THEN 2 WHEN '18S' THEN 1 WHEN '16S' THEN 2 ELSE 0 END AS power FROM named WHERE genus IS NOT NULL),
vote AS (SELECT doc_id, genus, count(*) AS v, max(power) AS p, max(aligned) AS a FROM u GROUP BY ALL),
win AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS genera, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, p DESC, a DESC, genus) AS rn FROM vote),
m AS (SELECT u.*, w.genus AS win, genera FROM u JOIN win w ON w.doc_id = u.doc_id AND w.rn = 1),
msp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY power DESC, aligned DESC, locus DESC) AS k FROM m WHERE genus = win AND level = 'species' AND locus IN ('ITS','28S','16S','23S')) WHERE k = 1),
ns AS (SELECT doc_id, count(DISTINCT species) AS n FROM m WHERE genus = win AND level = 'species' AND locus IN ('ITS','28S','16S','23S') GROUP BY 1),
mcf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY power DESC, aligned DESC, locus DESC) AS k FROM m WHERE genus = win AND contains(name, ' cf. ') AND locus IN ('ITS','28S','16S','23S')) WHERE k = 1)
SELECT d.doc_id, CASE WHEN w.win IS NULL THEN 'cannot be named' WHEN msp.species IS NOT NULL AND n > 1 THEN w.win || ' cf. ' || string_split(msp.species, ' ')[-1]
  WHEN msp.species IS NOT NULL THEN msp.species WHEN mcf.name IS NOT NULL THEN mcf.name ELSE w.win || ' sp.' END AS name, coalesce(w.genera > 1, false) AS loci_diverge
FROM (SELECT DISTINCT doc_id FROM named) d LEFT JOIN (SELECT DISTINCT doc_id, win, genera FROM m) w USING (doc_id) LEFT JOIN msp USING (doc_id) LEFT JOIN ns USING (doc_id) LEFT JOIN mcf USING (doc_id)"""


@query("multi_locus_name", "DEC-03 DEC-23 DEC-12",
       f"WITH {HIT_SQL}, {_decide('doc_id, locus', TE, CE, FL)}, {MERGE_SQL}")
def multi_locus_name(spark, sf):
    d = I.locus_decision(hits(spark, sf), ["doc_id", "locus"], F.col("locus"))
    return I.merge_loci(d, ["doc_id"]).select("doc_id", "name", "loci_diverge")


@query("ladder_report", "DEC-04 WIN-06",
       f"""WITH {HIT_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, locus ORDER BY identity DESC, aligned DESC, header) AS rn FROM hits WHERE aligned >= 250 AND identity >= 90 AND epithet IS NOT NULL),
b AS (SELECT * FROM a WHERE rn = 1),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['ITS', '28S', '18S'], locus)) AS k FROM b WHERE locus IN ('ITS', '28S', '18S')) WHERE k = 1),
s AS (SELECT f.doc_id, arg_min(a.name, a.rn) AS runner_up, round(any_value(f.identity) - arg_min(a.identity, a.rn), 6) AS margin FROM f JOIN a ON a.doc_id = f.doc_id AND a.locus = f.locus WHERE a.name <> f.name GROUP BY 1),
g AS (SELECT f.doc_id, min(b.locus) AS stronger_locus FROM f JOIN b USING (doc_id) WHERE f.locus IN ('ITS','28S','16S','23S') AND b.locus IN ('ITS','28S','16S','23S') AND b.locus <> f.locus
  AND b.identity >= f.identity + 2.0 AND b.aligned >= 1.5 * f.aligned GROUP BY 1)
SELECT f.doc_id, f.locus, f.name, f.identity, f.aligned, runner_up, margin, stronger_locus FROM f LEFT JOIN s USING (doc_id) LEFT JOIN g USING (doc_id)""")
def ladder_report(spark, sf):
    return I.ladder_report(hits(spark, sf), ["doc_id"])


@query("kingdom_gate", "DEC-05 TAX-10",
       f"""WITH {HIT_SQL}, o AS (SELECT *, CASE WHEN contains(header, '|') AND NOT contains(header, ';') AND contains(header, 'Eukaryota') THEN
    trim(replace(string_split(header, '|')[-1], '_', ' ')) END AS outside FROM hits WHERE locus IN ('18S', '28S') AND aligned >= 250),
g AS (SELECT doc_id, locus, coalesce(max(identity) FILTER (outside IS NULL), 0) AS fungal, max(identity) FILTER (outside IS NOT NULL) AS oi FROM o GROUP BY ALL),
k AS (SELECT * FROM g WHERE oi >= 95 AND oi - fungal >= 2)
SELECT doc_id, max(oi) AS identity FROM k GROUP BY 1""")
def kingdom_gate(spark, sf):
    return I.kingdom_gate(hits(spark, sf), ["doc_id"]).select("doc_id", "identity")


@query("nt_reconciliation", "DEC-06 TAX-11",
       f"""WITH {HIT_SQL}, n AS (SELECT doc_id, idx, name, identity, lead(name) OVER (PARTITION BY doc_id ORDER BY idx) AS nt, lead(identity) OVER (PARTITION BY doc_id ORDER BY idx) AS nti,
  lead(aligned) OVER (PARTITION BY doc_id ORDER BY idx) AS ntb FROM hits WHERE epithet IS NOT NULL)
SELECT doc_id, idx, CASE WHEN nt IS NOT NULL AND nt <> name AND nti >= 98.7 AND nti >= identity - 0.5 AND ntb >= 250
  THEN regexp_extract(name, '^(.*) [^ ]+$', 1) || ' cf. ' || string_split(name, ' ')[-1] ELSE name END AS name FROM n""")
def nt_reconciliation(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("doc_id").orderBy("idx")
    h = I.named_hits(hits(spark, sf)).where("epithet IS NOT NULL")
    h = h.select("doc_id", "idx", "name", "identity", F.lead("name").over(w).alias("nt"), F.lead("identity").over(w).alias("nti"),
                 F.lead("aligned").over(w).alias("ntb"), F.lit("species").alias("nt_rank"), F.lit(98.7).alias("floor"))
    return h.select("doc_id", "idx", I.nt_reconcile("name", "identity", "nt", "nt_rank", "nti", "ntb", "floor").alias("name"))


@query("database_agreement", "DEC-07 AGG-24",
       f"""WITH {HIT_SQL}, b AS (SELECT doc_id, locus, genus, header FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, locus ORDER BY identity DESC, header) AS rn FROM hits) WHERE rn = 1),
v AS (SELECT doc_id, genus, count(DISTINCT locus) AS databases, count(DISTINCT nullif(regexp_extract(header, '^([A-Z]{{1,2}}_?[0-9]{{5,8}})', 1), '')) AS acc FROM b WHERE genus IS NOT NULL GROUP BY ALL),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY databases DESC, genus) AS rn FROM v) WHERE rn = 1)
SELECT doc_id, w.genus, coalesce(databases, 0) AS databases, CASE WHEN databases >= 2 THEN 'CONFIRMED' WHEN databases = 1 THEN 'NOT CONFIRMED (single source)' ELSE 'NOT CONFIRMED' END AS verdict,
  coalesce(databases >= 2 AND acc = 1, false) AS same_record, CASE WHEN coalesce(databases, 0) < 2 THEN 'CANNOT' WHEN lower(w.genus) = 'the' THEN 'CONFIRMED' ELSE 'CORRECT IT' END AS claim
FROM (SELECT DISTINCT doc_id FROM b) LEFT JOIN w USING (doc_id)""")
def database_agreement(spark, sf):
    h = I.named_hits(hits(spark, sf)).withColumn("accession", N.accession("header"))
    b = h.groupBy("doc_id", F.col("locus").alias("database")).agg(F.min(F.struct(
        (-F.col("identity")).alias("ni"), F.col("header"), F.col("genus"), F.col("accession"))).alias("m"))
    v = I.database_verdict(b.select("doc_id", "database", "m.genus", "m.accession"), ["doc_id"])
    v = v.withColumn("same_record", F.coalesce("same_record", F.lit(False)))
    return I.claim_verdict(v.withColumn("claimed", F.lit("the")), "claimed").drop("claimed")


@query("nearest_organisms", "WIN-05",
       f"""WITH {HIT_SQL}, b AS (SELECT doc_id, name, max(identity) AS identity FROM hits WHERE name IS NOT NULL GROUP BY ALL)
SELECT doc_id, name, identity, rank FROM (SELECT b.*, row_number() OVER (PARTITION BY doc_id ORDER BY identity DESC, (SELECT max(aligned) FROM hits h WHERE h.doc_id = b.doc_id AND h.name = b.name AND h.identity = b.identity) DESC, name) AS rank FROM b) WHERE rank <= 5""")
def nearest_organisms(spark, sf):
    return I.nearest_organisms(I.named_hits(hits(spark, sf)), ["doc_id"]).drop("aligned")


@query("population_split", "AGG-04 DEC-20",
       f"""WITH {HIT_SQL}, s AS (SELECT source AS bin, genus, CASE WHEN epithet IS NOT NULL THEN genus || ' ' || epithet END AS species FROM hits JOIN documents USING (doc_id)
  WHERE identity >= 94.3 AND genus IS NOT NULL)
SELECT bin, genus, NULL AS species, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT bin, genus, species, count(*) FROM s WHERE species IS NOT NULL GROUP BY ALL""")
def population_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("bin"))
    return I.populations(I.named_hits(hits(spark, sf)).join(d, "doc_id"), "bin", 94.3)


@query("sub_populations", "DEC-20",
       f"""WITH {HIT_SQL}, h AS (SELECT source AS bin, genus, CASE WHEN epithet IS NOT NULL THEN genus || ' ' || epithet END AS species FROM hits JOIN documents USING (doc_id) WHERE identity >= 94.3 AND genus IS NOT NULL),
g AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY n DESC, genus) AS rank, sum(n) OVER (PARTITION BY bin) AS total FROM (SELECT bin, genus, count(*) AS n FROM h GROUP BY ALL)),
s AS (SELECT h.bin, h.genus, species, count(*) AS n FROM h JOIN g ON g.bin = h.bin AND g.genus = h.genus AND rank = 1 WHERE species IS NOT NULL GROUP BY ALL HAVING count(*) >= 2 AND count(*) / any_value(g.n) >= 0.02)
SELECT bin, genus, species, n, 'species group' AS origin FROM s WHERE bin IN (SELECT bin FROM s GROUP BY bin HAVING count(*) >= 2)
UNION ALL SELECT bin, genus, NULL, n, 'second genus' FROM g WHERE rank = 2 AND n >= 2 AND n / total >= 0.02""")
def sub_populations(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("bin"))
    return I.sub_populations(I.populations(I.named_hits(hits(spark, sf)).join(d, "doc_id"), "bin", 94.3), "bin", 2, 0.02)


# ---- specificity layers -------------------------------------------------------------------

LAYERS = """v AS (SELECT l_orderkey AS target, CASE WHEN max(l_linenumber) >= 6 THEN NULL ELSE count(*) FILTER (l_returnflag = 'R' AND l_discount > 0.08) END AS local_hits,
  CASE WHEN count(*) % 4 = 0 THEN NULL ELSE count(*) FILTER (l_tax > 0.07) END AS thermo_hits,
  CASE WHEN min(l_suppkey) % 3 = 0 THEN NULL ELSE count(*) FILTER (l_quantity > 49) END AS network_hits,
  count(*) FILTER (l_quantity < 2) AS organelle FROM lineitem GROUP BY 1)"""


def _layers(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("target")).agg(
        F.when(F.max("l_linenumber") < 6, F.count(F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08), 1))).alias("local_hits"),
        F.when(F.count(F.lit(1)) % 4 != 0, F.count(F.when(F.col("l_tax") > 0.07, 1))).alias("thermo_hits"),
        F.when(F.min("l_suppkey") % 3 != 0, F.count(F.when(F.col("l_quantity") > 49, 1))).alias("network_hits"),
        F.count(F.when(F.col("l_quantity") < 2, 1)).alias("organelle"))


@query("layer_merge", "DEC-08",
       f"""WITH {LAYERS}, c AS (SELECT *, CASE WHEN local_hits IS NULL THEN 'UNKNOWN' WHEN local_hits <= 0 THEN 'CLEAN' ELSE 'RISKY' END AS a,
  CASE WHEN thermo_hits IS NULL THEN 'UNKNOWN' WHEN thermo_hits <= 0 THEN 'CLEAN' ELSE 'RISKY' END AS b,
  CASE WHEN network_hits IS NULL THEN 'UNKNOWN' WHEN network_hits <= 0 THEN 'CLEAN' ELSE 'RISKY' END AS c FROM v),
n AS (SELECT *, (a <> 'UNKNOWN')::INT + (b <> 'UNKNOWN')::INT + (c <> 'UNKNOWN')::INT AS known, (a = 'RISKY')::INT + (b = 'RISKY')::INT + (c = 'RISKY')::INT AS risky FROM c)
SELECT target, a AS local, b AS thermo, c AS network, CASE WHEN a = 'RISKY' AND b = 'CLEAN' AND c <> 'RISKY' THEN 'REVIEW' WHEN risky > 0 AND risky < known THEN 'CONTRADICTORY'
  WHEN known = 0 THEN 'INCOMPLETE' WHEN risky > 0 THEN 'RISKY' WHEN organelle > 0 THEN 'REVIEW' WHEN known = 3 THEN 'CERTAIN' WHEN known = 2 THEN 'CONDITIONAL' ELSE 'INCOMPLETE' END AS category FROM n""")
def layer_merge(spark, sf):
    return P.merge_layers(_layers(spark, sf)).select("target", "local", "thermo", "network", "category")


@query("end_mismatch_penalty", "THR-07",
       """WITH p AS (SELECT l_orderkey, list_distinct(list(1 + (l_partkey + l_linenumber) % 10)) AS pos, min(l_returnflag) AS pb, max(l_linestatus) AS tb FROM lineitem GROUP BY 1),
x AS (SELECT l_orderkey, len(list_filter(pos, lambda i: i <= 4)) AS last4, CASE WHEN list_contains(pos, 1) THEN CASE WHEN pb = 'A' AND tb = 'O' THEN 4.3 ELSE 6.6 END ELSE 0 END
  + CASE WHEN list_contains(pos, 2) THEN 10 ELSE 0 END + 3.3 * len(list_filter(pos, lambda i: i BETWEEN 3 AND 8)) AS total FROM p)
SELECT l_orderkey, round(CASE WHEN last4 >= 3 THEN 15.0 ELSE total END, 6) AS penalty FROM x""")
def end_mismatch_penalty(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set(((F.col("l_partkey") + F.col("l_linenumber")) % 10 + 1).cast("int")).alias("pos"),
        F.min("l_returnflag").alias("pb"), F.max("l_linestatus").alias("tb"))
    # A with O stands for an A:A terminal pair; any other combination is left unknown
    terminal = F.when((F.col("pb") == "A") & (F.col("tb") == "O"), F.lit("AA"))
    return g.select("l_orderkey", F.round(P.end_penalty("pos", terminal), 6).alias("penalty"))


@query("leak_aware_verdict", "DEC-22",
       """WITH c AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS n, count(*) FILTER (l_tax > 0.06) AS lk, count(*) FILTER (l_quantity > 10) AS ln FROM lineitem GROUP BY 1),
w AS (SELECT *, {low} AS low, CASE WHEN ln >= 20 THEN least({up}, 0.25) ELSE 0.0 END AS leak FROM c)
SELECT l_suppkey, round(low, 8) AS low, round(greatest(0.01, leak), 8) AS limit_used, low > greatest(0.01, leak) AS real_competitor FROM w""".replace(
           "{low}", wilson_sql("k", "n", False)).replace(
           "{up}", wilson_sql("lk", "ln", True)))
def leak_aware_verdict(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("k"), F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("l_tax") > 0.06, 1)).alias("leak_k"), F.count(F.when(F.col("l_quantity") > 10, 1)).alias("leak_n"))
    v = P.leak_aware(c, cap=0.01, leak_cap=0.25, min_reads=20)
    return v.select("l_suppkey", F.round("low", 8).alias("low"), F.round("limit_used", 8).alias("limit_used"), "real_competitor")


@query("coverage_of_database", "DEC-21",
       """WITH m AS (SELECT c_mktsegment AS class, max(o_totalprice) AS longest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT class, longest, CASE WHEN longest IS NULL THEN 'NOT MEASURED' WHEN longest < 499000 THEN 'NOT COVERED' ELSE 'COVERED' END AS coverage FROM m""")
def coverage_of_database(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    j = table(spark, sf, "customer").join(o, "c_custkey", "left").groupBy(F.col("c_mktsegment").alias("class")).agg(F.max("o_totalprice").alias("longest"))
    return j.withColumn("coverage", P.database_coverage("longest", 499000))


@query("cross_decision_two_denominators", "DEC-11",
       """WITH c AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS k, count(*) AS raw_n, count(*) FILTER (l_quantity > 5) AS cov_n,
  count(*) FILTER (l_linestatus = 'O' AND l_tax > 0.07) AS ck FROM lineitem GROUP BY 1),
w AS (SELECT l_suppkey, {t1} AS t_raw, {t2} AS t_cov, {r1} AS r_raw, {r2} AS r_cov FROM (SELECT *, greatest(cov_n, k) AS kn, greatest(cov_n, ck) AS cn FROM c)),
l AS (SELECT l_suppkey, CASE WHEN r_raw <= 0.02 THEN 0 WHEN r_raw <= 0.10 AND t_raw >= 10 * r_raw THEN 1 ELSE 2 END AS raw,
  CASE WHEN r_cov <= 0.02 THEN 0 WHEN r_cov <= 0.10 AND t_cov >= 10 * r_cov THEN 1 ELSE 2 END AS cov FROM w)
SELECT l_suppkey, ['NONE', 'BORDERLINE', 'PRESENT'][greatest(raw, cov) + 1] AS cross_reaction, raw <> cov AS denominators_diverge FROM l""".replace(
           "{t1}", wilson_sql("k", "raw_n", False)).replace(
           "{t2}", wilson_sql("k", "kn", False)).replace(
           "{r1}", wilson_sql("ck", "raw_n", False)).replace(
           "{r2}", wilson_sql("ck", "cn", False)))
def cross_decision_two_denominators(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("k"), F.count(F.lit(1)).alias("raw_n"),
        F.count(F.when(F.col("l_quantity") > 5, 1)).alias("cov_n"),
        F.count(F.when((F.col("l_linestatus") == "O") & (F.col("l_tax") > 0.07), 1)).alias("ck"))
    return P.two_denominators(c).select("l_suppkey", "cross_reaction", "denominators_diverge")


@query("problem_reasons", "DEC-13",
       """SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_returnflag = 'R' THEN 'G' END, CASE WHEN l_linestatus = 'F' THEN 'K' END, CASE WHEN l_tax = 0 THEN 'C' END,
  CASE WHEN l_discount * 100 < 8 THEN 'A' END, CASE WHEN l_quantity * 6 > 250 THEN 'U_long' WHEN l_quantity * 6 > 150 THEN 'U_over_ideal' END, CASE WHEN l_suppkey % 7 = 0 THEN 'P' END], lambda x: x IS NOT NULL), ',') AS reasons FROM lineitem""")
def problem_reasons(spark, sf):
    li = table(spark, sf, "lineitem")
    r = P.problem_reasons(geometry_violated=F.col("l_returnflag") == "R", provisional=F.col("l_linestatus") == "F", dropped=F.col("l_tax") == 0,
                          separation=F.col("l_discount") * 100, product_bp=F.col("l_quantity") * 6, gel_clash=F.col("l_suppkey") % 7 == 0)
    return li.select("l_orderkey", "l_linenumber", F.concat_ws(",", r).alias("reasons"))


@query("published_deviation", "DEC-24",
       """SELECT o_custkey, CASE WHEN count(*) FILTER (o_totalprice / 20000 BETWEEN 0.34 * 8 AND 3 * 8) > 0 THEN 'OK' ELSE 'DEVIATES' END AS warning FROM orders GROUP BY 1""")
def published_deviation(spark, sf):
    o = table(spark, sf, "orders").withColumn("fold", F.col("o_totalprice") / 20000)
    return o.groupBy("o_custkey").agg(F.when(F.coalesce(F.bool_or(P.near_published("fold", F.lit(8))), F.lit(False)), "OK").otherwise("DEVIATES").alias("warning"))


@query("order_list", "DEC-27",
       """SELECT o_orderkey, o_orderpriority AS class, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'other_class' WHEN o_orderstatus = 'P' THEN 'no_sequence' ELSE 'ordered' END AS status FROM orders""")
def order_list(spark, sf):
    o = table(spark, sf, "orders").withColumn("sequence", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return P.order_list(o, "o_orderpriority", ["1-URGENT", "2-HIGH"], "sequence").select("o_orderkey", F.col("o_orderpriority").alias("class"), "status")


@query("search_verdict", "DEC-26",
       """WITH c AS (SELECT o_custkey, max(o_totalprice / 40000) FILTER (o_orderstatus <> 'P') AS plain, max(o_totalprice / 40000) FILTER (o_orderstatus = 'P') AS arms, count(*) AS n,
  min(o_orderkey) AS any_order FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN n IS NULL THEN 'NO CANDIDATE' WHEN plain IS NULL AND arms IS NULL THEN 'NONE MEASURABLE' WHEN plain >= 8 THEN 'SOLVED' WHEN arms >= 8 THEN 'SOLVED WITH ARMS' ELSE 'NOT SOLVED' END AS verdict,
  round(greatest(plain, arms), 8) AS best FROM customer LEFT JOIN c ON o_custkey = c_custkey""")
def search_verdict(spark, sf):
    o = table(spark, sf, "orders").withColumn("fold", F.col("o_totalprice") / 40000).withColumn("arms", F.col("o_orderstatus") == "P")
    t = table(spark, sf, "customer").select("c_custkey")
    v = P.search_verdict(t, o.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")
    return v.select("c_custkey", "verdict", F.round("best", 8).alias("best"))
