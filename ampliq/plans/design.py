"""Primer design queries over reference backbones."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import params as P
from ..functions import predicates as X
from ..functions import seq as S
from ..functions import thermo as T
from ..operators import design as D
from ..operators import funnel as FU
from ..operators import group_design as G
from ..operators import search as Q
from ..operators import sites
from .binding import FAMILIES, PANEL, READS, REFS, families, panel, reads, references, sql_kmers, sql_rc, table
from .panel import BASE
from .registry import query
from .scalars import WIN_SQL

_STACK_ROWS = ", ".join(f"('{k}', {h}, {s})" for k, (h, s) in T.ALL_STACKS.items())
_R = P.Reaction()
_SALT = repr(0.368 * math.log(T.monovalent_equivalent(_R)))
TM_SQL = f"""nn(d, h, s) AS (VALUES {_STACK_ROWS}),
ol AS (SELECT DISTINCT oligo FROM wins WHERE NOT regexp_matches(oligo, 'AAAA|CCCC|GGGG|TTTT')),
st AS (SELECT oligo, sum(h) AS h, sum(s) AS s FROM (SELECT oligo, substr(oligo, unnest(range(1, length(oligo)))::INTEGER, 2) AS d FROM ol) JOIN nn USING (d) GROUP BY 1),
tm AS (SELECT oligo, round(1000.0 * (h + e1 + e2) / (s + f1 + f2 + CASE WHEN pal THEN -1.4 ELSE 0 END + {_SALT} * (length(oligo) - 1) + 1.987 * ln(CASE WHEN pal THEN 5e-8 ELSE 1.25e-8 END)) - 273.15, 2) AS tm,
  round(100.0 * length(regexp_replace(oligo, '[^GC]', '', 'g')) / length(oligo), 1) AS gc FROM (SELECT *, reverse(translate(oligo, 'ACGT', 'TGCA')) = oligo AS pal,
  CASE WHEN left(oligo, 1) IN ('G', 'C') THEN 0.1 ELSE 2.3 END AS e1, CASE WHEN right(oligo, 1) IN ('G', 'C') THEN 0.1 ELSE 2.3 END AS e2,
  CASE WHEN left(oligo, 1) IN ('G', 'C') THEN -2.8 ELSE 4.1 END AS f1, CASE WHEN right(oligo, 1) IN ('G', 'C') THEN -2.8 ELSE 4.1 END AS f2 FROM st)),
cand AS (SELECT ref_id, pos, len, dir, w.oligo, tm, gc FROM wins w JOIN tm ON tm.oligo = w.oligo)"""


def backbones(spark, sf):
    return references(spark, sf).select(F.col("ref_id").alias("target"), "seq")


def _cands(spark, sf):
    return D.candidates(backbones(spark, sf))


@query("oligo_temperatures", "THR-01 THR-05", f"WITH {REFS}, {WIN_SQL}, {TM_SQL} SELECT ref_id AS target, pos, len, dir, tm, gc FROM cand")
def oligo_temperatures(spark, sf):
    return _cands(spark, sf).select("target", "pos", "len", "dir", "tm", "gc")


# the divalent correction written out from the reaction's concentrations
TM2_SQL = f"""c0 AS (SELECT {_R.monovalent_mm / 1000.0!r}::DOUBLE AS mon, {_R.dntp_mm / 1000.0!r}::DOUBLE AS dntp, {_R.divalent_mm / 1000.0!r}::DOUBLE AS mg0),
c1 AS (SELECT mon, CASE WHEN dntp > 0 THEN (-(30000.0 * dntp - 30000.0 * mg0 + 1.0) + sqrt(pow(30000.0 * dntp - 30000.0 * mg0 + 1.0, 2) + 120000.0 * mg0)) / 60000.0 ELSE mg0 END AS mg FROM c0),
c2 AS (SELECT mon, mg, sqrt(mg) / mon AS ratio, ln(mon) AS lm, ln(mg) AS lg FROM c1),
c3 AS (SELECT ratio, lm, lg, CASE WHEN ratio >= 0.22 AND ratio < 6 THEN 0.843 - 0.352 * sqrt(mon) * lm ELSE 1 END AS ka, CASE WHEN ratio >= 0.22 AND ratio < 6 THEN 1.279 - 0.00403 * lm - 0.00803 * lm * lm ELSE 1 END AS kd,
  CASE WHEN ratio >= 0.22 AND ratio < 6 THEN 0.486 - 0.258 * lm + 0.00525 * pow(lm, 3) ELSE 1 END AS kg FROM c2),
e0 AS (SELECT oligo, h, s, length(oligo) AS n, length(regexp_replace(oligo, '[^GC]', '', 'g')) / length(oligo) AS g, CASE WHEN left(oligo, 1) IN ('G', 'C') THEN 0.1 ELSE 2.3 END + CASE WHEN right(oligo, 1) IN ('G', 'C') THEN 0.1 ELSE 2.3 END AS eh,
  CASE WHEN left(oligo, 1) IN ('G', 'C') THEN -2.8 ELSE 4.1 END + CASE WHEN right(oligo, 1) IN ('G', 'C') THEN -2.8 ELSE 4.1 END + CASE WHEN reverse(translate(oligo, 'ACGT', 'TGCA')) = oligo THEN -1.4 ELSE 0 END AS es FROM st),
tm2 AS (SELECT oligo, round(1.0 / ((s + es + 1.987 * ln({_R.oligo_nm!r} * 1e-9)) / (1000.0 * (h + eh)) + CASE WHEN ratio < 0.22 THEN (4.29 * g - 3.95) * 1e-5 * lm + 9.40e-6 * lm * lm
  ELSE (3.92 * ka - 0.911 * lg + g * (6.26 + 1.42 * kd * lg) + (-48.2 + 52.5 * lg + 8.31 * kg * lg * lg) / (2.0 * (n - 1))) * 1e-5 END) - 273.15, 2) AS tm2 FROM e0, c3)"""


@query("oligo_temperatures_divalent", "THR-02", f"WITH {REFS}, {WIN_SQL}, {TM_SQL}, {TM2_SQL} SELECT ref_id AS target, pos, len, dir, tm2 FROM cand JOIN tm2 USING (oligo)")
def oligo_temperatures_divalent(spark, sf):
    return _cands(spark, sf).select("target", "pos", "len", "dir", F.round(T.melting_temperature_divalent("oligo"), 2).alias("tm2"))


@query("tm_agreement", "THR-03",
       f"""WITH {REFS}, {WIN_SQL}, {TM_SQL}, {TM2_SQL}, d AS (SELECT ref_id AS target, round(tm - tm2, 6) AS diff FROM cand JOIN tm2 USING (oligo)),
m AS (SELECT target, median(diff) AS o, stddev_pop(diff) AS sd FROM d GROUP BY 1)
SELECT target, count(*) AS kept, max(round(o, 3)) AS "offset" FROM d JOIN m USING (target) WHERE abs(diff - o) <= round(greatest(0.1, 2.0 * sd), 9) GROUP BY 1""")
def tm_agreement(spark, sf):
    c = _cands(spark, sf).withColumn("tm2", F.round(T.melting_temperature_divalent("oligo"), 2))
    k = D.tm_agreement(c, ["target"])
    return k.groupBy("target").agg(F.count(F.lit(1)).alias("kept"), F.max(F.round("offset", 3)).alias("offset"))


@query("oligo_violations", "FLT-01",
       f"""WITH {REFS}, {WIN_SQL}, {TM_SQL} SELECT ref_id AS target, dir, array_to_string(list_filter([CASE WHEN gc NOT BETWEEN 40 AND 60 THEN 'gc' END,
  CASE WHEN tm NOT BETWEEN 58 AND 62 THEN 'tm' END, CASE WHEN right(oligo, 1) NOT IN ('G', 'C') THEN 'end_not_gc' END,
  CASE WHEN length(regexp_replace(right(oligo, 5), '[^GC]', '', 'g')) > 3 THEN 'last5_gc' END], lambda x: x IS NOT NULL), ',') AS violations, count(*) AS n FROM cand GROUP BY ALL""")
def oligo_violations(spark, sf):
    c = _cands(spark, sf).withColumn("violations", F.concat_ws(",", X.violations("oligo", "gc", "tm")))
    return c.groupBy("target", "dir", "violations").agg(F.count(F.lit(1)).alias("n"))


_CELLS = ", ".join(f"({pi}, {g[0]}, {g[1]}, {t[0]}, {t[1]}, {str(e).lower()}, {str(s).lower()})" for pi, (g, t, e, s) in enumerate(D.PRIMER_CELLS))
_PRODS = ", ".join(f"({i}, {lo}, {hi})" for i, (lo, hi) in enumerate(P.GRID_PRODUCT))
MASK_SQL = f"""pc(pi, g1, g2, t1, t2, eg, l5) AS (VALUES {_CELLS}), uc(ui, b1, b2) AS (VALUES {_PRODS}),
om AS (SELECT oligo, sum(1::BIGINT << pi)::BIGINT AS pm FROM (SELECT DISTINCT oligo, tm, gc FROM cand) JOIN pc ON gc BETWEEN g1 AND g2 AND tm BETWEEN t1 AND t2
  AND (NOT eg OR right(oligo, 1) IN ('G', 'C')) AND (NOT l5 OR length(regexp_replace(right(oligo, 5), '[^GC]', '', 'g')) <= 3) GROUP BY 1),
cm AS (SELECT cand.*, pm FROM cand JOIN om USING (oligo)),
pairs AS (SELECT f.ref_id AS target, f.pos AS f_pos, f.oligo AS fwd, f.tm AS f_tm, r.pos + r.len AS r_end, r.oligo AS rev, r.tm AS r_tm, r.pos + r.len - f.pos AS bp, f.pm & r.pm AS pm
  FROM cm f JOIN cm r ON f.ref_id = r.ref_id AND f.dir = 'F' AND r.dir = 'R' AND r.pos + r.len - f.pos BETWEEN 60 AND 400 AND r.pos >= f.pos + f.len WHERE f.pm & r.pm <> 0)"""


def _pairs(spark, sf):
    return D.pair_band(_cands(spark, sf))


@query("pair_band", "JOIN-12 THR-06",
       f"""WITH {REFS}, {WIN_SQL}, {TM_SQL}, {MASK_SQL} SELECT target, bp, CASE WHEN bp BETWEEN 60 AND 150 THEN 'ideal' WHEN bp <= 250 THEN 'acceptable' ELSE 'not_advised' END AS product_class,
  count(*) AS n, round(min(round(abs(f_tm - r_tm), 2)), 2) AS best_dtm, count(*) FILTER (round(least(f_tm, r_tm) - 3.0, 2) >= 59.5) AS fits_60 FROM pairs GROUP BY ALL""")
def pair_band(spark, sf):
    p = _pairs(spark, sf).withColumn("m", T.pair_measures("f_tm", "r_tm", "bp"))
    return p.groupBy("target", F.col("bp").cast("long").alias("bp"), F.col("m.product_class").alias("product_class")).agg(
        F.count(F.lit(1)).alias("n"), F.min("m.dtm").alias("best_dtm"), F.count(F.when(F.col("m.fits_60"), 1)).alias("fits_60"))


@query("grid_144", "AGG-09 FLT-03",
       f"""WITH {REFS}, {WIN_SQL}, {TM_SQL}, {MASK_SQL} SELECT target, pi AS primer_bit, ui AS product_bit, count(*) AS survivors FROM pairs
JOIN pc ON (pm >> pi) & 1 = 1 JOIN uc ON bp BETWEEN b1 AND b2 GROUP BY ALL""")
def grid_144(spark, sf):
    return D.grid_counts(_pairs(spark, sf)).drop("strictness")


_ORDER = ", ".join(f"({s}, {pi}, {ui}, {i})" for i, (s, pi, ui) in enumerate(sorted(
    (D.strictness(c, ui), pi, ui) for pi, c in enumerate(D.PRIMER_CELLS) for ui in range(len(P.GRID_PRODUCT)))))


@query("cell_representatives", "AGG-10",
       f"""WITH {REFS}, {WIN_SQL}, {TM_SQL}, {MASK_SQL}, co(st, pi, ui, ord) AS (VALUES {_ORDER}),
s AS (SELECT p.target, f_pos, r_end, fwd, rev, bp, min(ord) AS ord FROM pairs p JOIN co ON (pm >> co.pi) & 1 = 1 JOIN uc ON uc.ui = co.ui AND bp BETWEEN b1 AND b2 GROUP BY ALL),
r AS (SELECT target, pi * 10 + ui AS cell, st AS strictness, fwd, rev, bp, row_number() OVER (PARTITION BY target, pi * 10 + ui ORDER BY abs(bp - 105), f_pos, r_end, fwd, rev) AS rank FROM s JOIN co USING (ord))
SELECT * FROM r WHERE rank <= 6""")
def cell_representatives(spark, sf):
    r = D.cell_representatives(_pairs(spark, sf))
    return r.select("target", "cell", "strictness", "fwd", "rev", F.col("bp").cast("long").alias("bp"), "rank")


@query("round_robin_pick", "WIN-02 OPT-01",
       f"""WITH {REFS}, {WIN_SQL}, {TM_SQL}, {MASK_SQL}, co(st, pi, ui, ord) AS (VALUES {_ORDER}),
s AS (SELECT p.target, f_pos, r_end, fwd, rev, bp, f_tm, r_tm, min(ord) AS ord FROM pairs p JOIN co ON (pm >> co.pi) & 1 = 1 JOIN uc ON uc.ui = co.ui AND bp BETWEEN b1 AND b2 GROUP BY ALL),
r AS (SELECT target, pi * 10 + ui AS cell, st AS strictness, fwd, rev, bp, row_number() OVER (PARTITION BY target, pi * 10 + ui ORDER BY abs(bp - 105), round(abs(f_tm - r_tm), 6), f_pos, r_end, fwd, rev) AS turn FROM s JOIN co USING (ord)),
k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY turn, strictness, cell) AS pick FROM r)
SELECT target, cell, fwd, rev, pick FROM k WHERE pick <= 12""")
def round_robin_pick(spark, sf):
    # every pair of every cell takes part: the representatives of a report would leave some out
    r = D.with_strictest_cell(_pairs(spark, sf)).where("strictness IS NOT NULL").withColumn("cell", F.col("pi") * 10 + F.col("ui"))
    order = [F.abs(F.col("bp") - P.REPRESENTATIVE_BP), F.round(F.abs(F.col("f_tm") - F.col("r_tm")), 6), F.col("f_pos"), F.col("r_end"), F.col("fwd"), F.col("rev")]
    return D.round_robin(r, "target", "cell", "strictness", order, 12).select("target", "cell", "fwd", "rev", "pick")


@query("stratified_pick", "WIN-03",
       f"""WITH {REFS}, {WIN_SQL}, {TM_SQL}, x AS (SELECT *, min(pos) OVER (PARTITION BY ref_id) AS lo, max(pos) OVER (PARTITION BY ref_id) AS hi FROM cand WHERE dir = 'F'),
s AS (SELECT *, floor((pos - lo) * 8 / (hi - lo + 1))::BIGINT AS slice FROM x)
SELECT ref_id AS target, slice, pos, oligo FROM (SELECT *, row_number() OVER (PARTITION BY ref_id, slice ORDER BY abs(tm - 60), pos, oligo) AS rn FROM s) WHERE rn = 1""")
def stratified_pick(spark, sf):
    c = _cands(spark, sf).where("dir = 'F'")
    s = D.stratified_pick(c, "target", "pos", 8, [F.abs(F.col("tm") - 60), F.col("pos"), F.col("oligo")])
    return s.select("target", "slice", "pos", "oligo")


@query("candidate_order", "WIN-01",
       """WITH c AS (SELECT o_custkey AS target, 'P' || o_orderkey AS pair, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE left(o_orderpriority, 1)::INT END AS coverage,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE round(o_totalprice / 50000) END AS fold_covered, o_totalprice AS fold FROM orders)
SELECT target, pair, row_number() OVER (PARTITION BY target ORDER BY coverage DESC NULLS LAST, fold_covered DESC NULLS LAST, fold DESC NULLS LAST, pair) AS rank FROM c""")
def candidate_order(spark, sf):
    o = table(spark, sf, "orders")
    c = o.select(F.col("o_custkey").alias("target"), F.concat(F.lit("P"), "o_orderkey").alias("pair"),
                 F.when(F.col("o_orderpriority") != "5-LOW", F.left("o_orderpriority", F.lit(1)).cast("int")).alias("coverage"),
                 F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") / 50000)).alias("fold_covered"), F.col("o_totalprice").alias("fold"))
    return D.candidate_order(c, "target").select("target", "pair", "rank")


@query("arms_variants", "DEC-18",
       f"""WITH {REFS}, {PANEL}, b(b) AS (VALUES ('A'), ('C'), ('G'), ('T')), v AS (SELECT pair, fwd, x.b AS b3, y.b AS b2, substr(fwd, 18, 1) AS o3, substr(fwd, 19, 1) AS o2 FROM panel CROSS JOIN b x CROSS JOIN b y)
SELECT pair, left(fwd, 17) || b3 || b2 || right(fwd, 1) AS variant, concat_ws(' ', CASE WHEN b3 <> o3 THEN '-3:' || o3 || '>' || b3 END, CASE WHEN b2 <> o2 THEN '-2:' || o2 || '>' || b2 END) AS label
FROM v WHERE b3 <> o3 OR b2 <> o2""")
def arms_variants(spark, sf):
    p = panel(spark, sf).select("pair", F.col("fwd").alias("oligo"))
    return D.arms_variants(p).select("pair", "variant", "label")


@query("discriminating_base", "DEC-17",
       f"""WITH {REFS}, {PANEL}, o AS (SELECT ref_id, seq FROM refs UNION ALL SELECT ref_id, {sql_rc('seq')} FROM refs),
h AS (SELECT pair, CASE WHEN ref_id % 2 = 0 THEN 'member' ELSE 'competitor' END AS role, hamming(substr(seq, i, 20), fwd) AS mm, substr(seq, i + 19, 1) = right(fwd, 1) AS exact
  FROM (SELECT *, unnest(range(1, length(seq) - 18)) AS i FROM o) CROSS JOIN panel WHERE hamming(substr(seq, i, 20), fwd) <= 4),
g AS (SELECT pair, min(mm) FILTER (role = 'member' AND exact) AS member, min(mm) FILTER (role = 'competitor' AND exact) AS rival_exact, min(mm) FILTER (role = 'competitor') AS rival_any FROM h GROUP BY 1)
SELECT *, coalesce(member <= 1 AND rival_any IS NOT NULL AND (rival_exact IS NULL OR rival_exact > rival_any), false) AS discriminating FROM g""")
def discriminating_base(spark, sf):
    refs = references(spark, sf).select(F.col("ref_id").alias("read_id"), "seq")
    p = panel(spark, sf).select("pair", "fwd", F.col("fwd").alias("rev"))
    s = sites.scan_sites(refs, sites.patterns(p).where("strand = '+'"), 4, exact_tail=0)
    # the 3' base of the oligo: the last base of a forward site, the first of a reverse one
    end = F.when(F.col("side") == "L", F.substring(F.col("seq"), F.col("start") + F.col("site_len"), F.lit(1))).otherwise(
        S.revcomp(F.substring(F.col("seq"), F.col("start") + 1, F.lit(1))))
    b = s.join(refs, "read_id").join(p.select("pair", "fwd"), "pair").select(
        "pair", F.when(F.col("read_id") % 2 == 0, "member").otherwise("competitor").alias("role"), (end == F.right("fwd", F.lit(1))).alias("exact"), F.col("mm").cast("long").alias("mm"))
    return D.discriminating_base(b, "pair")


@query("degenerate_primers", "DEC-19",
       f"""{BASE}, m AS (SELECT pair, fwd, CASE strand WHEN '+' THEN substr(seq, start + 1, 20) ELSE {sql_rc('substr(seq, start + 1, 20)')} END AS site FROM sites JOIN reads USING (read_id) JOIN panel USING (pair)
  WHERE (side = 'L' AND strand = '+') OR (side = 'R' AND strand = '-')),
c AS (SELECT pair, fwd, k, substr(site, k + 1, 1) AS base, count(*) AS n FROM (SELECT *, unnest(range(0, 17)) AS k FROM m) GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair, k ORDER BY n DESC, base) AS rn FROM c WHERE base <> substr(fwd, k + 1, 1)) WHERE rn = 1),
u AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY n DESC, k DESC) AS o FROM t),
w AS (SELECT pair, k, base FROM u WHERE o <= 2),
ch AS (SELECT p.pair, i, coalesce(CASE WHEN w.base IS NULL THEN NULL WHEN least(w.base, substr(p.fwd, i + 1, 1)) || greatest(w.base, substr(p.fwd, i + 1, 1)) = 'AG' THEN 'R'
  WHEN least(w.base, substr(p.fwd, i + 1, 1)) || greatest(w.base, substr(p.fwd, i + 1, 1)) = 'CT' THEN 'Y' WHEN least(w.base, substr(p.fwd, i + 1, 1)) || greatest(w.base, substr(p.fwd, i + 1, 1)) = 'CG' THEN 'S'
  WHEN least(w.base, substr(p.fwd, i + 1, 1)) || greatest(w.base, substr(p.fwd, i + 1, 1)) = 'AT' THEN 'W' WHEN least(w.base, substr(p.fwd, i + 1, 1)) || greatest(w.base, substr(p.fwd, i + 1, 1)) = 'GT' THEN 'K' ELSE 'M' END,
  substr(p.fwd, i + 1, 1)) AS ch FROM (SELECT DISTINCT pair, fwd FROM m) p CROSS JOIN (SELECT unnest(range(0, 20)) AS i) LEFT JOIN w ON w.pair = p.pair AND w.k = i)
SELECT pair, string_agg(ch, '' ORDER BY i) AS degenerate FROM ch GROUP BY 1""")
def degenerate_primers(spark, sf):
    r, p = reads(spark, sf), panel(spark, sf)
    s = sites.seeded_sites(r, p, 1, shortest=20, longest=20).where("(side = 'L' AND strand = '+') OR (side = 'R' AND strand = '-')")
    site = F.substring(F.col("seq").cast("binary"), F.col("start") + 1, F.lit(20)).cast("string")
    site = F.when(F.col("strand") == "+", site).otherwise(S.revcomp(site))
    m = s.join(r, "read_id").join(p, "pair").select("pair", F.col("fwd").alias("oligo"), site.alias("site"))
    return D.degenerate_primer(m, "pair").select("pair", "degenerate")


@query("gel_clashes", "OPT-05",
       """WITH p AS (SELECT l_orderkey AS plate, l_linenumber * 100000 + l_partkey AS target, (l_quantity * 3)::INTEGER AS bp FROM lineitem)
SELECT x.plate, x.target AS a, y.target AS b, x.bp AS bp_a, y.bp AS bp_b FROM p x JOIN p y ON x.plate = y.plate AND x.target < y.target AND abs(x.bp - y.bp) < 10""")
def gel_clashes(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("plate"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("target"),
                                            (F.col("l_quantity") * 3).cast("int").alias("bp"))
    return D.gel_clashes(p, "plate")


_RULES = G.Rules(lengths=(20, 20), max_mm=0)
_GROUP_SQL = f"""WITH {READS}, {FAMILIES},
fa AS (SELECT grp AS ref_id, seq FROM (SELECT grp, seq, row_number() OVER (PARTITION BY grp ORDER BY length(seq) DESC, read_id) AS rn FROM fam WHERE grp IS NOT NULL) WHERE rn = 1),
wins AS (SELECT ref_id, pos, 20 AS len, dir, CASE dir WHEN 'F' THEN w ELSE {sql_rc('w')} END AS oligo FROM (
  SELECT ref_id, pos, substr(seq, pos + 1, 20) AS w FROM (SELECT ref_id, seq, unnest(range(0, length(seq) - 19)) AS pos FROM fa WHERE length(seq) >= 20)), (VALUES ('F'), ('R')) d(dir)),
{TM_SQL},
cc AS (SELECT ref_id AS grp, pos, dir, oligo, tm FROM cand WHERE gc BETWEEN 35 AND 65 AND tm BETWEEN 56 AND 64),
{sql_kmers(20)},
o AS (SELECT DISTINCT oligo FROM cc),
site AS (SELECT oligo, read_id, '+' AS strand, pos AS start FROM kmers JOIN o ON kmer = oligo
  UNION ALL SELECT oligo, read_id, '-', pos FROM kmers JOIN (SELECT oligo, {sql_rc('oligo')} AS back FROM o) ON kmer = back),
size AS (SELECT grp, count(*) AS n FROM fam WHERE grp IS NOT NULL GROUP BY 1),
bnd AS (SELECT DISTINCT cc.grp, cc.oligo, fam.read_id, fam.grp AS home FROM (SELECT DISTINCT grp, oligo FROM cc) cc JOIN site USING (oligo) JOIN fam USING (read_id)),
uni AS (SELECT grp, oligo, CASE WHEN count(*) FILTER (home IS DISTINCT FROM grp) = 0 THEN 99 ELSE 0 END AS rival FROM bnd JOIN size USING (grp)
  GROUP BY grp, oligo, n HAVING count(*) FILTER (home = grp) = n),
uc AS (SELECT cc.*, rival, min(pos) OVER (PARTITION BY grp, dir) AS lo, max(pos) OVER (PARTITION BY grp, dir) AS hi FROM cc JOIN uni USING (grp, oligo)),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp, dir, (pos - lo) * 40 // (hi - lo + 1) ORDER BY rival DESC, abs(tm - 60), pos, oligo) AS rn FROM uc) WHERE rn = 1),
pp AS (SELECT f.grp, f.pos AS f_pos, r.pos AS r_pos, r.pos + 20 AS r_end, f.oligo AS fwd, r.oligo AS rev, f.tm AS f_tm, r.tm AS r_tm, f.rival AS f_rival, r.rival AS r_rival
  FROM pk f JOIN pk r ON f.grp = r.grp AND f.dir = 'F' AND r.dir = 'R' WHERE r.pos + 20 - f.pos BETWEEN 60 AND 400 AND r.pos >= f.pos + 20 AND round(abs(f.tm - r.tm), 2) <= 1.5),
mk AS (SELECT grp, f_pos, r_pos, read_id, min(bp) AS bp FROM (
  SELECT pp.grp, f_pos, r_pos, s.read_id, CASE WHEN s.strand = '+' THEN t.start + 20 - s.start ELSE s.start + 20 - t.start END AS bp
  FROM pp JOIN site s ON s.oligo = fwd JOIN site t ON t.oligo = rev AND t.read_id = s.read_id AND t.strand <> s.strand) WHERE bp BETWEEN 40 AND 600 GROUP BY ALL),
ev AS (SELECT mk.grp, f_pos, r_pos, min(bp) FILTER (own) AS bp_min, max(bp) FILTER (own) AS bp_max, avg(bp) FILTER (own) AS bp_avg, count(*) FILTER (own) AS members, count(*) FILTER (NOT own AND home) AS rivals
  FROM (SELECT mk.*, fam.grp = mk.grp AND bp BETWEEN 60 AND 400 IS TRUE AS own, fam.grp IS DISTINCT FROM mk.grp AS home FROM mk JOIN fam USING (read_id)) mk GROUP BY ALL),
pn AS (SELECT pp.*, bp_min, bp_max, members, round(abs(f_tm - r_tm) + 0.02 * (bp_max - bp_min) + 2.0 * (greatest(58 - f_tm, f_tm - 62, 0.0) + greatest(58 - r_tm, r_tm - 62, 0.0))
  + 0.05 * greatest(60 - bp_avg, bp_avg - 150, 0.0), 3) AS penalty FROM pp JOIN ev USING (grp, f_pos, r_pos) JOIN size USING (grp) WHERE members = n AND rivals = 0 AND greatest(f_rival, r_rival) = 99)
SELECT grp, fwd, rev, f_pos, r_end, members, bp_min, bp_max, penalty, CASE WHEN least(f_rival, r_rival) = 99 THEN 'both' WHEN f_rival = 99 THEN 'forward' ELSE 'reverse' END AS orphan, rank
FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY penalty, f_pos, r_pos, fwd, rev) AS rank FROM pn) WHERE rank <= 5"""


@query("group_primers", "OPT-04", _GROUP_SQL)
def group_primers(spark, sf):
    return G.group_pairs(families(spark, sf), _RULES).select("grp", "fwd", "rev", "f_pos", "r_end", "members", "bp_min", "bp_max", "penalty", "orphan", "rank")


#: Nations as targets, part numbers as candidates; a line is a read, and a candidate hits the lines whose quantity is above it.
_RACE = """rd AS (SELECT s_nationkey AS target, l_orderkey * 10 + l_linenumber AS read_id, l_quantity AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
cd AS (SELECT DISTINCT s_nationkey AS target, l_partkey % 50 AS cand FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def _wilson(sign: str, z: float) -> str:
    return (f"greatest(0.0, least(1.0, (k / n + {z * z} / (2 * n) {sign} {z} * sqrt((k / n) * (1 - k / n) / n + {z * z} / (4.0 * n * n))) / (1 + {z * z} / n)))")


@query("candidate_race", "OPT-06",
       f"""WITH {_RACE},
sm AS (SELECT target, read_id, q FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5('0:' || read_id), read_id) AS rn FROM rd) WHERE rn <= 300),
qk AS (SELECT *, {_wilson('-', 3.0)} AS low, {_wilson('+', 3.0)} AS high FROM (SELECT target, cand, count(*) FILTER (q > cand) AS k, count(*)::DOUBLE AS n FROM sm JOIN cd USING (target) GROUP BY ALL)),
bs AS (SELECT target, max(low) AS best_low, sum(n) AS quick_rows, count(*) AS raced FROM qk GROUP BY 1),
fl AS (SELECT *, {_wilson('-', 1.96)} AS low FROM (SELECT target, cand, count(*) FILTER (q > cand) AS k, count(*)::DOUBLE AS n FROM rd JOIN (
  SELECT target, cand FROM qk JOIN bs USING (target) WHERE high >= best_low) USING (target) GROUP BY ALL)),
fr AS (SELECT target, sum(n) AS full_rows, count(*) AS kept, max(n) AS depth FROM fl GROUP BY 1)
SELECT target, cand, k, n::BIGINT AS n, round(low, 9) AS low, raced, kept, (quick_rows + full_rows)::BIGINT AS rows_read, (raced * depth)::BIGINT AS rows_in_full
FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY low DESC, k / n DESC, cand) AS rn FROM fl) JOIN bs USING (target) JOIN fr USING (target) WHERE rn = 1""")
def candidate_race(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("target"), F.col("s_suppkey").alias("l_suppkey"))
    li = table(spark, sf, "lineitem").join(s, "l_suppkey")
    rd = li.select("target", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read_id"), F.col("l_quantity").alias("q"))
    cd = li.select("target", (F.col("l_partkey") % 50).alias("cand")).distinct()

    def measure(reads, candidates):
        # reads collapse to (target, quantity) counts before they meet the candidates
        c = reads.groupBy("target", "q").agg(F.count(F.lit(1)).alias("c"))
        return c.join(candidates, "target").groupBy("target", "cand").agg(F.sum(F.when(F.col("q") > F.col("cand"), F.col("c")).otherwise(0)).alias("k"), F.sum("c").alias("n"))

    return Q.race(rd, cd, measure, depth=300, z=3.0)


@query("plate_assignment", "OPT-05",
       f"""WITH {REFS}, tg AS (SELECT ref_id AS target, 60 + length(seq) % 340 AS bp, 57.0 + length(regexp_replace(seq, '[^GC]', '', 'g')) % 60 / 10.0 AS tm_min, ref_id % 4 AS plate FROM refs),
pl(plate, ta) AS (VALUES (0, 54.0), (1, 55.0), (2, 56.5), (3, 58.0)),
ml AS (SELECT t.target, list(p.plate ORDER BY p.plate) AS may FROM tg t JOIN pl p ON p.ta <= t.tm_min - 3.0 + 0.6 GROUP BY 1),
mt AS (SELECT target, bp, plate, coalesce(may, [plate]) AS may FROM tg LEFT JOIN ml USING (target)),
tr AS (SELECT target, bp, seed, may[('0x' || substr(md5(seed || ':' || target), 1, 8))::BIGINT % len(may) + 1] AS plate FROM mt, (SELECT unnest(range(0, 300)) AS seed)),
al AS (SELECT -1 AS seed, target, bp, plate FROM mt UNION ALL SELECT seed, target, bp, plate FROM tr),
nr AS (SELECT seed, plate, count(*) OVER (PARTITION BY seed, plate ORDER BY bp RANGE BETWEEN 9 PRECEDING AND 9 FOLLOWING) - 1 AS near FROM al),
ps AS (SELECT seed, sum(c) AS c, count(*) AS used, min(size) AS least, max(size) AS most FROM (SELECT seed, plate, sum(near) // 2 AS c, count(*) AS size FROM nr GROUP BY ALL) GROUP BY 1),
b4 AS (SELECT c AS before FROM ps WHERE seed = -1),
bt AS (SELECT seed, c FROM ps, b4 WHERE seed >= 0 AND used = 4 AND least >= 2 AND most <= (SELECT count(*) FROM tg) // 2 + 2 AND c < before ORDER BY c, seed LIMIT 1)
SELECT mt.target, mt.plate, coalesce(tr.plate, mt.plate)::BIGINT AS proposed, bt.seed::INTEGER AS seed, b4.before::BIGINT AS before, coalesce(bt.c, b4.before)::BIGINT AS after
FROM mt CROSS JOIN b4 LEFT JOIN bt ON true LEFT JOIN tr ON tr.seed = bt.seed AND tr.target = mt.target""")
def plate_assignment(spark, sf):
    r = references(spark, sf)
    gc = F.length(F.regexp_replace("seq", "[^GC]", ""))
    t = r.select(F.col("ref_id").alias("target"), (F.length("seq") % 340 + 60).alias("bp"), (F.lit(57.0) + gc % 60 / 10.0).alias("tm_min"), (F.col("ref_id") % 4).alias("plate"))
    plates = spark.createDataFrame([(0, 54.0), (1, 55.0), (2, 56.5), (3, 58.0)], "plate long, ta double")
    return Q.assign_plates(t, plates, trials=300)


_FUNNEL_SQL = f"""WITH {READS}, {REFS},
wins AS (SELECT ref_id, pos, 20 AS len, dir, CASE dir WHEN 'F' THEN w ELSE {sql_rc('w')} END AS oligo FROM (
  SELECT ref_id, pos, substr(seq, pos + 1, 20) AS w FROM (SELECT ref_id, seq, unnest(range(0, length(seq) - 19)) AS pos FROM refs WHERE length(seq) >= 20)), (VALUES ('F'), ('R')) d(dir)),
{TM_SQL}, {MASK_SQL}, co(st, pi, ui, ord) AS (VALUES {_ORDER}),
s AS (SELECT p.target, f_pos, r_end, fwd, rev, bp, min(ord) AS ord FROM pairs p JOIN co ON (pm >> co.pi) & 1 = 1 JOIN uc ON uc.ui = co.ui AND bp BETWEEN b1 AND b2 GROUP BY ALL),
r AS (SELECT target, pi * 10 + ui AS cell, st AS strictness, f_pos, r_end, fwd, rev, bp, row_number() OVER (PARTITION BY target, pi * 10 + ui ORDER BY abs(bp - 105), f_pos, r_end, fwd, rev) AS turn FROM s JOIN co USING (ord)),
rp AS (SELECT * FROM r WHERE turn <= 4),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY turn, strictness, cell) AS pick FROM rp) WHERE pick <= 12),
{sql_kmers(20)},
o AS (SELECT fwd AS oligo FROM pk UNION SELECT rev FROM pk),
site AS (SELECT oligo, read_id, '+' AS strand, pos AS start FROM kmers JOIN o ON kmer = oligo
  UNION ALL SELECT oligo, read_id, '-', pos FROM kmers JOIN (SELECT oligo, {sql_rc('oligo')} AS back FROM o) ON kmer = back),
am AS (SELECT target, f_pos, r_end, fwd, rev, strictness, count(DISTINCT read_id) AS reads FROM (
  SELECT pk.*, s.read_id, CASE WHEN s.strand = '+' THEN t.start + 20 - s.start ELSE s.start + 20 - t.start END AS b
  FROM pk JOIN site s ON s.oligo = fwd JOIN site t ON t.oligo = rev AND t.read_id = s.read_id AND t.strand <> s.strand) WHERE b BETWEEN 60 AND 400 GROUP BY ALL),
kp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY reads DESC, strictness, f_pos, r_end, fwd, rev) AS rank FROM am) WHERE rank <= 3)"""


def _funnel(spark, sf):
    return FU.design_funnel(backbones(spark, sf), reads(spark, sf), _RULES, per_cell=4, to_sample=12, keep=3)


@query("funnel_pairs", "OPT-01", f"{_FUNNEL_SQL} SELECT target, fwd, rev, reads, rank FROM kp")
def funnel_pairs(spark, sf):
    return _funnel(spark, sf)[0].select("target", "fwd", "rev", "reads", "rank")


@query("funnel_stages", "OPT-01", f"""{_FUNNEL_SQL},
n AS (SELECT 0 AS step, 'windows' AS stage, count(*) AS n FROM wins UNION ALL SELECT 1, 'rules', count(*) FROM cand UNION ALL SELECT 2, 'grid cells', count(*) FROM cm
  UNION ALL SELECT 3, 'pairs', count(*) FROM pairs UNION ALL SELECT 4, 'representatives', count(*) FROM rp UNION ALL SELECT 5, 'picked for the sample', count(*) FROM pk
  UNION ALL SELECT 6, 'amplify in the sample', count(*) FROM am UNION ALL SELECT 7, 'kept', count(*) FROM kp)
SELECT step, stage, lag(n) OVER (ORDER BY step) AS rows_in, n AS rows_out, lag(n) OVER (ORDER BY step) - n AS cut FROM n""")
def funnel_stages(spark, sf):
    return _funnel(spark, sf)[1].table(spark)
