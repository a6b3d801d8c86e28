"""Panel measurement queries: sites, products, rates, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..functions import stats as M
from ..functions import tables
from ..operators import measure, products, sites
from .binding import MEMBERSHIP, PANEL, READS, REFS, membership, panel, reads, sql_rc
from .registry import query

LO, HI = 60, 400

# Seeded site search restated in SQL: 10-base seeds of 20-base primers at <=1 mismatch.
PATTERNS = f"""pats AS (
  SELECT pair, '+' AS strand, 'L' AS side, fwd AS pat FROM panel
  UNION ALL SELECT pair, '+', 'R', {sql_rc('rev')} FROM panel
  UNION ALL SELECT pair, '-', 'L', rev FROM panel
  UNION ALL SELECT pair, '-', 'R', {sql_rc('fwd')} FROM panel)"""
KMERS = """piece AS (SELECT read_id, length(seq) AS n, c, substr('NNNNNNNNNN' || seq, c * 256 + 1, 296) AS s FROM (
  SELECT read_id, seq, unnest(range(0, length(seq) // 256 + 1)) AS c FROM reads)),
pos AS (SELECT read_id, n, s, c * 256 AS base, unnest(range(0, 256)) AS i FROM piece),
seeds AS (SELECT *, unnest([0, 10]) AS off FROM pats),
cand AS (SELECT DISTINCT read_id, pair, strand, side, pat, base + i - off AS start, substr(s, i + 11 - off, 20) AS win
  FROM pos JOIN seeds ON substr(s, i + 11, 10) = substr(pat, off + 1, 10) WHERE base + i - off >= 0 AND base + i - off + 20 <= n),
sites AS (SELECT read_id, pair, strand, side, start, hamming(win, pat) AS mm FROM cand
  WHERE hamming(win, pat) <= 1 AND CASE side WHEN 'L' THEN right(win, 2) = right(pat, 2) ELSE left(win, 2) = left(pat, 2) END)"""
PRODUCTS = f"""prods AS (SELECT l.read_id, l.pair, l.strand, l.start AS l_start, r.start + 20 AS "end",
  r.start + 20 - l.start AS bp, l.mm AS l_mm, r.mm AS r_mm
  FROM sites l JOIN sites r ON l.read_id = r.read_id AND l.pair = r.pair AND l.strand = r.strand
  WHERE l.side = 'L' AND r.side = 'R' AND r.start + 20 - l.start BETWEEN {LO} AND {HI} AND r.start >= l.start + 20)"""
BEST = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_id, pair
  ORDER BY strand = '-', l_mm + r_mm, l_start, bp) AS rn FROM prods) WHERE rn = 1)"""
RATES = """rates AS (SELECT p.pair, b.bin, coalesce(k, 0) AS k, n FROM panel p
  CROSS JOIN (SELECT bin, count(*) AS n FROM reads GROUP BY bin) b
  LEFT JOIN (SELECT pair, bin, count(*) AS k FROM best JOIN reads USING (read_id) GROUP BY ALL) h
  ON h.pair = p.pair AND h.bin = b.bin)"""
BASE = f"WITH {READS}, {REFS}, {PANEL}, {PATTERNS}, {KMERS}"


def wilson_sql(k: str, n: str, upper: bool) -> str:
    z = "1.96"
    p = f"({k}::DOUBLE / {n})"
    mid = f"({p} + {z}*{z} / (2.0 * {n})) / (1.0 + {z}*{z} / {n})"
    half = f"{z} * sqrt({p} * (1.0 - {p}) / {n} + {z}*{z} / (4.0 * {n}::DOUBLE * {n})) / (1.0 + {z}*{z} / {n})"
    if upper:
        return f"CASE WHEN {n} > 0 THEN least({mid} + {half}, 1.0) ELSE 1.0 END"
    return f"CASE WHEN {n} > 0 THEN greatest({mid} - {half}, 0.0) ELSE 0.0 END"


def _sites(spark, sf):
    return sites.seeded_sites(reads(spark, sf), panel(spark, sf), max_mm=1, shortest=20, longest=20)


def _products(spark, sf):
    return products.products(_sites(spark, sf), LO, HI)


def _best(spark, sf):
    return products.best_products(_products(spark, sf), first_strand_wins=True)


def _rates(spark, sf):
    return measure.bin_rates(_best(spark, sf), reads(spark, sf), panel(spark, sf))


@query("primer_sites_mm1", "JOIN-01 JOIN-02 JOIN-03", f"{BASE} SELECT read_id, pair, strand, side, start, mm FROM sites")
def primer_sites_mm1(spark, sf):
    return _sites(spark, sf).select("read_id", "pair", "strand", "side", "start", "mm")


@query("primer_products", "JOIN-05 JOIN-11", f"{BASE}, {PRODUCTS} SELECT * FROM prods")
def primer_products(spark, sf):
    return _products(spark, sf)


@query("product_presence", "JOIN-06 JOIN-08",
       f"{BASE}, {PRODUCTS}, {BEST} SELECT read_id, pair, strand, l_start, bp, l_mm + r_mm AS mm FROM best")
def product_presence(spark, sf):
    return _best(spark, sf).select("read_id", "pair", "strand", "l_start", "bp", "mm")


@query("product_presence_by_library", "JOIN-06 AGG-01 MTH-01",
       f"""{BASE}, {PRODUCTS}, {BEST},
n AS (SELECT library, count(*) AS n FROM reads GROUP BY 1),
k AS (SELECT pair, library, count(*) AS k FROM best JOIN reads USING (read_id) GROUP BY ALL)
SELECT pair, library, k, n, round({wilson_sql('k', 'n', False)}, 6) AS low, round({wilson_sql('k', 'n', True)}, 6) AS high
FROM (SELECT p.pair, n.library, coalesce(k, 0) AS k, n FROM panel p CROSS JOIN n LEFT JOIN k
  ON k.pair = p.pair AND k.library = n.library)""")
def product_presence_by_library(spark, sf):
    r = reads(spark, sf).withColumn("bin", F.col("library"))
    rates = measure.bin_rates(_best(spark, sf), r, panel(spark, sf))
    return rates.select("pair", F.col("bin").alias("library"), "k", "n",
                        F.round(M.wilson_lower("k", "n"), 6).alias("low"),
                        F.round(M.wilson_upper("k", "n"), 6).alias("high"))


@query("product_rate_by_bin", "AGG-01", f"{BASE}, {PRODUCTS}, {BEST}, {RATES} SELECT * FROM rates")
def product_rate_by_bin(spark, sf):
    return _rates(spark, sf)


@query("product_length_histogram", "AGG-01 JOIN-25",
       f"{BASE}, {PRODUCTS}, {BEST} SELECT pair, bp, count(*) AS n_reads FROM best GROUP BY ALL")
def product_length_histogram(spark, sf):
    return _best(spark, sf).groupBy("pair", "bp").agg(F.count(F.lit(1)).alias("n_reads"))


@query("reference_coverage", "JOIN-08",
       f"""{BASE}, {PRODUCTS}, ok AS (SELECT read_id FROM reads WHERE length(seq) >= 1200),
best AS (SELECT * FROM prods SEMI JOIN ok USING (read_id))
SELECT p.pair, count(DISTINCT read_id) AS with_product, (SELECT count(*) FROM ok) AS records
FROM panel p LEFT JOIN best USING (pair) GROUP BY 1""")
def reference_coverage(spark, sf):
    r = reads(spark, sf).select("read_id", "seq")
    return products.coverage(_products(spark, sf), r, 1200, panel(spark, sf)).drop("lengths")


SEPARATION = f"""sep AS (SELECT *, CASE WHEN pool_n >= 150 AND pool_high > 0 THEN member_low / pool_high END AS fold_pool,
  CASE WHEN worst_high > 0 THEN member_low / worst_high END AS fold_worst FROM (
  SELECT *, CASE WHEN pool_n > 0 THEN {wilson_sql('pool_k', 'pool_n', True)} END AS pool_high FROM (
  SELECT pair, min(lo) FILTER (role = 'member') AS member_low, count(*) FILTER (role = 'member') AS member_bins,
    count(*) FILTER (role = 'member' AND k / n >= 0.2) AS covered_bins,
    coalesce(sum(k) FILTER (role = 'competitor'), 0)::BIGINT AS pool_k,
    coalesce(sum(n) FILTER (role = 'competitor'), 0)::BIGINT AS pool_n,
    max(hi) FILTER (role = 'competitor' AND n >= {{depth}}) AS worst_high,
    arg_max(bin, hi * 1e6) FILTER (role = 'competitor' AND n >= {{depth}}) AS any_worst
  FROM (SELECT *, {wilson_sql('k', 'n', False)} AS lo, {wilson_sql('k', 'n', True)} AS hi
        FROM rates JOIN membership USING (bin)) GROUP BY pair) WHERE member_bins > 0))"""
_SEP = f"{BASE}, {PRODUCTS}, {BEST}, {RATES}, {MEMBERSHIP}, " + SEPARATION.replace("{depth}", "30")


def _separation(spark, sf):
    return measure.separation(_rates(spark, sf), membership(spark, sf), min_reads=30)


@query("member_competitor_fold", "AGG-02 JOIN-19 MTH-02",
       f"""{_SEP} SELECT pair, member_bins, covered_bins, pool_k, pool_n, round(member_low, 6) AS member_low,
round(pool_high, 6) AS pool_high, round(worst_high, 6) AS worst_high,
round(CASE WHEN pool_n >= 30 AND pool_high > 0 THEN member_low / pool_high END, 6) AS fold_pool,
round(fold_worst, 6) AS fold_worst,
round(CASE WHEN fold_worst > 0 THEN ln(fold_worst) / ln(2.0) END, 5) AS dcq FROM sep""")
def member_competitor_fold(spark, sf):
    s = _separation(spark, sf)
    return s.select("pair", "member_bins", "covered_bins", "pool_k", "pool_n",
                    *[F.round(c, 6).alias(c) for c in ("member_low", "pool_high", "worst_high", "fold_pool", "fold_worst")],
                    F.round(M.fold_to_dcq("fold_worst"), 5).alias("dcq"))


@query("panel_decision", "DEC-09 MTH-08",
       f"""{_SEP}, v AS (SELECT pair, CASE WHEN pair LIKE '%7' THEN NULL ELSE coalesce(fold_worst,
  CASE WHEN pool_n >= 30 AND pool_high > 0 THEN member_low / pool_high END) END AS value,
  CASE WHEN pair LIKE '%7' THEN 'universal' WHEN fold_worst IS NOT NULL THEN 'worst_bin'
       WHEN pool_n >= 30 THEN 'pool' ELSE 'no_competitor' END AS basis FROM sep)
SELECT pair, round(value, 6) AS value, basis, CASE WHEN value IS NULL THEN 'NOT MEASURABLE' WHEN value >= 8 THEN 'ABOVE THRESHOLD'
  ELSE 'BELOW THRESHOLD' END AS decision, CASE WHEN value IS NULL THEN 'UNIVERSAL' WHEN value >= 8 THEN 'CERTAIN'
  WHEN value >= 4 THEN 'CONDITIONAL' ELSE 'NOT RECOMMENDED' END AS order_class FROM v""")
def panel_decision(spark, sf):
    d = measure.panel_decision(_separation(spark, sf), universal=F.col("pair").endswith("7"))
    return d.select("pair", F.round("value", 6).alias("value"), "basis", "decision",
                    M.fold_class("value").alias("order_class"))


READ_LEVEL = f"""rl_prods AS (SELECT l.read_id, l.pair, l.strand, r.start + 20 - l.start AS bp, l.mm + r.mm AS mm
  FROM sites l JOIN sites r ON l.read_id = r.read_id AND l.pair = r.pair AND l.strand = r.strand
  WHERE l.side = 'L' AND r.side = 'R' AND r.start + 20 - l.start BETWEEN 40 AND 700),
rl_best AS (SELECT read_id, pair, min(mm) AS mm FROM rl_prods GROUP BY ALL),
rl AS (SELECT p.pair, b.bin, coalesce(k1, 0) AS k1, coalesce(k0, 0) AS k0, n FROM panel p
  CROSS JOIN (SELECT bin, count(*) AS n FROM reads WHERE length(seq) >= 100 GROUP BY bin) b
  LEFT JOIN (SELECT pair, bin, count(*) AS k1, count(*) FILTER (mm = 0) AS k0 FROM rl_best JOIN reads USING (read_id)
             WHERE length(seq) >= 100 GROUP BY ALL) h ON h.pair = p.pair AND h.bin = b.bin),
rls AS (SELECT pair, count(*) FILTER (role = 'member') AS member_bins,
  min(pct) FILTER (role = 'member') AS member_min, max(pct) FILTER (role = 'member') AS member_max,
  coalesce(100.0 * sum(k1) FILTER (role = 'member') / sum(n) FILTER (role = 'member'), 0.0) AS pooled_mm1,
  coalesce(100.0 * sum(k0) FILTER (role = 'member') / sum(n) FILTER (role = 'member'), 0.0) AS pooled_mm0,
  coalesce(max(pct) FILTER (role = 'competitor'), 0.0) AS worst_competitor,
  coalesce(100.0 * sum(k1) FILTER (role = 'competitor') / sum(n) FILTER (role = 'competitor'), 0.0) AS pooled_competitor
  FROM (SELECT *, 100.0 * k1 / n AS pct FROM rl JOIN membership USING (bin)) GROUP BY pair)"""


def _read_level(spark, sf):
    r = reads(spark, sf).where(F.length("seq") >= 100)
    prods = products.products(
        sites.seeded_sites(r, panel(spark, sf), max_mm=1, shortest=20, longest=20), 40, 700, non_overlapping=False)
    best = products.best_products(prods)
    k = (best.join(r.select("read_id", "bin"), "read_id").groupBy("pair", "bin")
         .agg(F.count(F.lit(1)).alias("k1"), F.count(F.when(F.col("mm") == 0, 1)).alias("k0")))
    n = r.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    frame = panel(spark, sf).select("pair").join(n)
    rates = frame.join(k, ["pair", "bin"], "left").na.fill(0, ["k0", "k1"])
    return measure.read_level_summary(rates, membership(spark, sf))


@query("read_pair_summary", "JOIN-07 AGG-15",
       f"""{BASE}, {MEMBERSHIP}, {READ_LEVEL} SELECT pair, member_bins, round(member_min, 6) AS member_min,
round(member_max, 6) AS member_max, round(pooled_mm1, 6) AS pooled_mm1, round(pooled_mm0, 6) AS pooled_mm0,
round(worst_competitor, 6) AS worst_competitor, round(pooled_competitor, 6) AS pooled_competitor FROM rls""")
def read_pair_summary(spark, sf):
    cols = ("member_min", "member_max", "pooled_mm1", "pooled_mm0", "worst_competitor", "pooled_competitor")
    return _read_level(spark, sf).select("pair", "member_bins", *[F.round(c, 6).alias(c) for c in cols])


@query("read_level_verdict", "DEC-10",
       f"""{BASE}, {MEMBERSHIP}, {READ_LEVEL}, v AS (SELECT *, pooled_competitor <= 0 AS p_inf,
  member_bins > 0 AND worst_competitor <= 0 AND member_min > 0 AS w_inf FROM rls)
SELECT pair, CASE WHEN member_bins = 0 OR member_max < 10 THEN 'NO / WEAK PRODUCT IN MEMBERS'
  WHEN w_inf OR (worst_competitor > 0 AND member_min / worst_competitor >= 8) THEN 'PASSED'
  WHEN p_inf OR pooled_mm1 / pooled_competitor >= 8 THEN 'PASSED POOLED ONLY' ELSE 'FAILED' END AS verdict,
  member_bins > 0 AND pooled_mm1 >= 10 AND pooled_mm0 = 0 AS systematic_mismatch FROM v""")
def read_level_verdict(spark, sf):
    return measure.read_level_verdict(_read_level(spark, sf)).select("pair", "verdict", "systematic_mismatch")


@query("product_excision", "JOIN-24",
       f"""{BASE}, {PRODUCTS}, {BEST}
SELECT read_id, pair, CASE strand WHEN '-' THEN {sql_rc('substr(seq, l_start + 1, bp)')}
  ELSE substr(seq, l_start + 1, bp) END AS product FROM best JOIN reads USING (read_id)""")
def product_excision(spark, sf):
    return products.excise(_best(spark, sf), reads(spark, sf)).select("read_id", "pair", "product")


@query("global_scan", "JOIN-09 AGG-12")
def global_scan(spark, sf):
    """Seedless: at five mismatches a block seed is too short to select."""
    r = reads(spark, sf)
    s = sites.scan_sites(r, sites.patterns(panel(spark, sf)), P.GLOBAL_MAX_MM, exact_tail=0)
    cls = r.select("read_id", F.when(F.col("library") == "en", "in").when(F.col("library") == "es", "unknown")
                   .when(F.col("library") == "fr", "same_domain").otherwise("other_domain").alias("class"))
    return products.global_scan(s, cls, LO, HI, P.GLOBAL_MAX_MM)[0]


@query("sites_in_sql", "JOIN-01",
       f"""{BASE} SELECT read_id, pair, strand, start, mm FROM sites WHERE (strand = '+' AND side = 'L') OR (strand = '-' AND side = 'R')""")
def sites_in_sql(spark, sf):
    """Forward primers on every read that any of their pair's primers bind, by the table function ``sites`` called from SQL."""
    tables.register(spark)
    met = _sites(spark, sf).select("read_id", "pair").distinct()
    asked = met.join(reads(spark, sf).select("read_id", "seq"), "read_id").join(panel(spark, sf).select("pair", "fwd"), "pair")
    return spark.sql("SELECT a.read_id, a.pair, s.strand, s.start, s.mm FROM {asked} a, LATERAL sites(a.seq, a.fwd, 1) s", asked=asked)
