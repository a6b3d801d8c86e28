"""Community and taxon-tree queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import community as C
from ..operators import lineage as L
from .binding import READS, reads, table
from .registry import query

# tree: region (P) > nation (G) > supplier / customer (S)
TREE = """edges AS (SELECT 'S' || s_suppkey AS child, 'N' || s_nationkey AS parent FROM supplier UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation),
nodes AS (SELECT child AS node FROM edges UNION SELECT parent FROM edges),
clo AS (SELECT node, node AS ancestor, 0 AS dist FROM nodes UNION ALL SELECT child, parent, 1 FROM edges UNION ALL
  SELECT a.child, b.parent, 2 FROM edges a JOIN edges b ON a.parent = b.child),
rk AS (SELECT node, CASE left(node, 1) WHEN 'R' THEN 'P' WHEN 'N' THEN 'G' ELSE 'S' END AS rank FROM nodes)"""


def edges(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("child"), F.concat(F.lit("N"), "s_nationkey").alias("parent"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("child"), F.concat(F.lit("N"), "c_nationkey").alias("parent"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("child"), F.concat(F.lit("R"), "n_regionkey").alias("parent"))
    return s.union(c).union(n)


def ranks(close):
    first = F.substring("node", 1, 1)
    return close.select("node").distinct().select("node", F.when(first == "R", "P").when(first == "N", "G").otherwise("S").alias("rank"))


@query("taxon_closure", "GRF-02 TAX-18", f"WITH {TREE} SELECT node, ancestor, dist FROM clo")
def taxon_closure(spark, sf):
    return L.closure(edges(spark, sf))


# a read is an order: placed at customer, nation or region, or nowhere
PLACED = """placed AS (SELECT o_orderkey AS read_id, year(o_orderdate)::VARCHAR AS sample, CASE WHEN o_orderpriority = '5-LOW' THEN 'U'
  WHEN o_orderstatus = 'F' THEN 'C' || o_custkey WHEN o_orderstatus = 'O' THEN 'N' || c_nationkey ELSE 'R' || n_regionkey END AS node
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


def placed(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    j = o.join(c, "c_custkey").join(n, "n_nationkey")
    node = (F.when(F.col("o_orderpriority") == "5-LOW", "U").when(F.col("o_orderstatus") == "F", F.concat(F.lit("C"), "c_custkey"))
            .when(F.col("o_orderstatus") == "O", F.concat(F.lit("N"), "n_nationkey")).otherwise(F.concat(F.lit("R"), "n_regionkey")))
    return j.select(F.col("o_orderkey").alias("read_id"), F.year("o_orderdate").cast("string").alias("sample"), node.alias("node"))


@query("clade_rollup", "GRF-03 GRF-02",
       f"WITH {TREE}, {PLACED} SELECT ancestor AS node, count(*) AS clade, count(*) FILTER (dist = 0) AS direct FROM placed JOIN clo USING (node) GROUP BY 1")
def clade_rollup(spark, sf):
    return L.clade_rollup(placed(spark, sf).withColumn("n", F.lit(1)), L.closure(edges(spark, sf)))


COV = """d AS (SELECT sample, CASE WHEN node = 'U' THEN 'U' WHEN left(node, 1) = 'R' THEN 'P' WHEN left(node, 1) = 'N' THEN 'G' ELSE 'S' END AS rank, count(*) AS n FROM placed GROUP BY ALL),
tot AS (SELECT sample, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (rank = 'U'), 0)::BIGINT AS unclassified FROM d GROUP BY 1),
cov AS (SELECT sample, r.rank, pos, coalesce((SELECT sum(n) FROM d JOIN (VALUES ('D',1),('P',2),('C',3),('O',4),('F',5),('G',6),('S',7)) x(rank, p) USING (rank)
  WHERE d.sample = tot.sample AND x.p >= r.pos), 0)::BIGINT AS placed, total - unclassified AS classified, unclassified, total
  FROM tot CROSS JOIN (VALUES ('D',1),('P',2),('C',3),('O',4),('F',5),('G',6),('S',7)) r(rank, pos)),
ch AS (SELECT sample, rank, placed, classified, unclassified, total FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY (placed / classified >= 0.5) DESC,
  CASE WHEN placed / classified >= 0.5 THEN -pos ELSE pos END) AS rn FROM cov) WHERE rn = 1)"""


def _coverage(spark, sf):
    first = F.substring("node", 1, 1)
    r = placed(spark, sf).withColumn("rank", F.when(first == "R", "P").when(first == "N", "G").when(first == "C", "S").otherwise("U"))
    return C.rank_coverage(r.groupBy("sample", "rank").agg(F.count(F.lit(1)).alias("n")))


@query("rank_coverage", "COM-01 AGG-20",
       f"WITH {PLACED}, {COV} SELECT sample, rank, placed, classified, round(placed / classified, 8) AS share FROM cov")
def rank_coverage(spark, sf):
    return _coverage(spark, sf).select("sample", "rank", "placed", "classified", F.round("share", 8).alias("share"))


@query("abundance_supported_rank", "COM-01",
       f"""WITH {TREE}, {PLACED}, {COV}, cl AS (SELECT sample, ancestor AS node, count(*) AS n FROM placed JOIN clo USING (node) GROUP BY ALL),
t AS (SELECT sample, node AS taxon, n, total, row_number() OVER (PARTITION BY sample ORDER BY n DESC, node) AS rn FROM cl JOIN rk USING (node) JOIN ch USING (sample, rank))
SELECT sample, taxon, n, round(100.0 * n / total, 4) AS pct FROM t WHERE rn <= 15
UNION ALL SELECT sample, '[above ' || rank || ']', classified - placed, round(100.0 * (classified - placed) / total, 4) FROM ch WHERE classified > placed
UNION ALL SELECT sample, '[unclassified]', unclassified, round(100.0 * unclassified / total, 4) FROM ch WHERE unclassified > 0""")
def abundance_supported_rank(spark, sf):
    close = L.closure(edges(spark, sf))
    own = placed(spark, sf).groupBy("sample", "node").agg(F.count(F.lit(1)).alias("n"))
    clades = own.join(close, "node").groupBy("sample", F.col("ancestor").alias("node")).agg(F.sum("n").alias("clade"))
    return C.abundance_at_rank(clades, C.supported_rank(_coverage(spark, sf)), close, ranks(close))


# k-mer hits of a read: the supplier lines of an order
KH = """kh AS (SELECT l_orderkey AS read_id, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_tax = 0 THEN 'A' WHEN l_discount = 0 THEN '0' ELSE 'S' || l_suppkey END AS taxon,
  l_quantity::BIGINT AS hits FROM lineitem),
asg AS (SELECT l_orderkey AS read_id, 'S' || min(l_suppkey) AS taxon FROM lineitem GROUP BY 1)"""


def _kmer_hits(spark, sf):
    li = table(spark, sf, "lineitem")
    t = (F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F") & (F.col("l_tax") == 0), "A")
         .when(F.col("l_discount") == 0, "0").otherwise(F.concat(F.lit("S"), "l_suppkey")))
    h = li.select(F.col("l_orderkey").alias("read_id"), t.alias("taxon"), F.col("l_quantity").cast("long").alias("hits"))
    a = li.groupBy(F.col("l_orderkey").alias("read_id")).agg(F.concat(F.lit("S"), F.min("l_suppkey")).alias("taxon"))
    return h, a


REA = """q AS (SELECT read_id, sum(hits) AS q FROM kh WHERE taxon <> 'A' GROUP BY 1),
cla AS (SELECT read_id, ancestor, sum(hits) AS c FROM kh JOIN clo ON node = taxon WHERE taxon NOT IN ('A', '0') GROUP BY ALL),
chn AS (SELECT asg.read_id, taxon AS old, clo.ancestor, dist, c / q AS share FROM asg JOIN clo ON node = taxon JOIN cla ON cla.read_id = asg.read_id AND cla.ancestor = clo.ancestor
  JOIN q ON q.read_id = asg.read_id WHERE q > 0)"""


@query("confidence_reassignment", "COM-02 SRC-08",
       f"""WITH {TREE}, {KH}, {REA}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY dist) AS rn FROM chn WHERE share >= 0.4) WHERE rn = 1)
SELECT asg.read_id, taxon AS old, ancestor AS new FROM asg LEFT JOIN f USING (read_id)""")
def confidence_reassignment(spark, sf):
    h, a = _kmer_hits(spark, sf)
    return C.reassign(h, a, L.closure(edges(spark, sf)), 0.4)


SWEEP = [0.0, 0.05, 0.1, 0.2, 0.4, 0.6]


@query("threshold_sweep", "AGG-20",
       f"""WITH {TREE}, {KH}, {REA}, th AS (SELECT unnest([0.0, 0.05, 0.1, 0.2, 0.4, 0.6])::DOUBLE AS threshold),
f AS (SELECT threshold, read_id, arg_min(rank, dist) AS rank FROM th JOIN (SELECT * FROM chn JOIN rk ON node = ancestor) ON share >= threshold GROUP BY ALL),
e AS (SELECT threshold, read_id FROM th CROSS JOIN asg)
SELECT threshold, coalesce(rank, 'U') AS rank, count(*) AS n FROM e LEFT JOIN f USING (threshold, read_id) GROUP BY ALL""")
def threshold_sweep(spark, sf):
    h, a = _kmer_hits(spark, sf)
    close = L.closure(edges(spark, sf))
    return C.threshold_sweep(h, a, close, ranks(close), SWEEP)


@query("collapse_threshold", "AGG-20",
       """WITH s AS (SELECT l_suppkey, t AS threshold, count(*) FILTER (l_discount >= t / 10) / count(*) AS share FROM lineitem CROSS JOIN (SELECT unnest([0.0, 0.2, 0.4, 0.6, 0.8, 0.9])::DOUBLE AS t) GROUP BY ALL)
SELECT l_suppkey, min(threshold) FILTER (share < 0.2) AS collapse FROM s GROUP BY 1""")
def collapse_threshold(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), *[
        F.count(F.when(F.col("l_discount") >= t / 10, 1)).alias(f"k{i}") for i, t in enumerate((0.0, 0.2, 0.4, 0.6, 0.8, 0.9))])
    s = li.select("l_suppkey", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col(f"k{i}") / F.col("n")).alias("share"))
                                                   for i, t in enumerate((0.0, 0.2, 0.4, 0.6, 0.8, 0.9))])).alias("x")).select("l_suppkey", "x.*")
    return C.collapse_threshold(s, "l_suppkey")


AB = """ab AS (SELECT year(o_orderdate)::VARCHAR AS sample, 'N' || c_nationkey AS taxon, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""


def _abundance(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").cast("string").alias("sample"), F.col("o_custkey").alias("c_custkey"))
    return o.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey").groupBy(
        "sample", F.concat(F.lit("N"), "c_nationkey").alias("taxon")).agg(F.count(F.lit(1)).alias("n"))


@query("diversity_by_year", "MTH-06",
       f"""WITH {AB}, p AS (SELECT sample, n / sum(n) OVER (PARTITION BY sample) AS p FROM ab)
SELECT sample, round(-sum(p * ln(p)), 8) AS shannon, round(1 - sum(p * p), 8) AS simpson, count(*) AS taxa FROM p GROUP BY 1""")
def diversity_by_year(spark, sf):
    d = C.diversity(_abundance(spark, sf))
    return d.select("sample", F.round("shannon", 8).alias("shannon"), F.round("simpson", 8).alias("simpson"), "taxa")


@query("bray_curtis_years", "MTH-06",
       f"""WITH {AB}, s AS (SELECT DISTINCT sample FROM ab), pr AS (SELECT a.sample AS s1, b.sample AS s2 FROM s a JOIN s b ON b.sample::INT = a.sample::INT + 1)
SELECT s1, s2, round(sum(abs(coalesce(x.n, 0) - coalesce(y.n, 0))) / sum(coalesce(x.n, 0) + coalesce(y.n, 0)), 8) AS distance
FROM pr CROSS JOIN (SELECT DISTINCT taxon FROM ab) t LEFT JOIN ab x ON x.sample = s1 AND x.taxon = t.taxon LEFT JOIN ab y ON y.sample = s2 AND y.taxon = t.taxon GROUP BY ALL""")
def bray_curtis_years(spark, sf):
    a = _abundance(spark, sf)
    s = a.select("sample").distinct()
    pairs = s.select(F.col("sample").alias("s1"), (F.col("sample").cast("int") + 1).cast("string").alias("s2")).join(
        s.select(F.col("sample").alias("s2")), "s2")
    return C.bray_curtis(pairs, a).withColumn("distance", F.round("distance", 8))


@query("trend_by_year", "COM-03",
       """WITH a AS (SELECT c_mktsegment AS grp, year(o_orderdate) AS year, 'N' || c_nationkey AS taxon, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
t AS (SELECT grp, year, sum(n) AS total FROM a GROUP BY ALL), b AS (SELECT grp, taxon FROM (SELECT grp, taxon, row_number() OVER (PARTITION BY grp ORDER BY sum(n) DESC, taxon) AS rn FROM a GROUP BY grp, taxon) WHERE rn <= 5)
SELECT grp, taxon, round(sum(100.0 * n / total) FILTER (year = 1996), 6) AS "1996", round(sum(100.0 * n / total) FILTER (year = 1997), 6) AS "1997",
  round(sum(100.0 * n / total) FILTER (year = 1998), 6) AS "1998" FROM a JOIN b USING (grp, taxon) JOIN t USING (grp, year) GROUP BY ALL""")
def trend_by_year(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("c_custkey"))
    a = o.join(table(spark, sf, "customer"), "c_custkey").groupBy(F.col("c_mktsegment").alias("grp"), "year", F.concat(F.lit("N"), "c_nationkey").alias("taxon")).agg(
        F.count(F.lit(1)).alias("n"))
    return C.trend_table(a, [1996, 1997, 1998], 5)


@query("bin_shares", "AGG-18 WIN-07",
       f"""WITH {READS}, b AS (SELECT library AS barcode, bin, count(*) FILTER (length(seq) >= 300) AS full_n, count(*) AS n FROM reads GROUP BY ALL)
SELECT barcode, bin, round(100.0 * full_n / nullif(sum(full_n) OVER (PARTITION BY barcode), 0), 8) AS share_full, round(100.0 * n / sum(n) OVER (PARTITION BY barcode), 8) AS share_all FROM b""")
def bin_shares(spark, sf):
    b = reads(spark, sf).groupBy(F.col("library").alias("barcode"), "bin").agg(
        F.count(F.when(F.length("seq") >= 300, 1)).alias("full"), F.count(F.lit(1)).alias("reads"))
    s = C.bin_shares(b)
    return s.select("barcode", "bin", F.round("share_full", 8).alias("share_full"), F.round("share_all", 8).alias("share_all"))


@query("top_species", "COM-04 AGG-18",
       """WITH s AS (SELECT year(o_orderdate)::VARCHAR AS sample, r_name AS kingdom, c_custkey AS species, sum(round(o_totalprice * 100)::BIGINT) AS cents FROM orders JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL)
SELECT sample, kingdom, species, round(cents / 100.0, 2) AS share, rank FROM (SELECT *, row_number() OVER (PARTITION BY sample, kingdom ORDER BY cents DESC, species) AS rank FROM s) WHERE rank <= 3""")
def top_species(spark, sf):
    o = table(spark, sf, "orders").select(F.year("o_orderdate").cast("string").alias("sample"), F.col("o_custkey").alias("c_custkey"),
                                          F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    j = (o.join(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
         .join(table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey")), "n_nationkey")
         .join(table(spark, sf, "region"), "r_regionkey"))
    s = j.select("sample", F.col("r_name").alias("kingdom"), F.col("c_custkey").alias("species"), F.col("cents").alias("share"))
    return C.top_species(s, 3).withColumn("share", F.round(F.col("share") / 100.0, 2))


@query("clade_bins_calibration", "COM-05",
       f"""WITH {TREE}, {PLACED}, f AS (SELECT DISTINCT ancestor AS bin, read_id FROM placed JOIN clo USING (node) WHERE left(ancestor, 1) = 'N'),
e AS (SELECT DISTINCT 'N' || c_nationkey AS bin, o_orderkey AS read_id FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT bin, count(*) FILTER (a AND b) AS common, count(*) FILTER (b IS NULL) AS only_found, count(*) FILTER (a IS NULL) AS only_expected
FROM (SELECT bin, read_id, true AS a FROM f) FULL JOIN (SELECT bin, read_id, true AS b FROM e) USING (bin, read_id) GROUP BY 1""")
def clade_bins_calibration(spark, sf):
    close = L.closure(edges(spark, sf))
    clades = table(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("bin"), F.concat(F.lit("N"), "n_nationkey").alias("node"))
    found = C.clade_bins(placed(spark, sf).withColumnRenamed("node", "taxon"), close, clades)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("read_id"), F.col("o_custkey").alias("c_custkey"))
    expected = o.join(table(spark, sf, "customer"), "c_custkey").select(F.concat(F.lit("N"), "c_nationkey").alias("bin"), "read_id")
    return C.calibration(found, expected)


@query("dereplicated_reads", "COM-06",
       f"WITH {READS} SELECT sha256(seq) AS digest, count(*) AS size, min(read_id) AS representative FROM reads GROUP BY 1 HAVING count(*) >= 2")
def dereplicated_reads(spark, sf):
    return C.dereplicate(reads(spark, sf))


@query("taxon_coverage", "AGG-26",
       """WITH r AS (SELECT l_suppkey AS taxon, l_linenumber AS pair, l_shipdate::DATE AS bin, 100.0 * count(*) FILTER (l_returnflag = 'R' AND l_tax = 0.08) / count(*) AS p1,
  100.0 * count(*) FILTER (l_returnflag = 'R' AND l_tax >= 0.07) / count(*) AS p3 FROM lineitem GROUP BY ALL),
m AS (SELECT taxon, pair, max(p1) AS m1, max(p3) AS m3 FROM r GROUP BY ALL),
g AS (SELECT taxon, count(*) FILTER (m1 >= 10 AND pair <> 1) AS specific, count(*) FILTER (m1 >= 10) AS any1, count(*) FILTER (m3 >= 10 AND m1 < 10) AS only3 FROM m GROUP BY 1)
SELECT *, CASE WHEN specific > 0 THEN 'specific' WHEN any1 > 0 THEN 'universal_only' WHEN only3 > 0 THEN 'mm3_only' ELSE 'gap' END AS status FROM g""")
def taxon_coverage(spark, sf):
    r = F.col("l_returnflag") == "R"
    li = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("taxon"), F.col("l_linenumber").alias("pair"), F.to_date("l_shipdate").alias("bin")).agg(
        (100.0 * F.count(F.when(r & (F.col("l_tax") == 0.08), 1)) / F.count(F.lit(1))).alias("pct_mm1"),
        (100.0 * F.count(F.when(r & (F.col("l_tax") >= 0.07), 1)) / F.count(F.lit(1))).alias("pct_mm3"))
    return C.taxon_coverage(li.withColumn("universal", F.col("pair") == 1))
