"""Parsers run over line tables that Spark derives from the given tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..operators.lineage import parents_from_order
from ..session import shared_folder
from ..sources import readers as R
from ..sources import statistics as ST
from .binding import READS, table, reads
from .registry import query


@query("fastq_length_filter", "SRC-03 SRC-04",
       f"WITH {READS} SELECT bin, count(*) FILTER (length(seq) BETWEEN 200 AND 6000) AS kept, count(*) FILTER (length(seq) NOT BETWEEN 200 AND 6000) AS excluded FROM reads GROUP BY 1")
def fastq_length_filter(spark, sf):
    r = reads(spark, sf).select("bin", F.length("seq").between(200, 6000).alias("ok"))
    return r.groupBy("bin").agg(F.count(F.when(F.col("ok"), 1)).alias("kept"), F.count(F.when(~F.col("ok"), 1)).alias("excluded"))


@query("paf_lines", "SRC-10",
       """SELECT l_orderkey::VARCHAR AS q, 50 AS qlen, l_linenumber AS qs, (l_linenumber + l_quantity)::INTEGER AS qe, l_suppkey::VARCHAR AS t, round(1.0 - round(l_discount, 2), 6) AS identity FROM lineitem WHERE l_tax > 0""")
def paf_lines(spark, sf):
    li = table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("int")
    tag = F.when(F.col("l_tax") > 0, F.concat(F.lit("\tde:f:"), F.format_string("%.2f", "l_discount"))).otherwise(F.lit("\ttp:A:P"))
    line = F.concat(F.concat_ws("\t", "l_orderkey", F.lit(50), "l_linenumber", F.col("l_linenumber") + q, F.lit("+"), "l_suppkey", F.lit(60), F.lit(0), q,
                                F.lit(10), F.lit(50), F.lit(60)), tag)
    p = R.parse_paf(li.select(line.alias("value")))
    return p.select("q", "qlen", "qs", "qe", "t", F.round("identity", 6).alias("identity"))


@query("kraken_report_tree", "SRC-07",
       """SELECT r_name AS file, 1000000 + r_regionkey AS taxid, NULL AS parent, 'P' AS rank, 0 AS depth FROM region UNION ALL
SELECT r_name, 2000000 + n_nationkey, 1000000 + r_regionkey, 'G', 1 FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL
SELECT r_name, c_custkey, 2000000 + n_nationkey, 'S', 2 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def kraken_report_tree(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    c = table(spark, sf, "customer").join(n.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")

    def line(rank, taxid, indent, name):
        return F.concat_ws("\t", F.lit("1.00"), F.lit("5"), F.lit("1"), F.lit(rank), taxid.cast("string"), F.concat(F.lit(" " * indent), name))

    rows = (n.select("r_name", F.col("n_regionkey"), F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"),
                     line("P", F.col("n_regionkey") + 1000000, 0, F.col("r_name")).alias("value")).distinct()
            .union(n.select("r_name", "n_regionkey", F.col("n_nationkey").cast("long"), F.lit(-1).cast("long"), line("G", F.col("n_nationkey") + 2000000, 2, F.col("n_name"))))
            .union(c.select("r_name", "n_regionkey", F.col("c_nationkey").cast("long"), "c_custkey", line("S", F.col("c_custkey"), 4, F.col("c_name")))))
    lines = rows.select(F.col("r_name").alias("file"), (F.col("a") * 10_000_000_000 + F.col("b")).alias("line_no"), "value")
    t = parents_from_order(R.parse_kraken_report(lines), "file", "line_no", "depth", "taxid")
    return t.select("file", "taxid", "parent", "rank", "depth")


@query("kraken_output_tokens", "SRC-08",
       """SELECT event_id::VARCHAR AS read_id, CASE WHEN event_type = 'click' THEN 'A' ELSE user_id::VARCHAR END AS taxon, sum(k)::BIGINT AS hits FROM (
  SELECT *, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM events) GROUP BY ALL""")
def kraken_output_tokens(spark, sf):
    e = table(spark, sf, "events")
    tok = F.concat(F.when(F.col("event_type") == "click", "A").otherwise(F.col("user_id").cast("string")), F.lit(":"), F.regexp_extract("props", "([0-9]+)", 1))
    v = F.concat_ws("\t", F.lit("C"), "event_id", F.concat(F.lit("name (taxid "), "user_id", F.lit(")")), F.lit("150"), F.concat(tok, F.lit(" |:| 0:x")))
    p = R.parse_kraken_output(e.select(v.alias("value")))
    return p.groupBy("read_id", "taxon").agg(F.sum("hits").alias("hits"))


@query("bed_mask", "SRC-12",
       """WITH w AS (SELECT DISTINCT l_suppkey AS contig, l_partkey AS start, l_partkey + l_quantity::INTEGER AS "end" FROM lineitem), m AS (SELECT s_suppkey AS contig, (s_acctbal / 10)::INTEGER AS start, (s_acctbal / 10)::INTEGER + 50 AS "end" FROM supplier)
SELECT contig, start, "end" FROM w WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.contig = w.contig AND w.start < m."end" AND w."end" > m.start)""")
def bed_mask(spark, sf):
    w = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("contig"), F.col("l_partkey").alias("start"),
                                            (F.col("l_partkey") + F.col("l_quantity").cast("int")).alias("end")).distinct()
    at = F.bround(F.col("s_acctbal") / 10).cast("int")
    m = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("contig"), at.alias("start"), (at + 50).alias("end"))
    return R.masked_windows(w, m)


@query("offtarget_report", "AGG-21",
       """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]+)">', 1)) AS organism FROM pages)
SELECT page_id, organism, count(*) AS n FROM l GROUP BY ALL""")
def offtarget_report(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)">'), F.lit(1))).alias("organism"))
    return p.groupBy("page_id", "organism").agg(F.count(F.lit(1)).alias("n"))


@query("stored_lengths", "SRC-14",
       """SELECT count(*) FILTER (length(text) > 0) AS records, coalesce(sum(length(text)), 0)::BIGINT AS bases, coalesce(avg(length(text)) FILTER (length(text) > 0), 1.0) AS mean FROM documents""")
def stored_lengths(spark, sf):
    """The mean text length from the store of this application; only files new to it are read."""
    store = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/lengths-{hashlib.sha256(sf.encode()).hexdigest()[:16]}"
    ST.refresh(spark, f"{sf}/documents.parquet", store, ST.column_lengths("text"))
    return ST.mean_length(spark, store).drop("files")
