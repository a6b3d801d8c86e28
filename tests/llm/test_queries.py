"""Queries with SQL against DuckDB, and the pipeline against brute force, at the smallest scale."""

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from ampliq.llm import quality
from scripts.verify import TABLES, norm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_topk_search", "op5_warc", "op7_exact_dedup", "op11_conversation_repair", "op12_conversation_trie"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    order = sorted(df.columns)
    cur = con.execute(oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == order
    assert sorted(tuple(str(norm(r[c])) for c in order) for r in df.collect()) == sorted(tuple(str(norm(r[cols.index(c)])) for c in order) for r in cur.fetchall())


def test_every_operator_is_registered():
    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in queries()


def test_pipeline_keeps_one_of_each_group(spark):
    from .test_operators import brute_join, groups_of
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("llm_score", docs_clash())
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = [(r.doc_id, r.text) for r in quality.scored(docs, model, out="s").where("s >= 0.5").collect()]
    firsts = {v[0] for v in groups_of(good).values()}
    unique = [(d, t) for d, t in good if d in firsts]
    want = {d for d, c, _, _ in brute_join(unique) if d == c}
    got = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(got) == sorted(want)
    mixed = corpus_pipeline.STAGES[3][1](spark, kept, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == want
    last = corpus_pipeline.STAGES[4][1](spark, mixed, SF)
    assert last.count() == mixed.count() and last.where("not round_trip").count() == 0


def docs_clash():
    from pyspark.sql import functions as F
    return F.lit("clash")
