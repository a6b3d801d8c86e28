"""A sample of registered queries against their SQL at the smallest scale; all with AMPLIQ_ALL=1."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from scripts.verify import TABLES, norm

SF = "/root/testdata/sf0.001"
SAMPLE = ["primer_sites_mm1", "member_competitor_fold", "kmer_profile", "organism_name", "lineage_consensus", "layer_merge",
          "clade_rollup", "dominant_allele_columns", "concatemer_segments", "threshold_sweep", "set_match", "gel_clashes"]
NAMES = sorted(oracle_sql()) if os.environ.get("AMPLIQ_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = queries()[name](spark, SF)
    order = sorted(df.columns)
    a = sorted(tuple(norm(r[c]) for c in order) for r in df.collect())
    cur = con.execute(oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == order
    assert a == sorted(tuple(norm(r[cols.index(c)]) for c in order) for r in cur.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0
