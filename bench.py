"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from ampliq.plans import REGISTRY
from ampliq.session import local_session

HEADLINE = [
    "primer_sites_mm1", "product_presence_by_library", "panel_decision", "read_level_verdict", "seed_shortlist_topk",
    "kmer_profile", "discriminating_kmers", "dominant_allele_consensus", "multi_locus_name", "lineage_consensus",
    "tiered_assignment", "clade_rollup", "abundance_supported_rank", "threshold_sweep", "diversity_by_year",
    "set_match", "connected_components", "layer_merge", "grid_144",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="ampliq-bench", memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("ampliq.spread", cpus)  # the bench files are one row group each
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not part of any query
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.time()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
