"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The stage names follow the published pipeline stages: 01 raw rows in scope, 02 selected
and longitudinal panel, 03 feature table, 04 enriched base.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "s12_filter_entity_scope",
    "p5_harmonise_layout",
    "j1_exact_year_shift",
    "p12_coalesce_candidates",
    "j3_enrich_left_1to1",
    "a6_year_summary",
    "a9_describe",
    "a22_stratum_shares",
    "a28_variance_budget",
    "a30_spearman_year_matrix",
    "j4_reconcile",
    "m1_reconstruct_denominator",
    "m15_regression_metrics",
    "m17_bootstrap_ci",
    "m25_score_strategies",
    "t4_recall_at_k",
    "w2_guarded_lead",
    "w8_pareto_cut",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    from annalis.catalog import QUERIES
    from annalis.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):  # warm the code cache on the smallest data, as the published times are warm too
        for name in names:
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir}))


if __name__ == "__main__":
    main()
