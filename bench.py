"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the local cores, BENCH_REPEATS the timed runs
after one warm-up run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from caselight.plans.catalog import QUERIES  # noqa: E402
from caselight.session import local_session  # noqa: E402

HEADLINE = """
    dq_report temporal_split ticket_features features_trailing clean_ticket clean_resolution
    issue_solutions error_code_map graph_context bm25_terms bm25_search vector_topk rerank
    hybrid_retrieve quality_metrics volume_statistics sentiment_statistics issue_shares
    psi_features all_drift train_augment shadow_report agent_performance resolution_time_stats
    satisfaction_drivers weighted_f1 ensemble_route parse_labels label_prediction_log
    ticket_store stream_windows stream_dedup ingest_job
""".split()


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    elapsed = time.perf_counter() - start
    spark.catalog.clearCache()
    return elapsed


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, cpus)
    times = {}
    for name in names:
        warm = run(spark, name, sf_dir)
        # long queries are not dominated by start-up and are timed once
        runs = [run(spark, name, sf_dir) for _ in range(repeats if warm < 20 else 1)]
        times[name] = round(statistics.median(runs), 3)
        print(f"{name}: first {warm:.2f}s, then {times[name]:.2f}s", file=sys.stderr, flush=True)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rates = {}
    if "ingest_job" in times:
        rates["ingest_and_index_tickets_per_sec"] = round(documents / times["ingest_job"], 1)
    for name in ("agent_performance", "resolution_time_stats", "ticket_store", "psi_features"):
        if name in times:
            rates[f"{name}_tickets_per_sec"] = round(events / times[name], 1)
    print(json.dumps({
        "metric": "sum of median query times", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": cpus, "rates": rates,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
