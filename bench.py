"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from tallyloom.plans import registry
from tallyloom.session import build_session

HEADLINE = (
    "a9_rate_as_of", "b4_exact_duplicates", "b5_near_duplicates", "b10_decontamination_stats", "b17_vector_topk",
    "b19_curation_funnel", "c5_variant_texts", "c6_pair_verdict", "c13_stratified_group_split", "d8_pass_at_k", "d10_judge_rollup",
    "d14_gate_row", "d23_average_precision", "e4_estimate_lines", "e8_attribute_actuals", "e14_reconcile", "e17_cost_overview", "f3_stage_flow",
    "f14_silence_alarms", "f18_mine_facts", "f21_hash_chain", "f23_secret_scan", "g7_daily_metrics",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
           "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo, times = registry.queries(), {}
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM start is not a query's cost
    for name in HEADLINE:
        start = time.perf_counter()
        todo[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
