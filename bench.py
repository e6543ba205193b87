"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every query is planned and
run in full (its rows are written to the no-op sink); the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hostlens.plans.queries import QUERIES  # noqa: E402
from hostlens.session import session_builder  # noqa: E402

HEADLINE = [
    "dedup_samples",
    "ingest_receipts",
    "validate_samples",
    "envelope_ingest",
    "mask_cpu_baseline",
    "latest_samples",
    "list_processes",
    "instance_history",
    "history",
    "host_summary",
    "host_activity",
    "metrics_summary",
    "kpi_summary",
    "current_rules",
    "evaluate_alerts",
    "alert_states",
    "alert_transitions",
    "notification_outbox",
    "incident_summary",
    "incident_timeline",
    "incident_evidence",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        session_builder("hostlens-bench")
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    line = {"metric": "headline queries, total time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
