"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3; the
median after one warm-up run).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from wattscope.plans import catalog
from wattscope.session import build_session

HEADLINE = (
    "valid_events", "latest_reading", "plant_metrics", "windowed_plant_metrics",
    "portfolio_metrics", "alert_conditions", "alert_incidents", "energy_increments",
    "plant_actuals", "reconcile_summary", "daily_report", "scenario_range_join", "stream_valid",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.log.level": "ERROR",
        "spark.ui.showConsoleProgress": "false"})
    queries = catalog.queries()

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timings = {}
    for name in only:
        once(name)
        timings[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    record = {"metric": "headline query time", "value": round(sum(timings.values()), 3),
              "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
              "cpus": int(cpus), "events": events}
    if "stream_valid" in timings:
        record["stream_events_per_sec"] = round(events / timings["stream_valid"])
    print(json.dumps(record))
    spark.stop()


if __name__ == "__main__":
    main()
