"""Headline queries, timed end to end.  Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.plans import registry  # noqa: E402
from ledgerlens.session import build_session  # noqa: E402

HEADLINE = (
    "invoice_page", "invoice_search_text", "latest_job", "recent_audit_per_firm", "dashboard_rollup", "correlative_backfill",
    "requeue_stale_jobs", "state_replay", "party_resolution", "upload_duplicates", "review_warnings", "adapted_results",
    "json_migration_round_trip", "extract_tax_ids", "extract_amounts", "extract_items", "extract_invoices", "throughput_per_minute",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans = registry.plans()
    plans["dashboard_rollup"](spark, sf_dir).collect()  # start the JVM's compilers
    times = {}
    for name in names:
        start = time.perf_counter()
        # every column of every row is computed; nothing is collected
        plans[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
