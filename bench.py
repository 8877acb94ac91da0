"""Headline queries, timed end to end. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4) and
BENCH_QUERIES (comma-separated names) choose what runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from proofline.plans.catalog import registered  # noqa: E402
from proofline.session import local_session  # noqa: E402

HEADLINE = (
    "run_summary", "reconcile", "nearest_date_match", "overview", "by_application", "evidence_view", "coverage",
    "project_grid", "asof_forward_match", "rebuild_cases", "followup_dataset", "case_groups", "apply_reviews",
    "frame_state", "extraction_outcome", "import_ledger", "sync_text_status", "sync_text_status_fuzzy",
    "find_id_candidates", "fuzzy_id_match", "detect_application", "content_dedup", "state_changes",
    "reminder_digest", "retention_plan", "stream_dedup", "stream_route", "stream_case_state",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "4"), "proofline-bench")
    queries = registered()
    queries["run_summary"](spark, folder).collect()  # start the session, load classes
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        # Every row is computed and dropped; nothing passes through the driver.
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({
        "metric": "headline_queries_wall_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
