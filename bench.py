"""Headline jobs on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from filelake import plans  # noqa: E402
from filelake.plans import views  # noqa: E402
from filelake.session import local_session  # noqa: E402

# Job -> registered query that does the work on whole tables.
JOBS = {
    "filter_only_page": "filter_only_page",
    "search_batch": "search_batch",
    "filter_only_batch": "filter_only_batch",
    "bm25": "bm25",
    "facets_all_keys": "facet_values_all",
    "meta_not_equal": "meta_not_equal",
    "snapshot_diff": "diff_snapshots",
    "snapshot_sweep": "sweep_missing",
    "archive_expand": "entry_table",
    "pattern_scan": "scan_patterns",
    "strip_markup": "strip_markup",
    "text_windows": "text_windows",
    "video_fields": "video_fields",
    "playback_plan": "playback_plan",
    "segment_cuts": "segment_cuts",
    "asof_last": "asof_last",
    "access_sessions": "access_sessions",
}


def run(df) -> None:
    """All rows and columns are produced and none is brought to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    rounds = int(os.environ.get("BENCH_ROUNDS", "2"))
    spark = local_session(cpus, partitions=cpus, app="filelake-bench")
    run(views.scan(spark, sf_dir))
    times: dict[str, float] = {}
    start = time.perf_counter()
    views.index(spark, sf_dir)
    times["build_text_index"] = round(time.perf_counter() - start, 3)
    for job, name in JOBS.items():
        took = []
        for _ in range(rounds):
            start = time.perf_counter()
            run(plans.QUERIES[name](spark, sf_dir))
            took.append(time.perf_counter() - start)
        times[job] = round(statistics.median(took) if rounds > 2 else min(took), 3)
        print(job, times[job], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
