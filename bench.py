"""Wall-clock of the registered queries: one JSON line on standard output.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Each query runs
once to warm up and then $BENCH_RUNS times (default 3, streams once); the median counts.
A run covers planning and execution, results go to the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gleaner.plans.queries import QUERIES  # noqa: E402
from gleaner.session import build_session  # noqa: E402

HEADLINE = (
    "extract_links extract_items extract_nested extract_wrapped extract_banner extract_series "
    "page_selector_join dispatch_by_type abs_url domain_of_url charset_of_page nonblank_text "
    "fingerprint_text decode_body task_project definition_flatten ingest_quarantine landing_join "
    "result_sink scan_range_status scan_page range_assign range_split scan_assignments "
    "quota_two_stage quota_usage frontier_bfs phase_crawl paginate completeness_gate "
    "assemble_document quota_stream dedup_stream"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "gleaner-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        once(name)
        runs = 1 if name.endswith("_stream") else repeats
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    line = {
        "metric": "total wall-clock of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
