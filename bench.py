"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the input
and the local parallelism.  Each query runs to completion twice into a sink that
discards rows; the faster run counts, so code generation is not measured twice.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfmark.plans.registry import load_all  # noqa: E402
from shelfmark.session import build_session  # noqa: E402

HEADLINE = (
    "dup_exact_groups dup_canonical dup_metrics dup_consolidate fuzzy_names_ratio report_overview report_file_types "
    "report_extensions report_size_hist report_timeline_modified report_folder_rollup report_largest_files "
    "classify_pattern classify_pattern_big classify_category classify_keywords classify_content classify_phrases "
    "registry_overview registry_by_type registry_state_counts review_list accuracy_metrics category_accuracy drift_7d "
    "plan_full plan_conflict_names plan_domains plan_sync latest_change_state reconcile_hash compare_roots cross_root_dups "
    "text_stats text_keywords html_text pii_flags register_batch activity_runs rate_limits"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        int(cpus),
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()
    seconds = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    files_per_second = round(spark.read.parquet(f"{folder}/lineitem.parquet").count() / seconds["classify_pattern_big"])
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "rule_classification_files_per_sec": files_per_second,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
