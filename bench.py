"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. With
``BENCH_QUERIES=all`` every registered query is timed, or a comma list is taken.
Each figure is the median of ``BENCH_RUNS`` warm runs (default 3).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from calibra.plans.catalog import all_queries
from calibra.session import build_session

HEADLINE = (
    "class_registry",
    "purge_rows",
    "dist_stages",
    "dedup_rows",
    "profile_columns",
    "recommend",
    "free_text",
    "correlation_matrix",
    "histograms",
    "box_by_class",
    "impute_median",
    "standardize",
    "one_hot",
    "stratified_split",
    "kfold_assign",
    "sample_weights",
    "oversample_counts",
    "smote_counts",
    "adasyn_ratio",
    "knn_classify",
    "macro_metrics",
    "roc_auc_ovr",
    "per_class_tiers",
    "cv_summary",
    "train_gbt",
    "validate_rows",
    "proba_trim",
    "result_detail",
    "glossary_enrich",
    "review_prompts",
    "csv_intake",
    "history_query",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    builders = all_queries()
    names = list(builders) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = build_session(
        f"local[{cpus}]",
        "calibra-bench",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for attempt in range(runs + 1):
            start = time.perf_counter()
            builders[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:  # the first run warms code and file caches
                taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
