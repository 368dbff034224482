"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the data folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chronoloom.queries import all_queries  # noqa: E402
from chronoloom.session import local_session  # noqa: E402

HEADLINE = (
    "time_features",
    "seasonal_hour",
    "daily_resample",
    "daily_interpolate",
    "limited_gap_fill",
    "linear_fill",
    "lag_features",
    "split_80_20",
    "sliding_windows",
    "tail_head",
    "combine_sources",
    "time_diff",
    "stat_summary",
    "iqr_outliers",
    "describe",
    "describe_by_series",
    "corr_matrix",
    "histogram",
    "zscore",
    "minmax",
    "dup_timestamps",
    "cadence_gaps",
    "preprocess_upload",
    "batch_preparation",
    "recursive_naive",
    "recursive_linear",
    "recursive_predictor",
    "accuracy",
    "history_recent",
    "history_filtered",
    "settings_upsert",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    queries = all_queries()
    # One query on the same data first, so that no timing pays for starting the JVM.
    queries["seasonal_month"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
