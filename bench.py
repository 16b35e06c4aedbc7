"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stopwise.driver import QUERIES  # noqa: E402
from stopwise.session import get_spark  # noqa: E402

HEADLINE = (
    "route_day_reliability",
    "stop_hour_reliability",
    "weather_impacts",
    "rt_full_outer_resolve",
    "rt_delay_from_schedule",
    "scheduled_arrivals",
    "headways_scheduled",
    "headway_adherence",
    "crash_proximity",
    "access_score",
    "vulnerability",
    "trip_update_flatten",
    "weather_pivot_spine",
    "dedup_latest_crashes",
    "load_plan",
    "qa_dup_profile",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query starts the executors and the JIT; every timed query then runs once.
    QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline query time, planning included",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
