"""Time the headline queries over whole tables and print one JSON line.

Every query is run in full into the ``noop`` sink: once to warm up, then ``BENCH_RUNS`` times, and the
median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from emberline.plans.catalog import queries
from emberline.session import build_session

HEADLINE = [
    "hotspot_normalize", "hotspot_dedup", "hotspot_by_intensity", "hotspot_map_view", "hotspot_decimate",
    "fwi_now", "fwi_forecast", "fwi_trend", "fwi_layer", "grid_weather_join", "perimeters_unified",
    "perimeter_top200", "perimeter_totals", "infra_normalize", "infra_by_type", "active_fire_summary",
    "prefire_summary", "layer_freshness", "layer_metadata", "geojson_features",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, seconds = queries(), {}
    for name in names:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took[1:]), 4)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
