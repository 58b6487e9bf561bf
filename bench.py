"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full through a ``noop`` sink (no collect). Prints
one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from candela.plans import catalog  # noqa: E402
from candela.session import get_session  # noqa: E402

HEADLINE = [
    "bars_daily", "bars_wide", "clean_ohlc", "quality_report",
    "features_pipeline", "features_prep", "features_backend",
    "folds", "baseline_naive", "metrics", "model_logistic", "model_comparison",
    "forecast_path", "forecast_model", "acf", "hist_returns", "box_by_year",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=cpus)
    # warm-up (JIT, file listing); not timed
    catalog.QUERIES["bars_sparse"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t = time.time()
        catalog.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus,
                      "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
