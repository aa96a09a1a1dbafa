"""Headline queries, timed cold: every query builds its own panel, nothing is shared between them."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import checks.all  # noqa: E402,F401
from checks.registry import CASES  # noqa: E402
from realcurve.session import local_session  # noqa: E402

HEADLINE = [
    "bond_metrics", "bond_walk_monthly", "pair_breakeven", "leg_walk", "tenor_returns", "seasonal_agg", "event_summary_us",
    "walk_forward_ratio", "closest_nominal", "bucket_series", "cycle_distribution", "outlier_report", "issuance_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    CASES["trading_calendar"].spark(spark, sf_dir, fresh=True).count()  # start the workers
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        CASES[name].spark(spark, sf_dir, fresh=True).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
