"""Headline-query benchmark.

Runs the headline queries at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
on ``local[$BENCH_CPUS]`` and prints one JSON line. Each query is executed
in full with the ``noop`` sink (every row computed, nothing collected);
the first run of a query is recorded as ``cold``, the second as the value.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "d1_detect_dialect",        # dialect tagging over whole documents
    "d6_analyze_dialects",      # tagging + one-pass profile
    "d7_balance_by_dialect",    # skew-proof quotas + augmented oversampling
    "f3_near_dedup",            # prefix-filtered similarity join + greedy resolve
    "f4_hard_negatives",        # band join by quality bucket
    "g2_exact_split",           # exact-count distributed split
    "i1_text_profile",          # text profile per split
    "i12_arabic_metrics",       # Arabic metric report, one aggregate pass
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from qalam.session import get_session
    from qalam.plans.catalog import load_all

    spark = get_session(f"local[{cpus}]", int(cpus))
    from qalam.sources.tables import SPREAD
    spark.conf.set(SPREAD, cpus)  # the bench's text tables are one row group each
    reg = load_all()
    warm, cold = {}, {}
    for name in HEADLINE:
        if name not in reg:
            continue
        for attempt in range(2):
            t0 = time.time()
            reg[name].spark_fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = round(time.time() - t0, 3)
            (cold if attempt == 0 else warm)[name] = dt
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_warm", "value": round(sum(warm.values()), 3), "unit": "sec",
                      "queries": warm, "cold": cold, "sf": sf, "cpus": int(cpus),
                      "partitions": int(spark.conf.get("spark.sql.shuffle.partitions"))}))


if __name__ == "__main__":
    main()
