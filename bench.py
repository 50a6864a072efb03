"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is executed to completion with the ``noop`` sink (full execution, nothing collected);
the reported time per query is the best of ``BENCH_REPEAT`` runs (default 2, the first one warms
the JVM). ``BENCH_ALL=1`` runs every registered query instead of the headline set.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "exposure_split", "claims_attached", "nway_1", "nway_2", "nway_all_pairs", "nway_coverage_code",
    "pnt11_combined", "trial_balance_opening", "balance_sheet", "profit_loss", "cash_flow_indirect",
    "validate_columns", "claims_reconcile", "exposure_reconcile", "low_cardinality", "reg_no_standardized", "clean_table", "snapshot_diff",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    from riskframe.session import get_spark
    # one shuffle partition per core at this scale; AQE coalesces further (clusters size this from
    # the data: spark.sql.shuffle.partitions ≈ shuffle bytes / 128 MB)
    shuffle = os.environ.get("BENCH_SHUFFLE", cpus)
    spark = get_spark(master=f"local[{cpus}]", **{"spark.sql.shuffle.partitions": shuffle,
                                                     "spark.riskframe.spread": "true"})
    from riskframe.plans.queries import REGISTRY
    names = list(REGISTRY) if os.environ.get("BENCH_ALL") == "1" else [n for n in HEADLINE if n in REGISTRY]
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
