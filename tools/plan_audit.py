"""Physical-plan audit of every registered query: shuffles, join strategies and forbidden nodes.

Usage: python tools/plan_audit.py [sf_dir] > PLANS.md

Counts operators in the executed (AQE initial) plan of each query: hash/round-robin exchanges,
broadcasts, sort-merge and broadcast-hash joins, windows, expands, generators and aggregates,
and flags Python evaluation, cartesian products and nested-loop joins (none are expected).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NODES = {
    "shuffle": r"Exchange hashpartitioning",
    "round_robin": r"Exchange RoundRobinPartitioning",
    "broadcast": r"BroadcastExchange",
    "smj": r"SortMergeJoin",
    "bhj": r"BroadcastHashJoin",
    "window": r"\bWindow \[",
    "expand": r"\bExpand \[",
    "generate": r"\bGenerate ",
    "hash_agg": r"HashAggregate\(",
    "sort_agg": r"SortAggregate\(",
}
FORBIDDEN = {
    "python_udf": r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas",
    "cartesian": r"CartesianProduct",
    "nested_loop": r"BroadcastNestedLoopJoin",
}


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def audit(df) -> dict[str, int]:
    text = plan_text(df)
    initial = text.split("== Initial Plan ==")[-1]
    out = {k: len(re.findall(p, initial)) for k, p in NODES.items()}
    out.update({k: len(re.findall(p, text)) for k, p in FORBIDDEN.items()})
    return out


def main() -> None:
    from riskframe.plans.queries import REGISTRY
    from riskframe.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark()
    cols = list(NODES) + list(FORBIDDEN)
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `tools/plan_audit.py` on `{sf}` (AQE initial plan; at run time AQE may turn a")
    print("sort-merge join into a broadcast join when a side proves small, and coalesces partitions).\n")
    print("| query | " + " | ".join(cols) + " |")
    print("|---|" + "---|" * len(cols))
    for name, fn in REGISTRY.items():
        a = audit(fn(spark, sf))
        print(f"| {name} | " + " | ".join(str(a[c]) for c in cols) + " |")


if __name__ == "__main__":
    main()
