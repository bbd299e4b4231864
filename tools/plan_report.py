"""Per registered query: operator counts of the optimized physical plan.

usage: python tools/plan_report.py [sf_dir] [key ...]
Auto-broadcast is off, so joins show the shape they take when both sides are
large; explicit broadcasts (bounded sides) still show. Flags cartesian and
nested-loop joins, Python evaluation nodes, and aggregations that are not
hash-based (a non-fixed-width buffer such as a string ``min`` makes Spark
sort instead).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sightline.plans import registry  # noqa: E402
from sightline.session import build_session  # noqa: E402

PATTERNS = {
    "scan": r"FileScan (parquet|csv|json|text)",
    "exchange": r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)",
    "smj": r"SortMergeJoin",
    "bhj": r"BroadcastHashJoin",
    "bnlj": r"BroadcastNestedLoopJoin",
    "cartesian": r"CartesianProduct",
    "window": r"\bWindow\b",
    "expand": r"\bExpand\b",
    "sortagg": r"\bSortAggregate\b",
    "objagg": r"\bObjectHashAggregate\b",
    "python": r"(ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas)",
}


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in args if not a.startswith("/")]
    spark = build_session(
        "local[8]",
        shuffle_partitions=8,
        extra_conf={
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    qs = registry.QUERIES
    print(f"{'query':34s} " + " ".join(f"{k:>9s}" for k in PATTERNS))
    for key in keys or list(qs):
        plan = qs[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        counts = {k: len(re.findall(p, plan)) for k, p in PATTERNS.items()}
        flag = "  <-- check" if counts["cartesian"] or counts["python"] else ""
        print(f"{key:34s} " + " ".join(f"{counts[k]:9d}" for k in PATTERNS) + flag)
    spark.stop()


if __name__ == "__main__":
    main()
