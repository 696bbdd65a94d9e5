"""Write PLANS.md: the physical-plan operators that matter for scale, per headline query.

Usage: python tests/dump_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEEP = ("Exchange", "FileScan", "Window", "Join", "HashAggregate", "TakeOrdered", "Generate",
        "FlatMapCoGroupsInPandas", "MapInPandas", "ArrowEvalPython", "ReliableCheckpoint", "Scan ExistingRDD",
        "LogicalRDD", "BatchEvalPython", "Expand")


def outline(plan: str) -> list[str]:
    out = []
    for line in plan.splitlines():
        if any(k in line for k in KEEP):
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[[^\]]*\]", "", line)
            line = re.sub(r"\[plan_id=\d+\]", "", line)
            out.append(line.rstrip()[:220])
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from bench import HEADLINE
    from lectern.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8)
    from __spark_entry__ import queries
    qs = queries()
    lines = ["# Physical plans of the headline queries", "",
             f"Generated by `tests/dump_plans.py` on `{sf}` (operators relevant to scale only; "
             "AQE may still coalesce partitions or switch join strategies at run time).", ""]
    for name in HEADLINE:
        plan = qs[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        lines += [f"## {name}", "", "```"] + outline(plan) + ["```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(lines))


if __name__ == "__main__":
    main()
