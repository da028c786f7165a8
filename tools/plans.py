"""Summarise the physical plan of every registered query.

usage: python tools/plans.py [sf_dir] > PLANS.md

For each query: number of shuffles (Exchange), join strategies, windows and
whether any cartesian/nested-loop join appears, plus each Parquet scan's
pushed filters and read schema.  Star tables are left lazy here, so a view's
plan holds the builds of the tables it reads; surrogate-key steps still run
while the plan is built (they write their keyed tables).  Queries that load a
warehouse or run operators of the ``llm`` subpackage are many jobs, not one
plan, and are left out.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def summarise(plan: str) -> tuple[str, list[str]]:
    ops = Counter()
    for line in plan.splitlines():
        m = re.match(r"^[\s:+\-|]*(?:\*\(\d+\)\s*)?(\w+)", line)
        if not m:
            continue
        op = m.group(1)
        if op in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
                  "BroadcastNestedLoopJoin", "CartesianProduct", "Window", "Expand",
                  "TakeOrderedAndProject", "BroadcastExchange", "HashAggregate", "SortAggregate",
                  "ObjectHashAggregate", "Sort", "Generate", "Project", "Filter", "MapInArrow"):
            ops[op] += 1
        if op == "Exchange" and "BroadcastExchange" not in line:
            ops["Exchange"] += 1
    scans = []
    for m in re.finditer(r"FileScan parquet [^\n]*", plan):
        s = m.group(0)
        loc = re.search(r"Location: \w+\(\d+ paths\)\[([^\]]*)\]", s)
        pf = re.search(r"PushedFilters: \[([^\]]*)\]", s)
        rs = re.search(r"ReadSchema: (struct<[^>]*>)", s)
        name = os.path.basename(loc.group(1).split(",")[0]) if loc else "?"
        scans.append(f"{name}: pushed [{pf.group(1) if pf else ''}] read {rs.group(1) if rs else ''}")
    return ", ".join(f"{k}×{v}" for k, v in sorted(ops.items())), scans


def main() -> None:
    from platewise.session import build_session
    from platewise.plans import catalog

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8,
                          extra={"spark.sql.maxMetadataStringLength": "4000"})
    lazy_star = catalog.star
    catalog.star = lambda s, d: lazy_star(s, d, materialize=False)
    many_jobs = ("full_load", "load_", "incremental_", "scd2_merge_null_change", "compact_", "stored_")
    print(f"# Physical plans ({os.path.basename(sf_dir)})\n")
    print("Generated by `tools/plans.py`; AQE may still re-plan joins at runtime.\n")
    for name, q in catalog.QUERIES.items():
        if name.startswith(many_jobs):
            continue
        df = q(spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        ops, scans = summarise(plan)
        print(f"## {name}\n\n- operators: {ops or 'none'}")
        for s in sorted(set(scans)):
            print(f"- scan {s}")
        print()
    spark.stop()


if __name__ == "__main__":
    main()
