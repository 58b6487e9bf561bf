"""Physical-plan summary of every lazily planned registered query -> PLANS.md.

Counts shuffles (Exchange), join strategies, windows and aggregates in the
planned (pre-AQE) physical plan, and lists scan read schemas, so plan shape
regressions (an extra shuffle, a nested-loop join, a full-width scan) show up
in review. Queries that fit models while being built are not planned here.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from candela.plans import catalog  # noqa: E402
from candela.session import get_session  # noqa: E402

NODES = ["Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
         "BroadcastNestedLoopJoin", "CartesianProduct", "Window", "WindowGroupLimit", "HashAggregate",
         "SortAggregate", "ObjectHashAggregate"]


def _strip_cached(plan: str) -> tuple[list[str], int]:
    """Drop the subtrees printed under InMemoryRelation (the cached plan is shown
    once per reference, but execution reads the cache); count the relations."""
    kept, skip_at, cached = [], None, 0
    for ln in plan.splitlines():
        indent = len(ln) - len(ln.lstrip(" :+-"))
        if skip_at is not None:
            if indent > skip_at:
                continue
            skip_at = None
        kept.append(ln)
        if "InMemoryRelation" in ln:
            cached += 1
            skip_at = indent
    return kept, cached


def summarise(plan: str) -> dict:
    lines, cached = _strip_cached(plan)
    out = {"cached": cached}
    for n in NODES:
        if n == "Exchange":
            pat = re.compile(r"(?<!Broadcast)Exchange (hashpartitioning|SinglePartition|rangepartitioning|RoundRobin)")
        else:
            pat = re.compile(rf"(?<![A-Za-z]){n}\b")
        out[n] = sum(1 for ln in lines if pat.search(ln))
    return out


def main(sf_dir: str = "/root/testdata/sf0.01") -> None:
    spark = get_session(shuffle_partitions=8)
    rows = []
    for name in sorted(catalog.ORACLE):
        df = catalog.QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        scans = sorted(set(re.findall(r"ReadSchema: (struct<[^>\n]*>?)", plan)))
        rows.append((name, s, scans))
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("# Physical plan summary (sf0.01, planned before AQE)\n\n")
        f.write("Generated by `tools/plan_report.py`. Columns count plan nodes; `shuffle` excludes broadcasts.\n")
        f.write("No query plans a CartesianProduct; nested-loop joins, where present, are listed.\n\n")
        f.write("Queries that read persisted inputs (walk-forward loops such as `knn_vote`) print the cached\n")
        f.write("plans once per read, so their counts are not comparable and are shown as `cached`.\n\n")
        f.write("| query | shuffle | bcast | BHJ | SMJ | BNLJ | cartesian | window | win-limit | agg | cached |\n")
        f.write("|---|---|---|---|---|---|---|---|---|---|---|\n")
        for name, s, _ in rows:
            if s["cached"]:
                f.write(f"| {name} | cached | | | | | | | | | {s['cached']} |\n")
                continue
            agg = s["HashAggregate"] + s["SortAggregate"] + s["ObjectHashAggregate"]
            f.write(f"| {name} | {s['Exchange']} | {s['BroadcastExchange']} | {s['BroadcastHashJoin']} | "
                    f"{s['SortMergeJoin']} | {s['BroadcastNestedLoopJoin']} | {s['CartesianProduct']} | "
                    f"{s['Window']} | {s['WindowGroupLimit']} | {agg} | {s['cached']} |\n")
        f.write("\n## Scan read schemas\n\n")
        seen = {}
        for name, _, scans in rows:
            for sc in scans:
                seen.setdefault(sc, []).append(name)
        for sc, names in seen.items():
            f.write(f"* `{sc}`: {len(names)} queries\n")
    print(f"wrote PLANS.md ({len(rows)} queries)")


if __name__ == "__main__":
    main(*sys.argv[1:])
