"""Print plan facts of the headline queries from their physical plans:
exchanges (shuffles), broadcast exchanges, Python nodes, scans with their
read schema and pushed filters.  usage: python tools/plan_facts.py [sf_dir]"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from logweave.plans import all_queries  # noqa: E402
from logweave.session import get_session  # noqa: E402


def facts(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\].*?ReadSchema: (struct<[^>]*>)",
                       plan)
    return {
        "shuffles": len(re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)",
                                   plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "python": len(re.findall(r"(?:FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython|MapInPandas)", plan)),
        "scans": sorted({s[2] for s in scans}),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session()
    qs, _ = all_queries()
    print("| query | shuffles | broadcasts | python nodes | parquet read schemas |")
    print("|---|---|---|---|---|")
    for name in HEADLINE:
        f = facts(qs[name](spark, sf))
        print(f"| {name} | {f['shuffles']} | {f['broadcasts']} | {f['python']} | {'; '.join(f['scans'])} |")


if __name__ == "__main__":
    main()
