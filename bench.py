"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (full execution, no
driver collect).  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "ngram_event_table",      # flagship: log → split → masks → n-gram mining → event table
    "ngram_text_templates",   # n-gram mining over every line of every document
    "mask_types",             # 14-type mask chain over the text corpus
    "event_table",            # masked-message parse → event table
    "grouping_accuracy",      # two parses scored against truth (GA/PA/FGA/FTA)
    "correct_truth",          # ground-truth correction rules on distinct templates
    "template_match",         # line × template regex match join
    "mine_fixed",             # fixed-depth clustering in line order
    "mine_dynamic",           # dynamic-threshold clustering, constants and paths in line order
    "ngram_online",           # online n-gram (running dictionaries)
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ["BENCH_CPUS"] = cpus
    from logweave.plans import all_queries
    from logweave.session import get_session

    spark = get_session(master=f"local[{cpus}]")
    qs, _ = all_queries()
    # untimed JVM/JIT warm-up on the smallest tables (same plans, tiny data)
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    warmed = os.path.isdir(warm_dir)
    if warmed:
        for name in HEADLINE[:2]:
            qs[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        if name not in qs:
            continue
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "warmup": warmed}))


if __name__ == "__main__":
    main()
