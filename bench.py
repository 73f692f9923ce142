"""Time the headline queries: python bench.py prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local threads. A query's time is the least
of its runs after one that warms the session; results are computed whole and thrown away (the "noop" sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

from stratalog.plans import catalog
from stratalog.session import local_session

HEADLINE = [
    *("gql_select_filter_order_limit gql_group_by_having gql_join_group_order component_signature_scan changed_since as_of_tick".split()),
    *("scrub_series living_state delta_capture fold_last_write_wins resimulate_inputs divergence_first_tick causal_previous_write".split()),
    *("relation_degree has_relation range_box range_sphere distance_join subscriptions_inside subscriber_delta_lod enter_leave".split()),
    *("vision_cone chunk_priority_topk utility_score fixed_point obstacle_patch state_hash".split()),
]
RUNS = 2


def main() -> int:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus)
    times: dict[str, float] = {}
    run = lambda f: f(spark, sf).write.format("noop").mode("overwrite").save()
    run(catalog.queries()["as_of_tick"])
    for name in HEADLINE:
        best = None
        for _ in range(RUNS):
            start = time.perf_counter()
            run(catalog.queries()[name])
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
