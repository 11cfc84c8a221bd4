"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from fraygraph.plans import catalogue, graphs, supply
from fraygraph.session import local_session

HEADLINE = [
    "ag1_aggregate_edges", "pf4_threshold_edges", "io7_two_granularities", "j1_label_connections", "w4_exact_rank_large",
    "fl3_flow_curves", "rm3_random_percolation", "rm4_edge_attack", "fl1_flow_layered", "fl1_flow_general", "ko2_pair_synergy",
    "ko3_group_impact", "pf4_supply_edges", "ct1_supply_degrees", "rc2_supply_reach", "ct3_supply_pagerank", "dm1_supply_dominators",
    "ct5_restricted_betweenness", "rm2_adaptive_out_strength", "stm_rank_test", "sts_signed_rank", "stp_power_law_fit", "ag14_histogram",
]


def graph_sizes(spark, sf: str) -> dict[str, list[int]]:
    """Vertices and edges of the graphs that headline queries run on; an empty one would measure nothing."""
    sizes = {}
    for name, graph in (("supply", supply.supply(spark, sf)), ("trade", graphs.trade(spark, sf)), ("switch", graphs.switch(spark, sf))):
        sizes[name] = [graph.size, graph.edges.count()]
        if sizes[name][1] == 0:
            raise RuntimeError(f"the graph {name} has no edges at {sf}")
    return sizes


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    sizes = graph_sizes(spark, sf)  # also starts the workers before timing
    times = {}
    for name in names:
        graphs.forget()  # every query builds its own graph
        start = time.time()
        catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "graphs": sizes, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
