"""Delta propagation: results of replays stay (tests/test_networks.py), what is shuffled follows what changed."""

import pytest
from brute import random_digraph, reachable
from pyspark.sql import functions as F

from fraygraph.operators import reach
from fraygraph.session import settle


@pytest.mark.parametrize("steps, share", [(8, 0.5), (1, 0.5), (100, 100.0)])
def test_results_do_not_depend_on_merging(toy, monkeypatch, steps, share):
    monkeypatch.setattr(reach, "MERGE_STEPS", steps)
    monkeypatch.setattr(reach, "MERGE_SHARE", share)
    names = [f"v{i:03d}" for i in range(25)]
    edges = random_digraph(25, 45, 3)
    graph = toy(edges, names[:3], names[-3:], names)
    plain = [(a, b) for a, b, _ in edges]
    got = {(r.s, r.v): r.dist for r in reach.distances(graph, reach.intact_scenario(graph)).collect()}
    assert got == {(s, v): d for s in names[:3] for v, d in reachable(plain, s).items()}


def test_the_state_is_not_shuffled_by_a_superstep(spark, toy, monkeypatch):
    """A chain behind a wide fan: the state has 200 rows, a superstep changes one. No exchange lies between the state and its join."""
    monkeypatch.setattr(reach, "MERGE_STEPS", 100)
    plans = []
    plain = reach.settle

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    monkeypatch.setattr(reach, "settle", watched)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    edges = [("s", f"x{i:03d}", 1) for i in range(200)] + [("s", "c0", 1)] + [(f"c{i}", f"c{i + 1}", 1) for i in range(6)]
    graph = toy(edges, ["s"], ["c6"])
    found = reach.distances(graph, reach.intact_scenario(graph))
    spark.conf.set(limit, before)
    assert found.filter("v = 'c6'").first()["dist"] == 7 and found.count() == 208
    joins = [p for p in plans if "InMemoryTableScan" in p and "LeftOuter" in p]
    assert len(joins) >= 6
    for plan in joins:
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        lines = plan.splitlines()
        at = next(i for i, line in enumerate(lines) if "InMemoryTableScan" in line)
        inner, above = depth(lines[at]), []
        for line in reversed(lines[:at]):
            if depth(line) < inner:
                above.append(line)
                inner = depth(line)
        assert "Join" in next(x for x in above if "Join" in x or "Exchange" in x), plan


def test_odd_seeds(toy):
    graph = toy(["a>b", "b>a"], ["a"], ["b"], ["c"])
    empty = settle(graph.spark.createDataFrame([], "scenario long, v string, val int"))
    assert reach.propagate(empty, graph.arcs(), F.max, lambda v, cap: v, ["scenario"]).count() == 0
    twice = graph.spark.createDataFrame([(0, "a", 3), (0, "a", 5), (0, "c", 1), (1, "c", 2)], "scenario long, v string, val int")
    got = sorted(tuple(r) for r in reach.propagate(twice, graph.arcs(), F.max, lambda v, cap: v, ["scenario"]).collect())
    assert got == [(0, "a", 5), (0, "b", 5), (0, "c", 1), (1, "c", 2)]
