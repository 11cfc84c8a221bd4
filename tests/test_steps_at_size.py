"""Steps over large graphs read what changed: walks that end, links of vertices that fell, draws and arcs dealt to tasks."""

import pytest
from brute import core_numbers

from fraygraph.operators import central, graph_build, reach, tails


def found(df):
    return sorted(tuple(r) for r in df.collect())


def power(edges, names, steps=400):
    """PageRank by steps in plain Python."""
    out = {v: sum(w for a, _, w in edges if a == v) for v in names}
    x = dict.fromkeys(names, 1 / len(names))
    for _ in range(steps):
        free = 0.15 + 0.85 * sum(x[v] for v in names if not out[v])
        y = dict.fromkeys(names, free / len(names))
        for a, b, w in edges:
            y[b] += 0.85 * x[a] * w / out[a]
        x = y
    return x


def test_pagerank_without_circles_ends_with_the_longest_walk(toy):
    edges = [("a", "b", 3), ("a", "c", 1), ("b", "c", 2), ("c", "d", 1), ("e", "c", 1)]
    scores = dict((v, s) for _, v, s in found(central.pagerank(toy(edges, ["a"], ["d"], ["f"]), tolerance=1e-13, most=1)))
    assert scores == pytest.approx(power(edges, "abcdef"), abs=1e-12)


def test_pagerank_with_a_circle_of_links_dealt_to_tasks(toy, monkeypatch):
    monkeypatch.setattr(central, "hint_small", lambda df: df)
    edges = [("a", "b", 3), ("b", "c", 2), ("c", "b", 1), ("c", "d", 1), ("e", "a", 1)]
    scores = dict((v, s) for _, v, s in found(central.pagerank(toy(edges, ["a"], ["d"], ["f"]), tolerance=1e-3)))
    assert scores == pytest.approx(power(edges, "abcdef"), abs=2e-3)


def test_coreness_of_falling_chains(spark):
    # A clique with a chain whose values fall from the loose end, one neighbour a step.
    names = [f"v{i:02d}" for i in range(14)]
    plain = [(a, b) for a in names[:4] for b in names[:4] if a < b] + list(zip(names[3:], names[4:])) + [("v05", "v07"), ("v06", "v08")]
    edges = spark.createDataFrame(plain, "src string, dst string")
    vertices = spark.createDataFrame([(v,) for v in names], "v string")
    assert dict(found(central.coreness(edges, vertices))) == core_numbers(plain, names)
    assert found(central.coreness(edges.limit(0), vertices.limit(2))) == [("v00", 0), ("v01", 0)]


def test_simulations_are_dealt_to_tasks(spark, monkeypatch):
    plans = []

    def settle(df):
        if "sim" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.localCheckpoint()

    monkeypatch.setattr(tails, "settle", settle)
    hist = spark.createDataFrame([("d", v, n) for v, n in ((1, 40), (2, 20), (3, 12), (5, 6), (9, 3), (30, 1))], "d string, value long, n long")
    fits = tails.fit_power_law(hist, ["d"])
    row = tails.bootstrap(hist, fits, ["d"], 30, 1).first()
    assert row["sims"] == 30 and 0 <= row["p_value"] <= 1
    assert any("hashpartitioning(sim" in p for p in plans)


def test_arcs_of_a_large_graph_are_dealt_once(toy, monkeypatch):
    monkeypatch.setattr(graph_build, "hint_small", lambda df: df)
    graph = toy(["s>a", "a>b", "b>m", "b>a"], ["s"], ["m"])
    assert graph.arcs() is graph.arcs() and graph.arcs().storageLevel.useMemory
    assert reach.reachable_pair_counts(graph, reach.intact_scenario(graph)).first()["reachable_pairs"] == 1
