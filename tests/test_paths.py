"""Betweenness by levels, its estimate and the detail of knock-outs against plain Python."""

import pytest
from brute import betweenness, max_flow, pairs, random_digraph, reachable

from fraygraph.operators import central, knockout as K

NAMES = [f"v{i:03d}" for i in range(40)]


@pytest.fixture(scope="module")
def mesh(toy):
    edges = random_digraph(40, 150, 23)
    return [(a, b) for a, b, _ in edges], toy(edges, NAMES[:5], NAMES[-6:], NAMES)


def test_levels_with_removals_and_blocks(spark, mesh):
    plain, graph = mesh
    scenarios = spark.createDataFrame([("all",), ("few",)], "scenario string")
    gone = spark.createDataFrame([("few", NAMES[k]) for k in (1, 9, 17)], "scenario string, v string")
    got = {(c, v): x for c, v, x in central.betweenness(graph, scenarios, gone, source_blocks=3).collect()}
    left = [v for v in NAMES if v not in (NAMES[1], NAMES[9], NAMES[17])]
    want = {("all", v): x for v, x in betweenness(plain, NAMES, NAMES, NAMES).items()}
    want |= {("few", v): x for v, x in betweenness([e for e in plain if set(e) <= set(left)], left, left, left).items()}
    assert got == pytest.approx(want)


def test_long_chain_merges_what_was_met(toy):
    chain = toy([f"n{i:02d}>n{i + 1:02d}" for i in range(11)] + ["n11>n00"], ["n00"], ["n10"])
    got = {v: x for _, v, x in central.betweenness(chain, restricted=True).collect()}
    assert got == {f"n{i:02d}": float(0 < i < 10) for i in range(12)}


def test_no_path_scores_zero(spark, toy):
    apart = toy(["m>x", "y>s"], ["s"], ["m"])
    assert {x for _, _, x in central.betweenness(apart, restricted=True).collect()} == {0.0}


def test_estimate_keeps_its_bound(toy):
    names = [f"v{i:03d}" for i in range(150)]
    edges = random_digraph(150, 700, 5)
    graph = toy(edges, names[:3], names[-3:], names)
    exact = betweenness([(a, b) for a, b, _ in edges], names, names, names)
    rows = central.betweenness_estimate(graph, 0.4, seed=3, first=30).collect()
    assert len(rows) == 150 and 0 < rows[0]["starts"] < 150 and all(0 < r["bound"] <= 0.4 * 150 * 148 for r in rows)
    assert all(abs(r["score"] - exact[r["v"]]) <= r["bound"] for r in rows)
    whole = {r["v"]: (r["score"], r["bound"], r["starts"]) for r in central.betweenness_estimate(graph, 0.0, seed=3, first=80).collect()}
    assert {v: x for v, (x, _, _) in whole.items()} == pytest.approx(exact)
    assert {(b, n) for _, b, n in whole.values()} == {(0.0, 150)}


def test_knockout_detail(spark, mesh):
    plain, graph = mesh
    sources, targets = NAMES[:5], NAMES[-6:]
    chosen = [NAMES[k] for k in (0, 8, 15, 22, 36)]
    candidates = spark.createDataFrame([(v,) for v in [*chosen, chosen[1], "nobody", None]], "v string")
    rows = {r["v"]: r for r in K.knockout_detail(graph, candidates).collect()}
    assert sorted(rows) == chosen
    score = betweenness(plain, NAMES, sources, targets)
    before = {(s, m): reachable(plain, s)[m] for s, m in pairs(plain, sources, targets)}
    for v, r in rows.items():
        after = {(s, m): reachable(plain, s, [v])[m] for s, m in pairs(plain, sources, targets, [v])}
        assert (r["reachable_pairs"], r["pairs_lost"]) == (len(before), len(set(before) - set(after)))
        assert r["pairs_longer"] == sum(after[p] > before[p] for p in after)
        assert (r["intact_flow"], r["flow_after"]) == (max_flow(plain, sources, set(targets)), max_flow(plain, sources, set(targets), [v]))
        assert r["sm_betweenness"] == pytest.approx(score[v]) and r["share_of_shortest_routes"] == pytest.approx(score[v] / len(before))
        assert r["sm_betweenness_rank"] == 1 + sum(x > score[v] + 1e-9 for x in score.values())
        weights = {e["src"]: e["weight"] for e in graph.edges.filter(f"dst = '{v}'").collect()}
        assert [p["partner"] for p in r["strongest_inputs"]] == sorted(weights, key=lambda u: (-weights[u], u))[:5]
        assert r["in_degree"] == len(weights)


def test_knockout_detail_of_nobody(spark, mesh):
    assert K.knockout_detail(mesh[1], spark.createDataFrame([], "v string")).isEmpty()
