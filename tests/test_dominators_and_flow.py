"""Dominators against deletion, flows from a common start against brute force, unit paths."""

import pytest
from brute import max_flow, random_digraph, reachable

from fraygraph.operators import dominators, flow, knockout as K, ranking, reach, removal

NAMES = [f"v{i:03d}" for i in range(30)]


@pytest.fixture(scope="module")
def sparse(toy):
    edges = random_digraph(30, 62, 5)
    return [(a, b) for a, b, _ in edges], toy(edges, NAMES[:4], NAMES[-5:], NAMES)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def brute_dominators(edges, source):
    whole = reachable(edges, source)
    return {v: {x for x in whole if x in (source, v) or v not in reachable(edges, source, [x])} for v in whole}


def test_dominators_equal_deletion_on_a_cyclic_graph(sparse):
    edges, graph = sparse
    chains = dominators.dominator_chains(graph)
    got = {(r.s, r.v): [x.v for x in r.chain] for r in chains.collect()}
    wanted = {(s, v): d for s in NAMES[:4] for v, d in brute_dominators(edges, s).items()}
    assert {k: set(c) for k, c in got.items()} == wanted and all(c[0] == s and c[-1] == v for (s, v), c in got.items())
    assert any(len(c) > 3 for c in got.values())
    for r in dominators.immediate_dominators(chains).collect():
        assert len(wanted[r.s, r.v]) == r.depth + 1 and wanted[r.s, r.idom] == wanted[r.s, r.v] - {r.v}


def test_dominators_that_only_a_longer_way_round_takes_away(toy):
    """The short way s-a-b-t names a and b; the long one c-d-e-t and the loop t-b take them away late."""
    graph = toy(["s>a", "a>b", "b>t", "s>c", "c>d", "d>e", "e>t", "t>b", "t>u", "u>s", "u>w", "w>u"], ["s"], ["u", "w"], ["lone"])
    got = {r.v: [x.v for x in r.chain] for r in dominators.dominator_chains(graph).collect()}
    assert got == {"s": ["s"], "a": ["s", "a"], "b": ["s", "b"], "t": ["s", "t"], "c": ["s", "c"], "d": ["s", "c", "d"], "e": ["s", "c", "d", "e"], "u": ["s", "t", "u"], "w": ["s", "t", "u", "w"]}
    assert found(K.lost_pairs(graph)) == [("t", "s", "u"), ("t", "s", "w"), ("u", "s", "w")]
    assert found(K.lost_pairs(graph, graph.spark.createDataFrame([("u",), ("u",), (None,)], "v string"))) == [("u", "s", "w")]


def test_no_sources_no_dominators(toy):
    graph = toy(["a>b", "b>a"], [], ["b"])
    assert dominators.dominator_chains(graph).isEmpty() and K.lost_pairs(graph).isEmpty()


def test_losses_counted_twice(sparse):
    edges, graph = sparse
    relation = reach.reach_relation(graph, reach.intact_scenario(graph)).select("s", "m")
    rows = K.loss_counts_twice(graph, K.lost_pairs(graph), relation, graph.vertices.select("v")).collect()
    assert len(rows) == 30 and all(r.listed == r.deleted for r in rows) and any(r.listed for r in rows)


@pytest.fixture(scope="module")
def dense(toy):
    edges = random_digraph(30, 150, 8)
    return [(a, b) for a, b, _ in edges], toy(edges, NAMES[:4], NAMES[-5:], NAMES)


def test_unit_paths_lead_from_sources_to_targets(dense):
    edges, graph = dense
    solved = flow.max_flow(graph, reach.intact_scenario(graph))
    base = flow.unit_paths(graph, solved)
    assert base.value == max_flow(edges, NAMES[:4], set(NAMES[-5:])) and solved.rounds >= 2
    paths = {}
    for r in base.paths.collect():
        paths.setdefault(tuple(r.path), []).append((r.src, r.dst))
    net = 0
    for first, own in paths.items():
        step, at, seen = dict(own), first[0], 0
        while at in step and seen < len(own):
            at, seen = step.pop(at), seen + 1
        assert seen == len(own), "a path is one walk"
        net += (at in NAMES[-5:]) - (first[0] in NAMES[-5:])
    assert net == base.value


def test_warm_flows_equal_cold_and_brute_force(spark, dense):
    edges, graph = dense
    base = flow.unit_paths(graph, flow.max_flow(graph, reach.intact_scenario(graph)))
    names = [NAMES[i] for i in (0, 4, 7, 11, 12, 19, 25, 29)]
    rows = [(f"one {v}", v) for v in names] + [("many", v) for v in NAMES[5:14]] + [("ends", v) for v in NAMES[:3]]
    gone = spark.createDataFrame([*rows, *rows[:2]], "scenario string, v string")
    scenarios = spark.createDataFrame([(s,) for s in sorted({s for s, _ in rows} | {"nothing"})], "scenario string")
    warm = flow.max_flow(graph, scenarios, gone, base=base)
    for name, value in found(warm.value):
        assert value == max_flow(edges, NAMES[:4], set(NAMES[-5:]), [v for s, v in rows if s == name])
    carried = {s: 0 for s, in found(scenarios)}
    for s, a, b in found(warm.used):
        assert (a, b) in edges and not {a, b} & {v for x, v in rows if x == s}
        carried[s] += (b in NAMES[-5:]) - (a in NAMES[-5:])
    assert carried == dict(found(warm.value))


def test_warm_flows_under_edge_removals(spark, dense):
    edges, graph = dense
    base = flow.unit_paths(graph, flow.max_flow(graph, reach.intact_scenario(graph)))
    rows = [(k % 3, a, b) for k, (a, b) in enumerate(edges[:60])]
    dead = spark.createDataFrame(rows, "scenario long, src string, dst string")
    scenarios = spark.range(3).withColumnRenamed("id", "scenario")
    got = dict(found(flow.max_flow(graph, scenarios, removed_edges=dead, base=base).value))
    for k in range(3):
        left = [e for e in edges if (k, *e) not in rows]
        assert got[k] == max_flow(left, NAMES[:4], set(NAMES[-5:]))
