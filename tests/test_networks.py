import pytest
from brute import betweenness, core_numbers, max_flow, pairs, random_digraph, reachable

from pyspark.sql import functions as F

from fraygraph.operators import central, flow, graph_build as B, knockout as K, ranking, reach, removal

ROUTING = ["s1>a", "s2>a", "a>m1", "a>b", "b>m2", "s2>b", "c>m1", "m1>s1"]
NAMES = [f"v{i:03d}" for i in range(40)]


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def mesh(toy):
    edges = random_digraph(40, 170, 11)
    return edges, toy(edges, NAMES[:5], NAMES[-6:], NAMES)


def test_routing_graph(spark, toy):
    graph = toy(ROUTING, ["s1", "s2"], ["m1", "m2"]).require_disjoint_terminals()
    scenarios = spark.createDataFrame([("all",), ("no a",)], "scenario string")
    gone = spark.createDataFrame([("no a", "a")], "scenario string, v string")
    assert found(reach.reach_fraction(graph, scenarios, gone)) == [("all", 4, 1.0), ("no a", 1, 0.25)]
    assert found(flow.max_flow(graph, scenarios, gone).value) == [("all", 2), ("no a", 1)]
    assert found(reach.cut_off(graph, scenarios, gone)) == [("all", "c"), ("no a", "c"), ("no a", "m1")]
    with pytest.raises(ValueError):
        toy(ROUTING, ["s1"], ["s1"]).require_disjoint_terminals()


def test_fan_and_reversed(toy):
    fan = toy(["s>x", "s>y", "s>z", "x>m", "y>m", "z>m"], ["s"], ["m"])
    assert flow.is_layered(fan)
    assert K.intact_flow(fan) == K.intact_flow(fan, layered=False) == 3
    back = toy(["m>i", "i>s"], ["s"], ["m"])
    assert K.intact_flow(back) == 0 and reach.reachable_pair_counts(back, reach.intact_scenario(back)).first()["reachable_pairs"] == 0


def test_flow_equals_cut_and_brute_force(spark, mesh):
    edges, graph = mesh
    plain = [(a, b) for a, b, _ in edges]
    cases = {"none": [], "hub": NAMES[10:14], "many": NAMES[20:30], "source": NAMES[:2]}
    scenarios = spark.createDataFrame([(c,) for c in cases], "scenario string")
    gone = spark.createDataFrame([(c, v) for c, vs in cases.items() for v in vs], "scenario string, v string")
    got = flow.max_flow(graph, scenarios, gone)
    value = dict(found(got.value))
    cut = dict(found(flow.min_cut(graph, got, scenarios, gone).groupBy("scenario").count()))
    for name, out in cases.items():
        assert value[name] == cut.get(name, 0) == max_flow(plain, NAMES[:5], set(NAMES[-6:]), out)


def test_reach_distance_and_pair_scenarios(spark, mesh):
    edges, graph = mesh
    plain = [(a, b) for a, b, _ in edges]
    intact = reach.intact_scenario(graph)
    hops = {(s, v): d for _, s, v, d in found(reach.distances(graph, intact))}
    assert hops == {(s, v): d for s in NAMES[:5] for v, d in reachable(plain, s).items()}
    scenarios = spark.createDataFrame([("x",), ("y",)], "scenario string")
    gone = spark.createDataFrame([("x", NAMES[7]), ("y", NAMES[1])], "scenario string, v string")
    relation = found(reach.reach_relation(graph, scenarios, gone))
    for name, out in (("x", [NAMES[7]]), ("y", [NAMES[1]])):
        assert {(s, m) for c, s, m in relation if c == name} == pairs(plain, NAMES[:5], NAMES[-6:], out)


def test_whole_orders_equal_replay(spark, mesh):
    edges, graph = mesh
    plain = [(a, b) for a, b, _ in edges]
    order = [NAMES[(7 * i) % 40] for i in range(30)]
    batches = [order[i : i + 5] for i in range(0, 30, 5)]
    removed = spark.createDataFrame([(0, v, k) for k, b in enumerate(batches, 1) for v in b], "scenario long, v string, batch int")
    steps = spark.createDataFrame([(k, k / 6) for k in range(7)], "batch int, fraction_removed double")
    scenario = reach.intact_scenario(graph)
    table = found(removal.measure(graph, scenario, steps, removed, layered=False).orderBy("batch"))
    was = None
    for row in table:
        k, gone = row[1], [v for b in batches[: row[1]] for v in b]
        assert row[3] == max_flow(plain, NAMES[:5], set(NAMES[-6:]), gone)
        assert row[4] == len(pairs(plain, NAMES[:5], NAMES[-6:], gone))
        seen = set().union(*[reachable(plain, s, gone) for s in NAMES[:5] if s not in gone] or [set()])
        dark = set(NAMES) - set(gone) - seen
        assert row[5] == (None if k == 0 else len(dark - was))
        was = dark


def test_replay_case(spark, toy):
    graph = toy(["s>h", "h>a", "h>b", "a>c", "d>c"], ["s"], ["c"])
    removed = spark.createDataFrame([("one", "h", 1), ("one", "d", 2), ("two", "b", 1), ("two", "a", 2)], "scenario string, v string, batch int")
    scenarios = removed.select("scenario").distinct()
    rows = {(c, v): (r, s) for c, v, r, s in found(reach.disconnection(graph, scenarios, removed))}
    assert rows[("one", "h")] == (1, None) and rows[("one", "d")] == (2, 0)
    assert [rows[("one", v)][1] for v in "abc"] == [1, 1, 1] and rows[("two", "c")][1] == 2
    counts = reach.avalanches(reach.disconnection(graph, scenarios, removed), spark.createDataFrame([(0,), (1,), (2,)], "batch int"))
    assert [r["silenced"] for r in counts.filter("scenario = 'one'").orderBy("batch").collect()] == [1, 4, 3]


def test_lost_pairs_equal_deletion(mesh, toy):
    edges, graph = mesh
    plain = [(a, b) for a, b, _ in edges]
    whole = pairs(plain, NAMES[:5], NAMES[-6:])
    expected = {(v, s, m) for v in NAMES for s, m in whole - pairs(plain, NAMES[:5], NAMES[-6:], [v]) if v not in (s, m)}
    assert set(found(K.lost_pairs(graph))) == expected
    chain = toy(["s2>s1", "s1>m"], ["s1", "s2"], ["m"])
    assert found(K.lost_pairs(chain)) == [("s1", "s2", "m")]


def test_loss_summary_case(toy):
    graph = toy(["s1>b", "b>m1", "b>m2", "s2>a", "s2>c", "a>m1", "c>m1", "x>m2"], ["s1", "s2"], ["m1", "m2"])
    losses = K.lost_pairs(graph)
    relation = reach.reach_relation(graph, reach.intact_scenario(graph)).select("s", "m")
    rows = {r["v"]: (r["own_pairs"], r["other_pairs"]) for r in K.loss_summary(graph, losses, relation).collect()}
    assert rows == {"b": (0, 2), "s1": (2, 0), "m1": (2, 0), "m2": (1, 0), "s2": (1, 0)}
    assert K.cross_check(graph, losses, graph.vertices).isEmpty()


def test_betweenness_and_coreness(mesh, toy):
    edges, graph = mesh
    plain = [(a, b) for a, b, _ in edges]
    every = {v: x for _, v, x in found(central.betweenness(graph))}
    assert every == pytest.approx(betweenness(plain, NAMES, NAMES, NAMES))
    some = {v: x for _, v, x in found(central.betweenness(graph, restricted=True))}
    assert some == pytest.approx(betweenness(plain, NAMES, NAMES[:5], NAMES[-6:]))
    assert dict(found(central.coreness(graph.edges, graph.vertices))) == core_numbers(plain, NAMES)
    clique = toy(["a>b", "a>c", "c>d", "b>c", "d>a", "b>d", "e>a", "b>a"], ["a"], ["d"], ["f"])
    assert dict(found(central.coreness(clique.edges, clique.vertices))) == {"a": 3, "b": 3, "c": 3, "d": 3, "e": 1, "f": 0}


def test_pagerank_sums_to_one(mesh):
    _, graph = mesh
    scores = central.pagerank(graph, iterations=8, tolerance=1e-3)
    assert scores.agg(F.sum("score")).first()[0] == pytest.approx(1)


def test_adaptive_case_and_brute_force(spark, toy, mesh):
    graph = toy([("P", "Q", 9), ("P", "R", 9), ("Q", "S", 12), ("T", "P", 16), ("U", "S", 1)], ["P"], ["S"])
    gone = found(removal.adaptive_removals(graph, "out_strength", reach.intact_scenario(graph), 1, 0.01, 0.5).select("batch", "v"))
    assert [v for _, v in gone] == ["P", "Q", "U"]
    edges, graph = mesh
    rows = found(removal.adaptive_removals(graph, "in_strength", reach.intact_scenario(graph), 1, 0.05, 0.5).select("batch", "v"))
    out = set()
    for batch in range(1, max(b for b, _ in rows) + 1):
        score = {v: sum(w for a, b, w in edges if b == v and a not in out) for v in NAMES if v not in out}
        taken = [v for b, v in rows if b == batch]
        rest = [x for v, x in score.items() if v not in taken]
        assert min(score[v] for v in taken) >= max(rest)
        out |= set(taken)
    with pytest.raises(ValueError):
        central.strategy_scores("luck", graph)


def test_longer_run_keeps_prefix(spark, mesh):
    _, graph = mesh
    scenario = reach.intact_scenario(graph)
    short = found(removal.adaptive_removals(graph, "out_strength", scenario, 3, 0.05, 0.3))
    long = found(removal.adaptive_removals(graph, "out_strength", scenario, 3, 0.05, 0.6))
    assert set(short) <= set(long)


def test_edge_attack_curves(spark, mesh):
    edges, graph = mesh
    orders = removal.edge_orders(graph, 1, 5)
    removed = removal.edge_removals(orders, len(edges), 0.25)
    batches = removal.edge_batch_table(spark, len(edges), 0.25)
    scenarios = removed.select("scenario").distinct()
    table = found(removal.measure_edges(graph, scenarios, batches, removed, layered=False))
    gone = {}
    for c, a, b, k in found(removed):
        gone.setdefault(c, []).append((k, a, b))
    for c, k, _, value, count in table:
        left = [(a, b) for a, b, _ in edges if not any(x <= k and (a, b) == (p, q) for x, p, q in gone[c])]
        assert value == max_flow(left, NAMES[:5], set(NAMES[-6:])) and count == len(pairs(left, NAMES[:5], NAMES[-6:]))


def test_pool_and_synergy(spark):
    rows = zip("ABCDEF", (4, 3, 0, 2, 0, 0), (2, 1, 0, 1, 5, 3), (1.0, 0.0, 0.0, 9.0, 7.0, 7.0))
    scores = spark.createDataFrame(list(rows), "v string, flow_drop long, degree long, sm_betweenness double")
    pool = K.candidate_pool(scores, 6)
    assert [r["v"] for r in pool.orderBy("pool_rank").collect()] == list("BDAEFC")
    assert K.pool_pairs(pool, 6).count() == 15


def test_same_size_draws_are_exact(spark):
    vertices = spark.createDataFrame([(n,) for n in NAMES], "v string")
    counts = K.same_size_draws(vertices, [3, 17, 40], 10, 4, 40).groupBy("size", "draw").agg(F.countDistinct("v").alias("k"))
    assert counts.count() == 30 and counts.filter("k <> size").isEmpty()


def test_group_impact_runs_general_and_layered_alike(spark, toy):
    graph = toy(["s1>a", "s2>a", "s2>b", "a>m1", "b>m1", "b>m2", "s1>m2"], ["s1", "s2"], ["m1", "m2"])
    groups = spark.createDataFrame([("left", "a"), ("right", "b"), ("right", "s1")], "group string, v string")
    both = [found(K.group_impact(graph, groups, 4, 2, layered=x)) for x in (True, False)]
    assert both[0] == both[1]


def test_ensemble_members_do_not_mix(spark, mesh):
    edges, graph = mesh
    plain = [(a, b) for a, b, _ in edges]
    copies = graph.edges.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("g"), "src", "dst", "weight").filter("g = 0 or src <> 'v000'")
    union = B.GraphEnsemble(graph.vertices, copies, graph.terminals, spark.createDataFrame([(0,), (1,)], "g int"))
    scenarios = spark.createDataFrame([("0|t",), ("1|t",)], "scenario string")
    got = dict(found(flow.max_flow(union, scenarios).value))
    assert got["0|t"] == max_flow(plain, NAMES[:5], set(NAMES[-6:]))
    assert got["1|t"] == max_flow([e for e in plain if e[0] != "v000"], NAMES[:5], set(NAMES[-6:]))


def test_bilateral_case(spark, toy):
    graph = toy(["s>h|L", "s>h|R", "h|L>m", "h|R>m", "s>i|L", "i|L>m", "i|R>m"], ["s"], ["m"])
    sided = graph.vertices.filter("instr(v, '|') > 0").select("v", *B.split_composite("v"))
    rows = {r["label"]: (r["impact_left"], r["impact_right"], r["impact_both"]) for r in K.bilateral_impact(graph, sided).collect()}
    assert rows == {"h": (1, 1, 2), "i": (1, 0, 1)}
