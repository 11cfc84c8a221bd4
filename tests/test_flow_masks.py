"""Rounds of flow: scenarios share masks, tokens at different vertices do not all take the same way."""

from brute import max_flow, random_digraph

from fraygraph.operators import flow, knockout, reach

NAMES = [f"v{i:03d}" for i in range(16)]


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_scenarios_of_several_words_share_rows(spark, toy, monkeypatch):
    edges = random_digraph(16, 60, 3)
    graph = toy(edges, NAMES[:3], NAMES[-3:])
    gone = [(f"{a}{b}", v) for i, a in enumerate(NAMES[:12]) for b in NAMES[i + 1:12] for v in {a, b}]
    names = sorted({s for s, _ in gone})
    assert len(names) > reach.WORD
    sizes, levels = [], flow._levels

    def counted(*args):
        found_levels = levels(*args)
        sizes.extend(rows.count() for rows in found_levels)
        return found_levels

    monkeypatch.setattr(flow, "_levels", counted)
    scenarios = spark.createDataFrame([(s,) for s in names], "scenario string")
    removed = spark.createDataFrame(gone, "scenario string, v string")
    solved = flow.max_flow(graph, scenarios, removed)
    plain = [(a, b) for a, b, _ in edges]
    assert dict(found(solved.value)) == {s: max_flow(plain, NAMES[:3], set(NAMES[-3:]), [v for n, v in gone if n == s]) for s in names}
    assert 0 < max(sizes) <= 2 * len(NAMES)  # 66 scenarios fill two masks


def test_null_scenarios_lose_nothing(spark, toy):
    graph = toy(["s>a", "a>b", "b>a", "b>m", "s>c", "c>m"], ["s"], ["m"])
    removals = spark.createDataFrame([(1, "a"), (2, "s"), (None, "c"), (None, "b"), (1, "a")], "scenario int, v string")
    drops = {s: (f, d) for s, f, d in knockout.flow_drops(graph, removals, False).collect()}
    assert drops == {1: (1, 1), 2: (0, 2), None: (2, 0)}


def test_ways_of_equal_length_are_found_in_few_rounds(toy):
    # Every q has a unit to fetch from any p: if all ask the first p, a round brings one unit.
    k = 16
    ways = [(f"p{i:02d}", f"q{j:02d}") for i in range(k) for j in range(k)]
    edges = [f"s>p{i:02d}" for i in range(k)] + [f"{a}>{b}" for a, b in ways] + [f"q{j:02d}>m" for j in range(k)]
    graph = toy(edges, ["s"], ["m"])
    solved = flow.max_flow(graph, reach.intact_scenario(graph))
    assert solved.value.first()["flow"] == k and solved.rounds <= k // 2
