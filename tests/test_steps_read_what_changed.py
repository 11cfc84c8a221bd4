"""Coreness moves what fell between blocks, PageRank reads circles and what lies behind them: never the whole graph again."""

import pytest
from brute import core_numbers, random_digraph
from pyspark.sql import functions as F
from test_steps_at_size import power

from fraygraph.operators import central


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_coreness_of_many_blocks(spark, monkeypatch):
    """Several blocks, a hub, edges both ways and twice, loops, ends without a name; a step stores a row per pair of blocks at most."""
    monkeypatch.setattr(central, "BLOCK_LINKS", 60)
    stored, plain_store = [], central.store

    def store(df):
        kept = plain_store(df)
        if "origin" in df.columns:
            stored.append((kept.filter("origin < 0").count(), kept.filter("origin >= 0").count(), kept.agg(F.sum(F.length("vals"))).first()[0]))
        return kept

    monkeypatch.setattr(central, "store", store)
    names = [f"v{i:03d}" for i in range(60)]
    plain = [(a, b) for a, b, _ in random_digraph(60, 150, 5)] + [("v000", x) for x in names[1:40]] + list(zip(names[50:], names[51:]))
    rows = plain + [(b, a) for a, b in plain[:20]] + plain[:20] + [("v001", "v001"), (None, "v001"), ("v002", None)]
    edges = spark.createDataFrame(rows, "src string, dst string")
    vertices = spark.createDataFrame([(v,) for v in [*names, "alone", "v003", None]], "v string")
    want = core_numbers(plain, names)
    got = sorted((tuple(r) for r in central.coreness(edges, vertices).collect()), key=str)
    assert got == sorted([*want.items(), ("v003", want["v003"]), ("alone", 0), (None, 0)], key=str)
    blocks = stored[0][0]
    assert blocks > 3 and all(own == blocks and told <= blocks * blocks for own, told, _ in stored) and stored[-1][1] == 0
    assert len(stored) > 2 and stored[-1][2] < stored[0][2]


def test_pagerank_reads_only_circles_again(toy, monkeypatch):
    sizes, plain_settle = [], central.settle

    def settle(df):
        kept = plain_settle(df)
        sizes.append(kept.count())
        return kept

    monkeypatch.setattr(central, "settle", settle)
    names = [f"v{i:03d}" for i in range(40)]
    edges = [(names[0], v, i + 1) for i, v in enumerate(names[1:38])] + [("v038", "v039", 2), ("v039", "v038", 1), ("v039", "v001", 3)]
    graph = toy(edges, ["v000"], ["v001"], ["free"])
    scores = dict((v, s) for _, v, s in found(central.pagerank(graph, tolerance=1e-12)))
    assert scores == pytest.approx(power(edges, [*names, "free"]), abs=1e-11)
    assert sum(size > 3 for size in sizes) < 10 and len(sizes) > 30  # v038, v039 and v001 are settled again, not 41 vertices


def test_pagerank_with_a_circle_ends_in_an_error_without_steps(toy):
    with pytest.raises(RuntimeError, match="after 2 steps"):
        central.pagerank(toy([("a", "b", 1), ("b", "a", 1)], ["a"], ["b"]), tolerance=1e-13, most=2)


def test_pagerank_of_repeated_vertices(toy, spark):
    """A vertex listed twice sends twice and is listed twice, as in the steps with a fixed number."""
    graph = toy([("a", "b", 1), ("b", "c", 2), ("c", "b", 1), ("c", "d", 1)], ["a"], ["d"])
    graph.vertices = graph.vertices.unionByName(spark.createDataFrame([("a",)], "v string"))
    walks, steps = found(central.pagerank(graph, tolerance=1e-11)), found(central.pagerank(graph, iterations=160))
    assert [v for _, v, _ in walks] == ["a", "a", "b", "c", "d"]
    assert [s for *_, s in walks] == pytest.approx([s for *_, s in steps], abs=1e-9)
