"""Adaptive runs that go on in parts, the early stop, top k against the whole order."""

import random

import pytest
from pyspark.sql import functions as F

from fraygraph.operators import ranking, reach, removal


@pytest.fixture(scope="module")
def layered(toy):
    r = random.Random(6)
    edges = {(f"s{r.randrange(5)}", f"i{r.randrange(9)}"): r.randint(1, 30) for _ in range(28)} | {(f"i{r.randrange(9)}", f"m{r.randrange(5)}"): r.randint(1, 30) for _ in range(26)}
    return toy([(a, b, w) for (a, b), w in edges.items()], [f"s{i}" for i in range(5)], [f"m{i}" for i in range(5)], [f"i{i}" for i in range(9)])


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.mark.parametrize("strategy", ["out_strength", "in_strength", "random"])
def test_a_run_in_parts_is_the_run(layered, strategy):
    one = reach.intact_scenario(layered)
    steps = len(list(ranking.removal_steps(layered.size, 0.1, 1.0)))
    whole = removal.adaptive_removals(layered, strategy, one, 17, 0.1, 1.0)
    part = removal.adaptive_removals(layered, strategy, one, 17, 0.1, 1.0, batches=range(1, 4))
    part = removal.adaptive_removals(layered, strategy, one, 17, 0.1, 1.0, part, range(4, steps + 1))
    columns = ["scenario", "v", "batch"]
    assert rows(part.select(columns)) == rows(whole.select(columns)) and whole.count() == layered.size


def test_the_longer_run_stops_below_its_bound(layered, monkeypatch):
    asked = []
    plain = removal.adaptive_removals
    monkeypatch.setattr(removal, "adaptive_removals", lambda *a, **b: (asked.append(a[-1] if len(a) == 8 else b.get("batches")), plain(*a, **b))[1])
    one = reach.intact_scenario(layered)
    curve = [(r.batch, r.flow) for r in removal.percolate(layered, "out_strength", one, 17, 0.1, 0.2, continue_until_flow_below=3).orderBy("batch").collect()]
    assert [b for b, _ in curve] == list(range(len(curve))) and curve[-1][1] < 3
    assert all(flow >= 3 for b, flow in curve[3:-1]), "the first batch below the bound ends the curve"
    assert max(b for part in asked for b in part) < len(list(ranking.removal_steps(layered.size, 0.1, 1.0)))
    short = removal.percolate(layered, "out_strength", one, 17, 0.1, 0.2).orderBy("batch").collect()
    assert [(r.batch, r.flow) for r in short] == curve[: len(short)]


@pytest.mark.parametrize("keys", [["g"], []])
def test_top_k_equals_the_whole_order(spark, keys):
    r = random.Random(2)
    data = [(r.choice(["a", "a", "a", "b", None]), r.choice([1.0, 2.0, 2.0, None, float(r.randrange(50))]), f"t{i:04d}", "own") for i in range(600)]
    df = spark.createDataFrame([*data, data[0], data[1]], "g string, x double, tie string, salt string")
    for k in (1, 7, 5000):
        for descending in (True, False):
            best = ranking.top_k(df, keys, "x", "tie", k, descending=descending)
            whole = ranking.exact_rank(df, keys, "x", "tie", descending=descending, group_rows=1000).filter(F.col("rank") <= k)
            assert best.columns == whole.columns and rows(best) == rows(whole)
    assert ranking.top_k(df.limit(0), keys, "x", "tie", 3).count() == 0
