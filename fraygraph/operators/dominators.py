"""Dominators of every source: which vertices lie on all paths from a source to a vertex.

The state has one row per (source, reached vertex) with its dominators in path order; no vertex is ever a scenario. It starts
from the shortest-path layers, where a vertex has the dominators that all its predecessors one hop nearer share, layer by
layer. The other edges can only take dominators away: rows with such an edge are taken again from all their predecessors, and
from then on only rows behind a row that changed, until none does. Started above the greatest fixpoint and only ever lowered,
the result is the dominator relation itself, on cyclic graphs too.

What all predecessors share is found by counting: a candidate stays if as many predecessors name it as the vertex has. Counts
are combined before the shuffle, so a vertex with many predecessors is never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraygraph.operators import reach
from fraygraph.operators.graph_build import Graph
from fraygraph.session import hint_small, settle, store


def _shared(named: DataFrame, needed: str) -> DataFrame:
    """(s, v, chain) of rows (s, v, dist, ``needed``, chain), one per predecessor: what all ``needed`` of them name, and v."""
    named = named.select("s", "v", "dist", needed, F.explode("chain").alias("x"))
    counted = named.groupBy("s", "v", "dist", needed, "x").agg(F.count(F.lit(1)).alias("n"))
    kept = F.array_sort(F.collect_list(F.when(F.col("n") == F.col(needed), F.col("x"))))
    own = F.array(F.struct(F.col("dist").alias("hops"), F.col("v").alias("v")))
    return counted.groupBy("s", "v", "dist").agg(kept.alias("chain")).select("s", "v", F.concat("chain", own).alias("chain"))


def dominator_chains(graph: Graph) -> DataFrame:
    """(s, v, chain): per source and reached vertex the array of (hops, v) of its dominators, from s to v itself."""
    arcs = graph.arcs()
    hops = settle(reach.distances(graph, reach.intact_scenario(graph)).drop("scenario"))
    into = hops.select("s", F.col("v").alias("src"), "dist").join(arcs, "src").groupBy("s", F.col("dst").alias("v"), "dist").agg(F.count(F.lit(1)).alias("n"))
    into = into.groupBy("s", "v").agg(F.sum("n").alias("preds"), F.min_by("n", "dist").alias("nearest"))
    # A source is its own only dominator, whatever leads back to it.
    wanted = settle(hops.filter("dist > 0").join(into, ["s", "v"]))
    layer = settle(hops.filter("dist = 0").select("s", "v", F.array(F.struct(F.col("dist").alias("hops"), F.col("v").alias("v"))).alias("chain")))
    layers, depth = [layer], 0
    while True:
        depth += 1
        here = wanted.filter(F.col("dist") == depth).select("s", "v", "dist", "nearest")
        named = layer.withColumnRenamed("v", "src").join(arcs, "src").select("s", F.col("dst").alias("v"), "chain").join(here, ["s", "v"])
        layer = store(_shared(named, "nearest"))
        if layer.isEmpty():
            break
        layers.append(layer)
    state = layers[0]
    for layer in layers[1:]:
        state = state.unionByName(layer)
    state = store(state)
    open_rows = settle(wanted.filter("preds > nearest").select("s", "v"))
    while not open_rows.isEmpty():
        here = wanted.join(open_rows, ["s", "v"]).select("s", F.col("v").alias("dst"), "dist", "preds")
        named = here.join(arcs, "dst").join(state.withColumnRenamed("v", "src"), ["s", "src"])
        taken = _shared(named.select("s", F.col("dst").alias("v"), "dist", "preds", "chain"), "preds")
        old = state.select("s", "v", F.size("chain").alias("before"))
        changed = store(taken.join(old, ["s", "v"]).filter(F.size("chain") < F.col("before")).drop("before"))
        if changed.isEmpty():
            break
        state = store(state.join(changed.select("s", "v"), ["s", "v"], "left_anti").unionByName(changed))
        behind = changed.select("s", F.col("v").alias("src")).join(arcs, "src").select("s", F.col("dst").alias("v")).distinct()
        open_rows = settle(behind.filter("s <> v"))
    return state


def immediate_dominators(chains: DataFrame) -> DataFrame:
    """(s, v, idom, depth) of every reached vertex but the source: its parent and depth in the dominator tree."""
    deep = chains.filter(F.size("chain") > 1)
    return deep.select("s", "v", F.element_at("chain", -2)["v"].alias("idom"), (F.size("chain") - 1).alias("depth"))


def losses_of_chains(graph: Graph, chains: DataFrame) -> DataFrame:
    """(v, s, m): vertices that cut a target off from a source, neither of the two: the inner dominators of the target."""
    ends = chains.join(hint_small(settle(graph.targets)), "v", "left_semi").filter(F.size("chain") > 2)
    inner = F.explode(F.slice("chain", 2, F.size("chain") - 2))
    return ends.select("s", F.col("v").alias("m"), inner.alias("x")).select(F.col("x.v").alias("v"), "s", "m")
