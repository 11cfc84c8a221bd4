"""Degree-preserving randomized graphs and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraygraph.operators import curves, removal
from fraygraph.operators.graph_build import Graph, GraphEnsemble
from fraygraph.operators.ranking import number_within, random_key
from fraygraph.session import settle, store


def rewire(edges: DataFrame, nulls: int, seed: int, swaps_per_edge: int = 10) -> DataFrame:
    """(g, src, dst, weight) for g in 0..nulls-1: simple directed graphs with every in- and out-degree kept.

    Parallel rounds: all edges of a member are paired at random, a pair (a->b, c->d) proposes (a->d, c->b), and a
    proposal stands if it makes no loop, no edge that exists and none that another pair proposes. A round tries half
    as many swaps as there are edges, so 2 * swaps_per_edge rounds try swaps_per_edge swaps per edge.
    """
    members = F.explode(F.sequence(F.lit(0), F.lit(nulls - 1))).alias("g")
    size = edges.count()
    state = store(edges.select(members, "src", "dst"))
    for step in range(2 * swaps_per_edge):
        keyed = state.withColumn("_key", random_key(seed, F.lit(step), "g", "src", "dst"))
        paired = number_within(keyed, ["g"], ["_key"], "n", group_rows=size).withColumn("pair", F.floor((F.col("n") - 1) / 2))
        ends = F.struct("n", "src", "dst")
        pairs = paired.groupBy("g", "pair").agg(F.min(ends).alias("x"), F.max(ends).alias("y"))
        swap = (
            (F.col("x.src") != F.col("y.src")) & (F.col("x.dst") != F.col("y.dst"))
            & (F.col("x.src") != F.col("y.dst")) & (F.col("y.src") != F.col("x.dst"))
        )
        edge = lambda a, b, proposed: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(proposed).alias("proposed"))
        old = F.when(F.col("x.n") == F.col("y.n"), F.array(edge("x.src", "x.dst", 0))).otherwise(
            F.array(edge("x.src", "x.dst", 0), edge("y.src", "y.dst", 0))
        )
        new = F.array(edge("x.src", "y.dst", 1), edge("y.src", "x.dst", 1))
        rows = pairs.withColumn("try", swap).withColumn("e", F.explode(F.when(swap, F.concat(old, new)).otherwise(old)))
        rows = rows.select("g", "pair", "try", "e.*")
        crowd = F.count(F.lit(1)).over(Window.partitionBy("g", "src", "dst"))
        judged = rows.withColumn("_fits", (F.col("proposed") == 0) | (crowd == 1))
        kept = judged.groupBy("g", "pair").agg(
            (F.first("try") & F.bool_and("_fits")).alias("accept"), F.collect_list(F.struct("src", "dst", "proposed")).alias("e")
        )
        chosen = F.filter("e", lambda x: x["proposed"] == F.when(F.col("accept"), 1).otherwise(0))
        state = store(kept.select("g", F.explode(chosen).alias("e")).select("g", "e.src", "e.dst"))
    return reassign_weights(edges, state, nulls, seed)


def reassign_weights(edges: DataFrame, rewired: DataFrame, nulls: int, seed: int) -> DataFrame:
    """Deal each source's old weights to its new edges in random order, which keeps every out-strength."""
    members = F.explode(F.sequence(F.lit(0), F.lit(nulls - 1))).alias("g")
    old = edges.select(members, "src", "dst", "weight").withColumn("_key", random_key(seed, F.lit("w"), "g", "src", "dst"))
    old = number_within(old, ["g", "src"], ["_key"], "k").select("g", "src", "k", "weight")
    new = number_within(rewired, ["g", "src"], ["dst"], "k")
    return store(new.join(old, ["g", "src", "k"]).select("g", "src", "dst", "weight"))


def ensemble(graph: Graph, nulls: int, seed: int, swaps_per_edge: int = 10) -> GraphEnsemble:
    edges = rewire(graph.edges, nulls, seed, swaps_per_edge)
    members = graph.spark.range(nulls).select(F.col("id").cast("int").alias("g"))
    union = GraphEnsemble(graph.vertices, edges, graph.terminals, members)
    union.vertices, union.edges, union.terminals = settle(union.vertices), settle(union.edges), settle(union.terminals)
    return union


def random_ensemble_curves(union: GraphEnsemble, nulls: int, trials: int, seed: int, batch_fraction: float = 0.01) -> DataFrame:
    """Random removal curves (scenario = 'g|trial') of every member in one job."""
    scenarios = settle(
        union.spark.range(nulls).select(F.col("id").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
        .select(F.concat_ws("|", "g", "trial").alias("scenario"))
    )
    batches = settle(removal.schedule_table(union.spark, union.size, batch_fraction))
    order = removal.static_order(union.spread(union.vertices, scenarios).withColumn("score", F.lit(0)), seed, union.size)
    return removal.measure(union, scenarios, batches, removal.batch_of_rank(order, batches), layered=False)


def adaptive_ensemble_curves(union: GraphEnsemble, nulls: int, strategy: str, seed: int, batch_fraction: float = 0.01) -> DataFrame:
    scenarios = settle(union.spark.range(nulls).select(F.concat_ws("|", "id", F.lit(strategy)).alias("scenario")))
    return removal.percolate(union, strategy, scenarios, seed, batch_fraction, layered=False)


def score_ensemble(points: DataFrame, strategy: str) -> DataFrame:
    """(g, strategy, trials, auc_flow, auc_reachability, intact_flow, intact_pairs): trial means per member."""
    window = curves.auc_window(points, ["scenario"])
    values = {"flow": "auc_flow", "reachable_pairs": "auc_reachability"}
    aucs = curves.normalized_auc(window, ["scenario"], "fraction_removed", values)
    intact = points.filter("batch = 0").select("scenario", F.col("flow").alias("intact_flow"), F.col("reachable_pairs").alias("intact_pairs"))
    member = F.substring_index("scenario", "|", 1).cast("int").alias("g")
    return aucs.join(intact, "scenario").groupBy(member, F.lit(strategy).alias("strategy")).agg(
        F.count(F.lit(1)).alias("trials"), F.avg("auc_flow").alias("auc_flow"), F.avg("auc_reachability").alias("auc_reachability"),
        F.first("intact_flow").alias("intact_flow"), F.first("intact_pairs").alias("intact_pairs"),
    )
