"""Removal protocols: orders, adaptive runs, edge attacks and the curves they leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraygraph.operators import central, flow, reach
from fraygraph.operators.graph_build import Graph
from fraygraph.operators.ranking import batch_of_rank, exact_rank, random_key, removal_steps, schedule_table
from fraygraph.session import hint_small, settle, store

EDGE_ORDERS = ("strongest", "weakest", "random")


def run_seed(strategy_index, trial, base: int = 42):
    """Seed of a run: a thousand apart per strategy, one apart per trial."""
    return F.lit(base) + F.lit(1000) * strategy_index + trial


def static_order(scores: DataFrame, seed, group_rows: int) -> DataFrame:
    """(scenario, v, rank): highest score first, ties by the md5 of seed and vertex."""
    keyed = scores.withColumn("_tie", random_key(seed, "scenario", "v"))
    return exact_rank(keyed, ["scenario"], "score", "_tie", group_rows=group_rows).select("scenario", "v", "rank")


def random_orders(graph: Graph, trials: int, seed: int) -> DataFrame:
    """(scenario, v, rank) for ``trials`` random orders of the vertices, scenario = trial."""
    scores = graph.vertices.select(F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).cast("long").alias("scenario"), "v")
    return static_order(scores.withColumn("score", F.lit(0)), seed, graph.size)


def edge_orders(graph: Graph, trials: int, seed: int) -> DataFrame:
    """(scenario, order, trial, src, dst, rank) for the three orders; scenario = 'order|trial'."""
    signs = F.array(*[F.struct(F.lit(o).alias("order"), F.lit(float(s)).alias("sign")) for o, s in zip(EDGE_ORDERS, (1, -1, 0))])
    rows = graph.edges.select("src", "dst", "weight", F.explode(signs).alias("o"))
    rows = rows.select("src", "dst", F.col("o.order").alias("order"), (F.col("weight") * F.col("o.sign")).alias("score"),
                       F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    rows = rows.withColumn("scenario", F.concat_ws("|", "order", "trial")).withColumn("_tie", random_key(seed, "scenario", "src", "dst"))
    ranked = exact_rank(rows, ["scenario"], "score", "_tie", group_rows=graph.edges.count())
    return ranked.select("scenario", "order", "trial", "src", "dst", "rank")


def edge_batches(edge_count: int, batch_fraction: float = 0.01, max_fraction: float = 0.5) -> int:
    """Edges per batch, rounded half to even, at least one."""
    return max(1, round(batch_fraction * edge_count))


def edge_batch_table(spark, edge_count: int, batch_fraction: float = 0.01, max_fraction: float = 0.5) -> DataFrame:
    size = edge_batches(edge_count, batch_fraction)
    steps = int(max_fraction * edge_count) // size
    return spark.createDataFrame([(b, b * size / edge_count) for b in range(steps + 1)], "batch int, fraction_removed double")


def edge_removals(orders: DataFrame, edge_count: int, batch_fraction: float = 0.01, max_fraction: float = 0.5) -> DataFrame:
    """(scenario, src, dst, batch) for the edges that go within the removed range."""
    size = edge_batches(edge_count, batch_fraction)
    steps = int(max_fraction * edge_count) // size
    batch = F.ceil(F.col("rank") / size).cast("int")
    return orders.withColumn("batch", batch).filter(F.col("batch") <= steps).select("scenario", "src", "dst", "batch")


def measure(graph: Graph, scenarios: DataFrame, batches: DataFrame, removed: DataFrame, layered: bool | None = None) -> DataFrame:
    """(scenario, batch, fraction_removed, flow, reachable_pairs, avalanche) of vertex removals (scenario, v, batch).

    Flow is one pass over all runs and batches; pairs and cascades share one fixpoint.
    """
    removed = settle(removed.select("scenario", "v", "batch"))
    flows = flow.flow_curve(graph, scenarios, batches, removed, layered=layered)
    labels = reach.source_labels(graph, scenarios, removed)
    pairs = reach.pair_curve(graph, scenarios, batches, per_source=labels)
    cuts = reach.avalanches(reach.disconnection(graph, scenarios, removed, labels), batches)
    joined = flows.join(pairs, ["scenario", "batch"]).join(cuts, ["scenario", "batch"]).join(hint_small(batches.select("batch", "fraction_removed")), "batch")
    return joined.select("scenario", "batch", "fraction_removed", "flow", "reachable_pairs", F.col("newly_cut").alias("avalanche"))


def measure_edges(graph: Graph, scenarios: DataFrame, batches: DataFrame, removed: DataFrame, layered: bool | None = None) -> DataFrame:
    removed = settle(removed)
    flows = flow.flow_curve(graph, scenarios, batches, removed_edges=removed, layered=layered)
    pairs = reach.pair_curve(graph, scenarios, batches, removed_edges=removed)
    return flows.join(pairs, ["scenario", "batch"]).join(hint_small(batches), "batch").select(
        "scenario", "batch", "fraction_removed", "flow", "reachable_pairs"
    )


def random_percolation(graph: Graph, trials: int, seed: int, batch_fraction: float = 0.01, max_fraction: float = 0.5, layered: bool | None = None) -> DataFrame:
    """All random trials in one job; scenario = trial."""
    batches = settle(schedule_table(graph.spark, graph.size, batch_fraction, max_fraction))
    removed = batch_of_rank(random_orders(graph, trials, seed), batches)
    scenarios = graph.spark.range(trials).select(F.col("id").alias("scenario"))
    return measure(graph, scenarios, batches, removed, layered)


def adaptive_removals(
    graph: Graph, strategy: str, scenarios: DataFrame, seed: int, batch_fraction: float = 0.01, max_fraction: float = 0.5,
    gone: DataFrame | None = None, batches: range | None = None,
) -> DataFrame:
    """(scenario, v, batch): scores are taken anew on what is left before every batch.

    All scenarios advance together, one settled state per batch. For the strengths the new scores are the old ones minus
    the edges to vertices that just went, so a whole run reads every edge once, not once per batch. With ``gone``, what an
    earlier call returned, the run goes on with ``batches`` of the schedule; the result holds both parts.
    """
    sizes = [last - first + 1 for first, last in removal_steps(graph.size, batch_fraction, max_fraction)]
    batches = range(1, len(sizes) + 1) if batches is None else batches
    if strategy in ("out_strength", "in_strength"):
        return _adaptive_strength(graph, strategy, scenarios, seed, sizes, gone, batches)
    for batch in batches:
        scores = central.strategy_scores(strategy, graph, scenarios, gone)
        keyed = scores.withColumn("_tie", random_key(seed, F.lit(batch), "v"))
        top = exact_rank(keyed, ["scenario"], "score", "_tie", group_rows=graph.size).filter(F.col("rank") <= sizes[batch - 1])
        chosen = top.select("scenario", "v", F.lit(batch).alias("batch"))
        gone = store(chosen if gone is None else gone.unionByName(chosen))
    return gone


def _adaptive_strength(graph, strategy, scenarios, seed, sizes, gone, batches):
    near, far = ("src", "dst") if strategy == "out_strength" else ("dst", "src")
    edges = hint_small(settle(graph.edges.select(F.col(near).alias("near"), F.col(far).alias("far"), "weight")))
    start = central.strategy_scores(strategy, graph, scenarios, gone)
    state = settle(start.withColumn("batch", F.lit(None).cast("int")))
    for batch in batches:
        left = state.filter("batch is null").withColumn("_tie", random_key(seed, F.lit(batch), "v"))
        ranked = exact_rank(left, ["scenario"], "score", "_tie", group_rows=graph.size)
        marked = ranked.select("scenario", "v", "score", F.when(F.col("rank") <= sizes[batch - 1], F.lit(batch)).alias("batch"))
        chosen = marked.filter("batch is not null").select("scenario", F.col("v").alias("far"))
        lost = chosen.join(edges, "far").select("scenario", F.col("near").alias("v"), (-F.col("weight")).alias("score"), F.lit(None).cast("int").alias("batch"))
        lost = lost if gone is None else lost.join(gone.select("scenario", "v"), ["scenario", "v"], "left_anti")
        everything = marked.unionByName(lost).unionByName(state.filter("batch is not null"))
        state = settle(everything.groupBy("scenario", "v").agg(F.sum("score").alias("score"), F.min("batch").alias("batch")))
    chosen = state.filter("batch is not null").select("scenario", "v", "batch")
    return chosen if gone is None else settle(gone.unionByName(chosen))


# Batches that a longer run takes on before its flow is looked at again.
LOOK_EVERY = 4


def percolate(
    graph: Graph, strategy: str, scenarios: DataFrame, seed: int, batch_fraction: float = 0.01, max_fraction: float = 0.5,
    continue_until_flow_below: float | None = None, layered: bool | None = None,
) -> DataFrame:
    """Curves of an adaptive strategy. With a flow bound a run goes on past ``max_fraction`` until flow is below it.

    The longer run removes the same vertices in its first part, since random keys depend on seed, batch and vertex only. It
    looks at the flow every ``LOOK_EVERY`` batches and ends there once all scenarios are below the bound; their curves end
    with the first batch that is.
    """
    if continue_until_flow_below is None:
        batches = settle(schedule_table(graph.spark, graph.size, batch_fraction, max_fraction))
        return measure(graph, scenarios, batches, adaptive_removals(graph, strategy, scenarios, seed, batch_fraction, max_fraction), layered)
    every = settle(schedule_table(graph.spark, graph.size, batch_fraction, 1.0))
    total = sum(1 for _ in removal_steps(graph.size, batch_fraction, 1.0))
    done = sum(1 for _ in removal_steps(graph.size, batch_fraction, max_fraction))
    removed = adaptive_removals(graph, strategy, scenarios, seed, batch_fraction, 1.0, batches=range(1, done + 1))
    while done < total:
        now = flow.flow_values(graph, scenarios, removed.select("scenario", "v"), layered)
        if now.filter(F.col("flow") >= continue_until_flow_below).isEmpty():
            break
        more = range(done + 1, min(total, done + LOOK_EVERY) + 1)
        removed = adaptive_removals(graph, strategy, scenarios, seed, batch_fraction, 1.0, removed, more)
        done = more[-1]
    curves = measure(graph, scenarios, settle(every.filter(F.col("batch") <= done)), removed, layered)
    stop = F.when((F.col("fraction_removed") >= max_fraction) & (F.col("flow") < continue_until_flow_below), F.col("batch"))
    last = curves.groupBy("scenario").agg(F.min(stop).alias("_last"))
    return curves.join(last, "scenario").filter("_last is null or batch <= _last").drop("_last")


def edge_attack(graph: Graph, trials: int, seed: int, batch_fraction: float = 0.01, max_fraction: float = 0.5, layered: bool | None = None) -> DataFrame:
    """Curves of the three edge orders, all trials in one job."""
    n = graph.edges.count()
    orders = settle(edge_orders(graph, trials, seed))
    scenarios = settle(orders.select("scenario").distinct())
    removed = edge_removals(orders, n, batch_fraction, max_fraction)
    return measure_edges(graph, scenarios, settle(edge_batch_table(graph.spark, n, batch_fraction, max_fraction)), removed, layered)
